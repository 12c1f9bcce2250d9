"""Boosted regression trees grown from histograms that Spark sums, one aggregation a level.

Rows are binned once (numbers by quantiles of the train rows, categories by their codes) and kept as blocks of numpy columns
with the score that the trees so far give them. For a level of a tree every task adds up gradients, curvatures and rows by
(node, feature, bin) over its blocks; Spark sums these by key, and the driver, which gets a number of sums that depends on leaves,
features and bins only, picks the best split of every node. A tree is grown level by level to its depth and then taken leaf by leaf in the
order of gain up to its number of leaves, which yields the tree that growing leaf by leaf would.

What a model may do:

* ``loss``: ``huber`` (slopes bounded by ``alpha``) or ``squared``; rows have weights.
* ``monotone`` signs of numeric features: splits that break one are refused, and the outputs below a split on
  such a feature are held on their side of its middle, so a prediction never falls along it.
* categories are split as sets: their bins in the order of the smoothed gradient ratio, the best prefix goes left.
* after each tree the weighted loss of the valid rows is taken; ``patience`` trees without a better one end the training, and
  predictions use the trees up to the best.

Gradients and curvatures are rounded to multiples of a power of two, fine enough that all sums are whole numbers of it below 2^52: sums
are exact in any order. Rows are drawn by a hash of their own. So a lost task, another order or another partitioning gives the same trees (the first
score, a mean, may differ in its last digit).
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import checkpointed, forget, stored

#: The default parameters of training.
DEFAULTS: dict[str, Any] = {
    "objective": "huber",
    "learning_rate": 0.03,
    "n_estimators": 5000,
    "num_leaves": 31,
    "max_depth": 5,
    "min_child_samples": 500,
    "subsample": 0.8,
    "subsample_freq": 1,
    "colsample_bytree": 0.8,
    "reg_alpha": 0.0,
    "reg_lambda": 2.0,
    "min_split_gain": 0.0,
    "max_bin": 255,
    "cat_smooth": 15,
    "cat_l2": 3,
    "random_state": 42,
}
PATIENCE = 200  # trees without a better loss of the valid rows
CUT = 25  # trees after which the rows' scores are written, so that their lineage stays short
TASK_ROWS = 50_000  # at least, on average
IDLE = 10  # trees in a row without a split that end the training where rows or features are drawn
DEEPEST = 12
FINER = 2.0**20  # of steps where all candidates of a split are told
QUANTILE_ACCURACY = 100  # of the quantiles that bracket the edges, times the number of bins
_STATE = "n long, bins binary, y binary, w binary, valid binary, key binary, score binary"
_FEATURES = 100_003  # keeps the seeds of rows and features apart


@dataclass(frozen=True)
class Settings:
    objective: str = "huber"
    alpha: float = 0.9  # of the Huber loss
    learning_rate: float = 0.03
    n_estimators: int = 5000
    num_leaves: int = 31
    max_depth: int = 5
    min_child_samples: int = 500
    min_child_weight: float = 1e-3
    subsample: float = 0.8
    subsample_freq: int = 1
    colsample_bytree: float = 0.8
    reg_alpha: float = 0.0
    reg_lambda: float = 2.0
    min_split_gain: float = 0.0
    max_bin: int = 255
    cat_smooth: float = 15.0
    cat_l2: float = 3.0
    random_state: int = 42
    patience: int = PATIENCE

    def __post_init__(self):
        if self.objective not in ("huber", "squared"):
            raise ValueError(f"unknown objective {self.objective!r}")
        if not 1 <= self.max_depth <= DEEPEST or self.num_leaves < 2 or not 2 <= self.max_bin <= 65_535:
            raise ValueError(f"max_depth must lie in 1..{DEEPEST}, num_leaves be 2 at least and max_bin lie in 2..65535")
        if not (0 < self.subsample <= 1 and 0 < self.colsample_bytree <= 1 and self.alpha > 0 and self.learning_rate > 0 and self.n_estimators >= 1):
            raise ValueError("subsample and colsample_bytree must lie in (0, 1]; alpha, learning_rate and n_estimators be positive")

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        """Slope of the loss at score - label."""
        return np.clip(residual, -self.alpha, self.alpha) if self.objective == "huber" else residual

    def losses(self, residual: np.ndarray) -> np.ndarray:
        size = np.abs(residual)
        return np.where(size <= self.alpha, 0.5 * residual**2, self.alpha * (size - 0.5 * self.alpha)) if self.objective == "huber" else residual**2

    def output(self, g: np.ndarray | float, h: np.ndarray | float, l2: float, lo: float = -math.inf, hi: float = math.inf) -> np.ndarray:
        shrunk = np.sign(g) * np.maximum(0, np.abs(g) - self.reg_alpha)
        return np.clip(-shrunk / np.maximum(h + l2, 1e-300), lo, hi)

    def gain(self, g: np.ndarray | float, h: np.ndarray | float, out: np.ndarray | float, l2: float) -> np.ndarray:
        """What an output takes off the loss, twice."""
        return -(2 * g * out + (h + l2) * out**2 + 2 * self.reg_alpha * np.abs(out))


@dataclass(frozen=True)
class Split:
    feature: int
    left: np.ndarray  # of bins, which go left
    gain: float
    sides: tuple[tuple[float, float, int], tuple[float, float, int]]  # sums of gradient and curvature, and rows
    outputs: tuple[float, float]


@dataclass
class Tree:
    """Nodes by heap number: 1 is the root, 2i and 2i + 1 are below i. ``feature`` is -1 at leaves."""

    depth: int
    feature: np.ndarray
    left: np.ndarray  # node x bin
    value: np.ndarray
    gains: dict[int, float] = field(default_factory=dict)  # by inner node
    rows: dict[int, int] = field(default_factory=dict)  # by leaf

    @classmethod
    def blank(cls, depth: int, bins: int) -> "Tree":
        nodes = 1 << (depth + 1)
        return cls(0, np.full(nodes, -1, np.int32), np.zeros((nodes, bins), bool), np.zeros(nodes))

    def node_of(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """Leaf of each row; ``bins`` is feature x row."""
        node, row = np.ones(bins.shape[1], np.int64), np.arange(bins.shape[1])
        for _ in range(self.depth if levels is None else levels):
            f = self.feature[node]
            right = ~self.left[node, bins[np.maximum(f, 0), row]]
            node = np.where(f >= 0, 2 * node + right, node)
        return node

    def split(self, node: int, s: Split) -> None:
        self.feature[node], self.left[node, : len(s.left)], self.gains[node] = s.feature, s.left, s.gain
        self.depth = max(self.depth, node.bit_length())

    @property
    def numNodes(self) -> int:  # noqa: N802  as Spark's trees name it
        return 2 * len(self.gains) + 1

    def told(self, kinds: Sequence[int]) -> dict[str, Any]:
        """Splits by node: feature, what goes left (categories, or the number of bins) and gain."""
        left = lambda n: np.flatnonzero(self.left[n]).tolist() if kinds[self.feature[n]] else int(self.left[n].sum())
        splits = {str(n): [int(self.feature[n]), left(n), self.gains[n]] for n in self.gains}
        return {"splits": splits, "values": {str(n): float(self.value[n]) for n in self.rows}, "rows": {str(n): r for n, r in self.rows.items()}}

    @classmethod
    def read(cls, told: Mapping[str, Any], bins: int) -> "Tree":
        depth = max((int(n).bit_length() for n in told["splits"]), default=0)
        tree = cls.blank(max(1, depth), bins)
        for n, (f, left, gain) in told["splits"].items():
            mask = np.zeros(bins, bool)
            mask[slice(left) if isinstance(left, int) else left] = True
            tree.split(int(n), Split(f, mask, gain, ((0, 0, 0), (0, 0, 0)), (0, 0)))
        for n, v in told["values"].items():
            tree.value[int(n)], tree.rows[int(n)] = v, told["rows"][n]
        return tree


def best_split(hist: np.ndarray, allowed: Sequence[int], kinds: Sequence[int], signs: Sequence[int], bounds: tuple[float, float], s: Settings) -> Split | None:
    """The split of a node with the largest gain; ties go to the earlier feature and the lower bin.

    ``hist`` is (gradient, curvature, rows) x feature x bin, ``kinds`` are the categories of a feature (0: it is a number).
    """
    g, h, n = hist[0, 0].sum(), hist[1, 0].sum(), hist[2, 0].sum()
    lo, hi = bounds
    parent = float(s.gain(g, h, s.output(g, h, s.reg_lambda, lo, hi), s.reg_lambda))
    best: Split | None = None
    for f in allowed:
        orders, l2 = [np.arange(hist.shape[2])], s.reg_lambda
        if kinds[f]:
            held = np.flatnonzero(hist[2, f, : kinds[f]] >= max(1, s.cat_smooth))
            ratio = hist[0, f, held] / (hist[1, f, held] + s.cat_smooth)
            orders, l2 = [held[np.argsort(ratio, kind="stable")]], s.reg_lambda + s.cat_l2
        for order in orders:
            gl, hl, nl = (np.cumsum(hist[k, f, order])[: len(order) if kinds[f] else -1] for k in range(3))
            gr, hr, nr = g - gl, h - hl, n - nl
            ol, or_ = s.output(gl, hl, l2, lo, hi), s.output(gr, hr, l2, lo, hi)
            gain = s.gain(gl, hl, ol, l2) + s.gain(gr, hr, or_, l2) - parent
            ok = (nl >= s.min_child_samples) & (nr >= s.min_child_samples) & (hl >= s.min_child_weight) & (hr >= s.min_child_weight) & (nl > 0) & (nr > 0)
            ok &= (signs[f] * (or_ - ol) >= 0) & (gain > max(s.min_split_gain, 1e-12 * abs(parent)))
            if not ok.any():
                continue
            at = int(np.argmax(np.where(ok, gain, -np.inf)))
            if best is None or gain[at] > best.gain * (1 + 1e-12):
                left = np.zeros(hist.shape[2], bool)
                left[order[: at + 1]] = True
                best = Split(f, left, float(gain[at]), ((float(gl[at]), float(hl[at]), int(nl[at])), (float(gr[at]), float(hr[at]), int(nr[at]))), (float(ol[at]), float(or_[at])))
    return best


def _kind(bins: int) -> type:
    """The smallest type that holds so many bins."""
    return np.uint8 if bins <= 256 else np.uint16


class Bins:
    """Values to bins: numbers by their upper edges (the last bin has none), categories by their codes."""

    def __init__(self, edges: Sequence[Sequence[float]], kinds: Sequence[int]):
        self.edges, self.kinds = [np.array(e, float) for e in edges], list(kinds)

    @property
    def most(self) -> int:
        return max([2, *(k or len(e) + 1 for e, k in zip(self.edges, self.kinds, strict=True))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Row x feature to feature x row. A code that the train rows do not know is the last category's."""
        out = np.empty((x.shape[1], x.shape[0]), _kind(self.most))
        for f, (edges, kind) in enumerate(zip(self.edges, self.kinds, strict=True)):
            out[f] = np.clip(np.nan_to_num(x[:, f], nan=kind - 1), 0, kind - 1) if kind else np.searchsorted(edges, x[:, f], side="left")
        return out


def _keyed(rows: DataFrame) -> DataFrame:
    """x, y, w and valid with a hash of the row, which equal rows share."""
    return rows.withColumn("key", F.xxhash64("x", "y", "w"))


def _packed(bins: Bins, init: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            y, w = (batch.column(k).to_numpy().astype("<f8") for k in (1, 2))
            valid = batch.column(3).to_numpy(zero_copy_only=False).astype(np.uint8)
            raw = (bins(x), y, w, valid, batch.column(4).to_numpy().astype("<i8"), np.full(len(y), init, "<f8"))
            yield pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in raw]], names=[c.split()[0] for c in _STATE.split(", ")])

    return run


def _columns(batch: pa.RecordBatch, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of the state: bins (feature x row), y, w, valid, key, score."""
    for n, bins, y, w, valid, key, score in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
        yield np.frombuffer(bins, _kind(most)).reshape(-1, n), np.frombuffer(y), np.frombuffer(w), np.frombuffer(valid, np.uint8).astype(bool), np.frombuffer(key, np.uint64), np.frombuffer(score)


def drawn(key: np.ndarray, seed: int, draw: int, share: float) -> np.ndarray:
    """Which rows a draw takes: a mixed hash of the row's own below ``share``, so it does not matter where the row lies."""
    z = key + np.uint64((seed * 0x9E3779B97F4A7C15 + (draw + 1) * 0xD1B54A32D192ED03) % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) < np.uint64(min((1 << 64) - 1, int(share * (1 << 64))))


def _advanced(tree: Tree):
    """Adds a tree to the scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [(score + tree.value[tree.node_of(bins)]).tobytes() for bins, _, _, _, _, score in _columns(batch, tree.left.shape[1])]
            yield batch.set_column(6, "score", pa.array(scores, pa.binary()))

    return run


@dataclass(frozen=True)
class Scales:
    """Steps to which gradients, curvatures and losses are rounded: powers of two whose sums over all rows stay below 2^52.

    With ``finer``, a power of two, what rounding leaves of gradients and curvatures is summed too, in steps so much smaller.
    """

    g: float
    h: float
    loss: float
    finer: float = 0.0

    @classmethod
    def of(cls, rows: int, g: float, h: float, loss: float) -> "Scales":
        return cls(*(2.0 ** min(1000, math.floor(51 - math.log2(max(1, rows)) - math.log2(max(most, 1e-300)))) for most in (g, h, loss)))


def _sums(scales: Scales) -> list[str]:
    return ["g", "h", "n", *(["g_rest", "h_rest"] if scales.finer else [])]


def _summed(tree: Tree, level: int, features: Sequence[int], bins: int, scales: Scales, s: Settings, number: int):
    """Partial sums of a task by (node, feature, bin); at level 0 also the valid rows' loss, as node -1."""
    used, nodes = np.array(features), 1 << level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist, told = np.zeros((5 if scales.finer else 3, nodes, len(used), bins)), np.zeros(3)
        for batch in batches:
            for binned, y, w, valid, key, score in _columns(batch, bins):
                residual = score - y
                if level == 0:
                    told += (np.rint(s.losses(residual)[valid] * w[valid] * scales.loss).sum(), np.rint(w[valid] * scales.h).sum(), valid.sum())
                node = tree.node_of(binned, level) - nodes  # leaves of earlier levels are below 0
                inside = ~valid & (node >= 0)
                if s.subsample < 1 and s.subsample_freq > 0:
                    inside &= drawn(key, s.random_state, number // s.subsample_freq, s.subsample)
                node, kept, weight = node[inside], binned[used][:, inside], w[inside]
                exact = [s.gradient(residual[inside]) * weight * scales.g, weight * scales.h]
                parts = [*map(np.rint, exact), None]
                if scales.finer:
                    parts += [np.rint((x - whole) * scales.finer) for x, whole in zip(exact, parts, strict=False)]
                for f in range(len(used)):
                    place = node * bins + kept[f]
                    for k, values in enumerate(parts):
                        hist[k, :, f] += np.bincount(place, values, nodes * bins).reshape(nodes, bins)
        node, f, b = np.nonzero(hist[2])
        g, h, n, *rest = (hist[k, node, f, b] for k in range(len(hist)))
        rows = [np.append(a, x) for a, x in ((node + nodes, -1), (used[f], -1), (b, 0), (g, told[0]), (h, told[1]), (n, told[2]), *[(r, 0) for r in rest])]
        kinds = [np.int32] * 3 + [float] * len(hist)
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(t)) for a, t in zip(rows, kinds, strict=True)], names=["node", "feature", "bin", *_sums(scales)])

    return run


def level_sums(state: DataFrame, tree: Tree, level: int, features: Sequence[int], bins: int, scales: Scales, s: Settings, number: int = 0) -> DataFrame:
    """(node, feature, bin, g, h, n) over all rows, in the steps of ``scales``: exact, so their order does not matter. With finer steps also g_rest and h_rest, in those."""
    names = _sums(scales)
    partial = state.mapInArrow(_summed(tree, level, features, bins, scales, s, number), "node int, feature int, bin int, " + ", ".join(f"{c} double" for c in names))
    return partial.groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in names])


def _placed(brackets: Mapping[int, tuple[np.ndarray, np.ndarray]]):
    """Train rows by (feature, slot): brackets have odd slots and keep their values, what lies between them is only counted."""
    names = ["feature", "slot", "v", "n"]

    def told(f: int, slot: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), f, np.int32)), pa.array(slot.astype(np.int32)), pa.array(v.astype(float)), pa.array(n.astype(np.int64))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {f: np.zeros(len(lo) + 1, np.int64) for f, (lo, _) in brackets.items()}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten()).reshape(batch.num_rows, -1)
            for f, (lo, hi) in brackets.items():
                over = np.searchsorted(hi, x[:, f], side="left")  # brackets that end below
                inside = np.searchsorted(lo, x[:, f], side="right") > over
                between[f] += np.bincount(over[~inside], minlength=len(lo) + 1)
                v, n = np.unique(x[inside, f] + 0.0, return_counts=True)
                yield told(f, 2 * np.searchsorted(hi, v, side="left") + 1, v, n)
        for f, n in between.items():
            yield told(f, 2 * np.arange(len(n)), np.zeros(len(n)), n)

    return run


def exact_edges(rows: DataFrame, near: Mapping[int, tuple[Sequence[float], Sequence[float]]], bins: int) -> dict[int, list[float]]:
    """The k-th of ``bins`` quantiles of the train rows' ``x`` by feature: the value that holds rank ceil(k / bins * rows).

    ``near`` has a lower and an upper bound for each. Values within bounds, a few hundredths of all, are counted by value and the others by where they
    lie; a rank that a bound misses widens the bounds and takes another pass. The driver gets sums by bound and the edges.
    """
    spark, out = rows.sparkSession, {f: [] for f in near}
    x, left = rows.where(~F.col("valid")).select("x"), dict(near)
    while left:
        brackets = {}
        for f, (lo, hi) in left.items():
            lo, hi = np.sort(np.array(lo, float) + 0.0), np.sort(np.array(hi, float) + 0.0)
            new = np.append(True, lo[1:] > np.maximum.accumulate(hi)[:-1])  # those that overlap are one
            brackets[f] = lo[new], np.append(hi[:-1][new[1:]], hi[-1])
        counted = x.mapInArrow(_placed(brackets), "feature int, slot int, v double, n long").groupBy("feature", "slot", "v").agg(F.sum("n").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        totals: dict[int, dict[int, int]] = {f: {} for f in brackets}
        for r in counted.groupBy("feature", "slot").agg(F.sum("n").alias("n")).collect():  # a row for each bound and between two
            totals[r["feature"]][r["slot"]] = r["n"]
        wanted, missed = [], {}
        for f, by_slot in totals.items():
            slots = sorted(by_slot)
            upto = np.cumsum([by_slot[k] for k in slots])
            ranks = np.array([max(1, math.ceil(k / bins * int(upto[-1]))) for k in range(1, bins)])
            at = np.searchsorted(upto, ranks, side="left")
            own = [slots[i] for i in at]
            if lost := sorted({k for k in own if k % 2 == 0}):
                lo, hi = (np.concatenate([[-np.inf], b, [np.nan]]) for b in brackets[f])  # NaN is above all
                missed[f] = [*lo[1:-1], *[lo[k // 2] for k in lost]], [*hi[1:-1], *[hi[k // 2 + 1] for k in lost]]
                continue
            wanted += [(f, k, int(rank - (upto[i] - by_slot[k]))) for k, i, rank in zip(own, at, ranks, strict=True)]
        if wanted:
            places = spark.createDataFrame(wanted, "feature int, slot int, place long").distinct()
            inside = Window.partitionBy("feature", "slot").orderBy("v")
            upto = counted.where("slot % 2 = 1").withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
            held = upto.join(F.broadcast(places), ["feature", "slot"]).where("place <= upto and place > upto - n")  # a row for each bin and feature
            for r in held.select("feature", "v").distinct().collect():
                out[r["feature"]].append(r["v"])
        counted.unpersist()
        left = missed
    return out


class BoostedTrees:
    """A trained model. ``transform`` adds ``prediction`` to rows with ``features``, by the trees up to ``best_iteration``."""

    def __init__(self, names: Sequence[str], bins: Bins, init: float, trees: Sequence[Tree], best_iteration: int, settings: Settings, losses: Sequence[float] = ()):
        self.names, self.bins, self.init, self.all_trees = list(names), bins, init, list(trees)
        self.best_iteration, self.settings, self.losses = best_iteration, settings, list(losses)

    @property
    def trees(self) -> list[Tree]:
        return self.all_trees[: self.best_iteration]

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x), np.full(len(x), self.init)
        for tree in self.trees:
            out += tree.value[tree.node_of(binned)]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        told = self.told()

        @F.arrow_udf("double")
        def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = BoostedTrees.read(told)
            for features in batches:
                yield pa.array(model.predict(np.array(features.flatten()).reshape(len(features), -1)) if len(features) else [], pa.float64())

        return df.withColumn("prediction", predicted(vector_to_array("features")))

    def gain_by_feature(self) -> dict[str, float]:
        """Gain of all splits on each feature."""
        out = dict.fromkeys(self.names, 0.0)
        for tree in self.trees:
            for node, gain in tree.gains.items():
                out[self.names[tree.feature[node]]] += gain
        return out

    def splits_by_feature(self) -> dict[str, int]:
        out = dict.fromkeys(self.names, 0)
        for tree in self.trees:
            for node in tree.gains:
                out[self.names[tree.feature[node]]] += 1
        return out

    def told(self) -> str:
        return json.dumps({
            "names": self.names,
            "edges": [e.tolist() for e in self.bins.edges],
            "kinds": self.bins.kinds,
            "init": self.init,
            "best_iteration": self.best_iteration,
            "losses": self.losses,
            "settings": self.settings.__dict__,
            "trees": [t.told(self.bins.kinds) for t in self.all_trees],
        })

    @classmethod
    def read(cls, told: str) -> "BoostedTrees":
        d = json.loads(told)
        bins = Bins(d["edges"], d["kinds"])
        return cls(d["names"], bins, d["init"], [Tree.read(t, bins.most) for t in d["trees"]], d["best_iteration"], Settings(**d["settings"]), d["losses"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.told(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        return cls.read(spark.read.text(path).first()[0])


class Booster:
    """Trains ``BoostedTrees`` on rows with ``features`` (a vector), ``label``, ``weight`` and ``is_valid``.

    ``params`` are those of ``DEFAULTS``, ``alpha``, ``patience`` and ``min_child_weight``; ``monotone`` has signs by feature name.
    """

    def __init__(self, monotone: Mapping[str, int] | None = None, **params: Any):
        known = set(Settings.__dataclass_fields__)
        unknown = sorted(set(params) - known)
        if unknown:
            raise ValueError(f"unknown parameters of boosted trees: {unknown}")
        self.settings = replace(Settings(**DEFAULTS), **params)
        self.monotone, self.names, self.kinds = dict(monotone or {}), None, None

    def named(self, names: Sequence[str], levels: Mapping[str, int]) -> "Booster":
        """Tells the features' names in order and the number of categories of those that hold codes."""
        unknown = sorted(set(self.monotone) - set(names))
        if unknown or any(f in levels for f, sign in self.monotone.items() if sign):
            raise ValueError(f"monotone constraints need numeric features: {unknown or sorted(set(self.monotone) & set(levels))}")
        self.names, self.kinds = list(names), [levels.get(n, 0) for n in names]
        return self

    def fit(self, df: DataFrame) -> BoostedTrees:
        s = self.settings
        rows = _keyed(df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("weight").cast("double").alias("w"), F.col("is_valid").alias("valid")))
        bins, told = self._measured(rows)
        names = self.names or [f"f{i}" for i in range(len(bins.kinds))]
        signs = [self.monotone.get(n, 0) for n in names]
        # written once: scores are read again for every level
        state, written = stored(rows.mapInArrow(_packed(bins, told["init"]), _STATE), "boosting")
        state = state.coalesce(-(-told["rows"] // TASK_ROWS))
        widest, heaviest = told["widest"], max(told["heaviest"], 1e-300)
        trees, losses, best, held, idle = [], [], (math.inf, 0), None, 0
        every = list(range(len(names)))
        for number in range(s.n_estimators + 1):
            slope = min(s.alpha, widest) if s.objective == "huber" else widest
            scales = Scales.of(told["rows"], slope * heaviest, heaviest, widest**2 * heaviest)
            features = every
            if s.colsample_bytree < 1:
                count = max(1, round(len(every) * s.colsample_bytree))
                features = sorted(np.random.default_rng([s.random_state, _FEATURES, number]).choice(every, count, replace=False).tolist())
            last = number == s.n_estimators
            if last and not told["valid"]:
                break
            tree, sums = self._grown(state, bins, features, scales, signs, number, last)
            if held is not None:
                held.unpersist()
            if told["valid"]:
                loss = sums[0] / scales.loss / max(sums[1] / scales.h, 1e-300)
                losses.append(loss)
                if number:
                    best = min(best, (loss, number))
                if last or (s.patience and number and number - best[1] >= s.patience):
                    break
            idle = 0 if tree.gains else idle + 1
            if idle >= (1 if s.subsample >= 1 and s.colsample_bytree >= 1 else IDLE):
                break  # no split is worth while, and none will be
            trees.append(tree)
            widest += float(np.abs(tree.value).max())
            held, state = (state if number else None), state.mapInArrow(_advanced(tree), _STATE)
            if (number + 1) % CUT:
                state = state.persist(StorageLevel.MEMORY_AND_DISK)
                continue
            former, (state, written) = written, stored(state, "boosting")
            forget(df.sparkSession, former)  # what is read from now on does not go back to it
        if held is not None:
            held.unpersist()
        state.unpersist()
        forget(df.sparkSession, written)
        return BoostedTrees(names, bins, told["init"], trees, best[1] if told["valid"] and s.patience else len(trees), s, losses)

    def _measured(self, rows: DataFrame) -> tuple[Bins, dict[str, Any]]:
        """One pass: quantiles of the train rows, their weighted mean, and the ranges that fix the rounding."""
        first = rows.select(F.size("x").alias("n")).first()
        kinds = self.kinds or [0] * (first["n"] if first else 0)
        train, s = ~F.col("valid"), self.settings
        accuracy = QUANTILE_ACCURACY * s.max_bin
        points = [min(1.0, max(0.0, k / s.max_bin + side / accuracy)) for k in range(1, s.max_bin) for side in (-2, 0, 2)]
        # as text: a column object for each of the fractions takes longer than the aggregation of a small table
        fractions = ", ".join(f"{p!r}D" for p in points)
        quantiles = [F.expr(f"percentile_approx(CASE WHEN NOT valid THEN get(x, {f}) END, array({fractions}), {accuracy}) AS q{f}") for f, kind in enumerate(kinds) if not kind]
        got = rows.agg(
            F.count_if(train).alias("rows"),
            F.count_if(~train).alias("valid"),
            F.sum(F.when(train, F.col("w") * F.col("y"))).alias("wy"),
            F.sum(F.when(train, F.col("w"))).alias("w"),
            F.min("y").alias("lo"),
            F.max("y").alias("hi"),
            F.max("w").alias("heaviest"),
            *quantiles,
        ).first()
        if not got["rows"] or not got["w"]:
            raise ValueError("there are no train rows with a weight")
        near = {f: got[f"q{f}"] for f, kind in enumerate(kinds) if not kind}
        if 2 * got["rows"] <= accuracy:  # an error below one rank
            found = {f: q[1::3] for f, q in near.items()}
        else:
            found = exact_edges(rows, {f: (q[::3], q[2::3]) for f, q in near.items()}, s.max_bin)
        edges = [[] if kind else sorted(set(found[f])) for f, kind in enumerate(kinds)]
        init = got["wy"] / got["w"]
        return Bins(edges, kinds), {"rows": got["rows"] + got["valid"], "valid": got["valid"], "init": init, "widest": max(got["hi"] - init, init - got["lo"]), "heaviest": got["heaviest"]}

    def _grown(self, state: DataFrame, bins: Bins, features: Sequence[int], scales: Scales, signs: Sequence[int], number: int, only_loss: bool) -> tuple[Tree, tuple[float, float]]:
        """The next tree, and the valid rows' sums of loss and weight before it."""
        s, most, told = self.settings, bins.most, (0.0, 0.0)
        wide = Tree.blank(s.max_depth, most)
        found: dict[int, Split] = {}
        bounds, rows = {1: (-math.inf, math.inf)}, 0
        frontier = [1]
        for level in range(s.max_depth):
            sums = level_sums(state, wide, level, features, most, scales, s, number).toArrow()
            node, f, b = (sums.column(k).to_numpy() for k in range(3))
            g, h, n = sums.column(3).to_numpy() / scales.g, sums.column(4).to_numpy() / scales.h, sums.column(5).to_numpy()
            if level == 0:
                at = node < 0
                told = (float(sums.column(3).to_numpy()[at].sum()), float(sums.column(4).to_numpy()[at].sum()))
                rows = int(n[(node == 1) & (f == features[0])].sum())
            if only_loss:
                return wide, told
            place = {x: i for i, x in enumerate(features)}
            below = []
            for x in frontier:
                hist, mine = np.zeros((3, len(features), most)), node == x
                at = np.array([place[i] for i in f[mine].tolist()], int)
                for k, values in enumerate((g, h, n)):
                    hist[k, at, b[mine]] = values[mine]
                split = best_split(hist, range(len(features)), [bins.kinds[i] for i in features], [signs[i] for i in features], bounds[x], s)
                if split is None:
                    continue
                found[x] = split = replace(split, feature=features[split.feature])
                wide.split(x, split)
                lo, hi = bounds[x]
                middle = sum(split.outputs) / 2
                sides = [(lo, hi), (lo, hi)]
                if sign := signs[split.feature]:
                    sides = [(lo, middle), (middle, hi)] if sign > 0 else [(middle, hi), (lo, middle)]
                bounds[2 * x], bounds[2 * x + 1] = sides
                below += [2 * x, 2 * x + 1]
            frontier = below
            if not frontier:
                break
        return self._taken(found, rows, most), told

    def _taken(self, found: Mapping[int, Split], rows: int, most: int) -> Tree:
        """Splits in the order of gain, up to the number of leaves, whose outputs are those of their splits. A tree without splits adds nothing."""
        s = self.settings
        tree, leaves = Tree.blank(s.max_depth, most), {1: (0.0, rows)}
        waiting = [(-found[1].gain, 1)] if 1 in found else []
        while waiting and len(leaves) < s.num_leaves:
            _, node = heapq.heappop(waiting)
            split = found[node]
            tree.split(node, split)
            del leaves[node]
            for child, output, side in zip((2 * node, 2 * node + 1), split.outputs, split.sides, strict=True):
                leaves[child] = (s.learning_rate * output, side[2])
                if child in found:
                    heapq.heappush(waiting, (-found[child].gain, child))
        for leaf, (value, n) in leaves.items():
            tree.value[leaf], tree.rows[leaf] = value, n
        return tree


def root_gains(df: DataFrame, features: Sequence[str], label: Column, weight: Column, categories: Mapping[str, int] | None = None, **params: Any) -> DataFrame:
    """Every candidate split of a first tree's root: feature, position (in the order of bins, or of categories by their ratio), left_rows and gain.

    All rows of ``df`` are train rows. Features named in ``categories`` hold codes from 0 up to that number less 1.
    """
    booster = Booster(**params | {"subsample": 1.0, "colsample_bytree": 1.0}).named(features, categories or {})
    s = booster.settings
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(df.select(*features, label.alias("label"), weight.alias("weight")))
    # written once: edges and sums pass over them
    rows = checkpointed(_keyed(ready.select(vector_to_array("features").alias("x"), F.col("label").alias("y"), F.col("weight").alias("w"), F.lit(False).alias("valid"))))
    bins, told = booster._measured(rows)
    slope = min(s.alpha, told["widest"]) if s.objective == "huber" else told["widest"]
    # sums of many rows show what rounding takes off each: the rest is carried as well
    scales = replace(Scales.of(told["rows"], slope * told["heaviest"], told["heaviest"], 1.0), finer=FINER)
    state = rows.mapInArrow(_packed(bins, told["init"]), _STATE)
    sums = level_sums(state, Tree.blank(s.max_depth, bins.most), 0, range(len(features)), bins.most, scales, s).where("node = 1")
    sums = sums.withColumns({c: F.col(c) + F.col(f"{c}_rest") / scales.finer for c in "gh"})
    kinds = F.array(*[F.lit(k) for k in bins.kinds])
    names = F.array(*[F.lit(n) for n in features])
    each = sums.select(F.get(names, F.col("feature")).alias("feature"), (F.get(kinds, F.col("feature")) > 0).alias("is_category"), "bin", (F.col("g") / scales.g).alias("g"), (F.col("h") / scales.h).alias("h"), F.col("n").cast("long").alias("n"))
    each = each.where(~F.col("is_category") | (F.col("n") >= max(1, s.cat_smooth)))
    whole = sums.where("feature = 0").agg(F.sum("g").alias("tg"), F.sum("h").alias("th"), F.sum("n").cast("long").alias("tn"))  # one row
    ordered = Window.partitionBy("feature").orderBy(F.when(F.col("is_category"), F.col("g") / (F.col("h") + s.cat_smooth)).otherwise(F.col("bin").cast("double")), "bin")
    left = each.select("feature", "is_category", "bin", *[F.sum(c).over(ordered).alias(f"l{c}") for c in "ghn"], F.row_number().over(ordered).alias("position"))
    both = left.crossJoin(F.broadcast(whole)).withColumns({"tg": F.col("tg") / scales.g, "th": F.col("th") / scales.h})
    l2 = F.when(F.col("is_category"), s.reg_lambda + s.cat_l2).otherwise(s.reg_lambda)
    part = lambda g, h, ridge: g * g / (h + ridge)  # noqa: E731  without bounds and L1, output -g / (h + ridge)
    gain = part(F.col("lg"), F.col("lh"), l2) + part(F.col("tg") - F.col("lg"), F.col("th") - F.col("lh"), l2) - part(F.col("tg"), F.col("th"), F.lit(s.reg_lambda))
    rows_right = F.col("tn") - F.col("ln")
    out = both.where((F.col("ln") >= s.min_child_samples) & (rows_right >= max(1, s.min_child_samples)))
    return out.select("feature", F.col("position").cast("long"), F.col("ln").alias("left_rows"), gain.alias("gain"))
