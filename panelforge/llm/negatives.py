"""Hard negatives for contrastive training, found exactly by angular triangle filtering.

Vectors are scaled to whole numbers; a row's score is its inner product with an anchor. Every row's angles to a few reference
directions are computed once and stored with its norm. For an anchor a and a row x, each reference r gives
``|a^r - x^r| <= a^x <= min(a^r + x^r, 2 pi - a^r - x^r)``: the cosine of the angle lies in an interval, and times both norms, with
slack for rounding, so does the score. Only rows whose interval meets a window in which scores are wanted are scored.

1. Positives: rows of the anchor's own label, in the order of their upper bounds, until none can enter the first ``k``.
2. Negatives: each positive's score gives the window of its negatives. Of the rows of other labels those are scored whose
   interval meets a window, again from the highest upper bound down, until all windows of the anchor are settled.

Rows are dealt by their nearest reference direction, in parts of bounded size, so a part's rows look alike: a part whose own
intervals (over all of its rows) meet no window of an anchor is passed over without looking at its rows. What the parts found for
an anchor, at most ``k`` rows a window, is ranked by a window function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shuffle_width, table
from .vectors import LEAST_ROWS, LONGEST, products, stream_parts, valid_vectors

REFERENCES = 16
SAMPLE = 2048  # vectors from which reference directions are chosen at most
PART_ROWS = 1 << 16  # rows that a task holds
QUERY_BLOCK = 256
STEP = 256  # rows scored at first; twice as many each time after
ANGLE_SLACK = 1e-6  # radians and parts of the norms' product: far above the rounding of cosines and their inverse
LONGEST_NORM = 1e150  # of a scaled vector, so that products of two are finite doubles
COLUMNS = {"vec": "<f8", "angles": "<f8", "norm": "<f8", "label": "<i8", "windows": "<i8"}


def choose_references(x: np.ndarray, count: int) -> np.ndarray:
    """Directions of rows of ``x`` at large angles to each other: each next one has the largest angle to its nearest before."""
    norms = np.linalg.norm(x, axis=1)
    x = x[norms > 0] / norms[norms > 0, None]
    if not len(x):
        return np.eye(1, x.shape[1])
    chosen, nearest = [0], x @ x[0]
    while len(chosen) < min(count, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen]


def angles_to(x: np.ndarray, norms: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles of the rows of ``x``; those of a zero vector are right angles (its scores are 0 whatever the angle)."""
    unit = x / np.where(norms > 0, norms, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1))


def score_bounds(low: np.ndarray, high: np.ndarray, asked: np.ndarray, norms: np.ndarray | float, norm: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores of rows whose angle to reference j is between ``low[j]`` and ``high[j]`` with a vector whose
    angles are ``asked``. Rows of one angle have ``low`` is ``high``; the first axis is the reference."""
    nearest, farthest = np.zeros(low.shape[1]), np.full(low.shape[1], np.pi)
    for lo, hi, a in zip(low, high, asked, strict=True):
        np.maximum(nearest, np.maximum(lo - a, a - hi), out=nearest)
        np.minimum(farthest, np.minimum(hi + a, 2 * np.pi - lo - a), out=farthest)
    scale, slack = norms * norm, ANGLE_SLACK * norms * norm + 1
    least, most = np.cos(np.minimum(np.pi, farthest + ANGLE_SLACK)), np.cos(np.maximum(0, nearest - ANGLE_SLACK))
    return scale * least - slack, scale * most + slack


class Part:
    """A part of the index: which rows an anchor has to score, and their scores."""

    def __init__(self, part: dict[str, np.ndarray], scored: Callable[[int, int], None] | None):
        self.part, self.scored = part, scored
        self.angles, self.norms, self.label = np.ascontiguousarray(part["angles"].T), part["norm"][:, 0], part["label"][:, 0]
        self.low, self.high = self.angles.min(axis=1, keepdims=True), self.angles.max(axis=1, keepdims=True)
        self.norm = self.norms.max(initial=0)

    def meets(self, lower: float, upper: float, angles: np.ndarray, norm: float) -> bool:
        """Whether any row may score between the two. A part's rows have norms from 0 up, so its interval holds 0."""
        least, most = score_bounds(self.low, self.high, angles, self.norm, norm)
        return max(float(most[0]), 1) >= lower and min(float(least[0]), -1) <= upper

    def search(self, j: int, asked: dict[str, np.ndarray], same: bool, windows: list[tuple[int, int]], k: int) -> list[tuple[int, int, int]]:
        """(score, id, n) of all rows of the anchor's label (``same``), or of another, that are among the first ``k`` of a window."""
        vec, angles, norm, label, n = asked["vec"][j], asked["angles"][j], asked["norm"][j, 0], asked["label"][j, 0], asked["n"][j]
        # scores beyond a long count as its limits, bounds do not
        reals = [(-np.inf if lo <= -LONGEST else lo, np.inf if hi >= LONGEST else hi) for lo, hi in windows]
        lower, upper = min(w[0] for w in reals), max(w[1] for w in reals)
        if not self.meets(lower, upper, angles, norm):
            return []
        rows = np.flatnonzero((self.label == label) == same)
        rows = rows[self.part["n"][rows] != n]
        least, most = score_bounds(self.angles[:, rows], self.angles[:, rows], angles, self.norms[rows], norm)
        meeting = np.zeros(len(rows), bool)
        for lo, hi in reals:
            meeting |= (most >= lo) & (least <= hi)
        order = np.flatnonzero(meeting)
        order = order[np.argsort(-most[order], kind="stable")]
        best: list[list[tuple[int, int, int]]] = [[] for _ in windows]
        at, step, looked = 0, STEP, 0
        while at < len(order):
            # a window whose k-th score is above all bounds to come is settled; bounds are compared as real numbers, so ties go on
            open_ = [w for w, found in zip(reals, best, strict=True) if len(found) < k or -found[-1][0] <= most[order[at]]]
            if not any(most[order[at]] >= lo for lo, _ in open_):
                break
            take = rows[order[at : at + step]]
            at, step, looked = at + step, step * 2, looked + len(take)
            scores, ids, ns = products(self.part["vec"][take], vec), self.part["id"][take], self.part["n"][take]
            for i, (lo, hi) in enumerate(windows):
                held = np.flatnonzero((scores >= lo) & (scores <= hi))
                held = held[np.lexsort((ns[held], ids[held], -scores[held]))[:k]]
                best[i] = sorted([*best[i], *zip((-scores[held]).tolist(), ids[held].tolist(), ns[held].tolist(), strict=True)])[:k]
        if self.scored:
            self.scored(looked, len(rows))
        return [(-s, i, m) for s, i, m in dict.fromkeys(x for found in best for x in found)]


def _search(same: bool, k: int, scored: Callable[[int, int], None] | None = None):
    """For ``stream_parts``. An anchor's windows are pairs of the lowest and the highest score wanted."""

    def prepared(arrays: dict[str, np.ndarray]):
        part = Part(arrays, scored)

        def find(asked: dict[str, np.ndarray]) -> list[tuple[list[int], list[int], list[int]]]:
            out = []
            for j, windows in enumerate(asked["windows"].reshape(len(asked["n"]), -1, 2).tolist()):
                got = part.search(j, asked, same, [tuple(w) for w in dict.fromkeys(map(tuple, windows))], k)
                out.append(tuple(map(list, zip(*((n, i, s) for s, i, n in got), strict=True))) if got else ([], [], []))
            return out

        return find

    return prepared


def hard_negatives(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    every: int = 100,
    positives: int = 5,
    k: int = 5,
    scale: float = 256.0,
    percent: int = 80,
) -> DataFrame:
    """For each anchor and each of its positives, the ``k`` best rows of other labels that score almost as high.

    anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. A component x becomes
    floor(``scale`` * x); scores are whole inner products, exact, and those beyond a long count as its largest or smallest value.
    Anchors are the rows whose id is divisible by ``every``; positives the first ``positives`` other rows of their
    label; negatives of a positive score from ``percent`` hundredths of its score up to it (none if that is negative). Higher
    scores come first, ties go by the smaller id.

    Rows without id or label, and vectors that are null, empty, of odd length, of a scaled length from 1e150 on, or
    hold null or non-finite components take no part. Rows that repeat an id are rows of their own. With fewer
    positives or negatives all are returned; an empty table gives an empty result; other columns are ignored. Reference
    directions are chosen from at most ``SAMPLE`` vectors; every row is indexed and the result does not depend on them.
    """
    spark = rows.sparkSession
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    labelled = rows.where(F.col(f"`{label_col}`").isNotNull())
    held, path = valid_vectors(labelled, id_col, vector_col, zero=True, keep=[F.col(f"`{label_col}`").cast("long").alias("label")])
    sample = held.select("vec", F.xxhash64("id", "n").alias("h"), "n").orderBy("h", "n").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], out_schema)
    drawn = np.floor(np.array([r["vec"] for r in sample], float) * scale)
    references = choose_references(drawn[np.linalg.norm(drawn, axis=1) < LONGEST_NORM], REFERENCES)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.floor(np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1) * scale)
            norms = np.linalg.norm(x, axis=1)
            ok = norms < LONGEST_NORM
            batch, x, norms = batch.filter(pa.array(ok)), x[ok], norms[ok]
            angles = angles_to(x, norms, references)
            cell = angles.argmin(axis=1)
            packed = lambda a, t: pa.array([r.tobytes() for r in a.astype(t)], pa.binary())
            label = batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), packed(x, "<f8"), packed(angles, "<f8"), packed(norms[:, None], "<f8"), packed(label[:, None], "<i8")],
                names=["n", "id", "cell", "vec", "angles", "norm", "label"],
            )

    index, index_path = table(held.mapInArrow(measured, "n long, id long, cell int, vec binary, angles binary, norm binary, label binary"), "angle-index")
    sizes = {r["cell"]: r["count"] for r in index.groupBy("cell").count().collect()}  # a row for each reference at most
    total = sum(sizes.values())
    most = max(1, min(PART_ROWS, max(LEAST_ROWS, -(-total // shuffle_width(spark)))))
    first, blocks = {}, {}
    for cell in sorted(sizes):
        first[cell], blocks[cell] = sum(blocks.values()), -(-sizes[cell] // most)
    lookup = lambda d: F.element_at(F.create_map(*[F.lit(int(x)) for kv in d.items() for x in kv]), F.col("cell"))
    parts = sum(blocks.values())
    if not parts:
        return spark.createDataFrame([], out_schema)
    dealt = index.withColumn("p", (lookup(first) + F.pmod(F.xxhash64("n"), lookup(blocks))).cast("int")).withColumn("windows", F.lit(b""))
    anchors = index.where(F.col("id") % every == 0)
    both = lambda a, b: F.unhex(F.concat(*[_little_endian(x) for x in (a, b)]))

    # all scores are wanted at first
    everything = anchors.withColumn("windows", both(F.lit(-(2**63) + 1), F.lit(2**63 - 1)))
    mine = _ranked(stream_parts(dealt, everything, parts, COLUMNS, _search(True, positives), QUERY_BLOCK, "long"), ["query_n"], positives)
    found, found_path = table(mine.select("query_n", "query_id", "n", "id", "score"), "positives")
    # scores of a positive's negatives: from percent hundredths of its own, rounded up, without overflow
    lower = F.col("score") - F.expr(f"score div 100 * {100 - percent} + score % 100 * {100 - percent} div 100")
    wanted = found.where("score >= 0").groupBy("query_n").agg(F.sort_array(F.collect_set(F.struct(lower.alias("lo"), F.col("score").alias("hi")))).alias("w"))
    # an anchor has at most ``positives`` windows; all get that many places, the last one repeated
    window = lambda i: F.coalesce(F.get("w", F.lit(i)), F.element_at("w", -1))
    places = F.concat(*[both(window(i)["lo"], window(i)["hi"]) for i in range(positives)])
    asking = anchors.join(wanted.select("query_n", places.alias("windows")), F.col("n") == F.col("query_n")).drop("query_n")
    others = _flat(stream_parts(dealt, asking, parts, COLUMNS, _search(False, k), QUERY_BLOCK, "long"))
    pairs = found.where("score >= 0").select("query_n", F.col("query_id").alias("anchor_id"), F.col("n").alias("positive_n"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), lower.alias("lower"))
    meeting = pairs.join(others.select("query_n", "n", "id", "score"), "query_n").where(F.col("score").between(F.col("lower"), F.col("positive_score")))
    order = Window.partitionBy("query_n", "positive_n").orderBy(F.desc("score"), "id", "n")
    ranked = meeting.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out, _ = table(ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives")
    forget(spark, [path, index_path, found_path])
    return out


def _little_endian(c) -> object:
    """A long as 16 hexadecimal digits, lowest byte first."""
    digits = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])


def _flat(found: DataFrame) -> DataFrame:
    each = found.select("query_n", "query_id", F.explode(F.arrays_zip("scores", "ns", "ids")).alias("g"))
    return each.select("query_n", "query_id", F.col("g.ns").alias("n"), F.col("g.ids").alias("id"), F.col("g.scores").alias("score"))


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "n")
    return _flat(found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
