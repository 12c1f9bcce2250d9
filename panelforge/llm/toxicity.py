"""Classifier chain for toxicity categories.

Categories are predicted one after the other. The model of a category is linear: hashed words that
occur in the document, and the probabilities of all categories before it. Later models are trained
on out-of-fold probabilities, so they learn from what a model says about documents it has not seen;
for new documents the earlier models trained on all folds give the probabilities.

Training uses at most ``sample`` labelled documents (those with the smallest hash of their id), one
fold model in each task. Scoring reads every text whole, where it lies, and moves only probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, small_batches, table, trimmed

BUCKETS = 1 << 18  # hashed words
SURE = 6.0  # standard deviations from which a word counts in full
SAMPLE = 10_000  # labelled documents that training uses at most
WORDS_KEPT = 300_000  # word buckets that a task remembers at most

_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


class Words:
    """Distinct hashed words of a text: runs of ASCII letters, digits and other than ASCII characters, A-Z lower-cased."""

    def __init__(self) -> None:
        self.seen: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        seen, words = self.seen, set((text or b"").translate(_SPLIT).split())
        if len(seen) > WORDS_KEPT:
            seen.clear()
        try:
            ids = [seen[w] for w in words]
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh32_intdigest(w) % BUCKETS
            ids = [seen[w] for w in words]
        return np.unique(np.array(ids, dtype=np.int32))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(docs: list[np.ndarray], dense: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-5) -> np.ndarray:
    """Logistic regression by accelerated gradient steps with a step for each weight.

    Columns are the ``BUCKETS`` hashed words, those of ``dense``, and the intercept. A word enters
    with the cube of its standardised excess of positive documents over ``SURE`` (1 at most), so words
    that a few documents of one kind have by chance weigh next to nothing, however many they are.
    """
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
    at = np.concatenate([*docs, np.empty(0, np.int32)]).astype(np.int64)
    row = np.repeat(np.arange(len(docs)), np.diff(starts))
    wide, n = dense.shape[1], max(1, len(docs))
    full = np.hstack([dense, np.ones((len(docs), 1))])
    used, local = np.unique(at, return_inverse=True)
    base = y.mean() if len(y) else 0.0
    expected = np.bincount(local, minlength=len(used)) * base
    excess = np.abs(np.bincount(local, weights=y[row], minlength=len(used)) - expected) / np.sqrt(expected * (1 - base) + 1)
    scale = np.minimum(1, excess / SURE) ** 3
    x = scale[local]
    across = np.bincount(row, weights=x, minlength=len(docs)) + full.sum(axis=1)  # bounds the curvature
    step = 1 / (0.25 / n * np.concatenate([np.bincount(local, weights=x * across[row], minlength=len(used)), full.T @ across]) + l2)
    w = v = np.zeros(len(used) + wide + 1)
    for k in range(1, rounds + 1):
        z = np.bincount(row, weights=x * v[local], minlength=len(docs)) + full @ v[len(used) :]
        e = (_logistic(z) - y) / n
        g = np.concatenate([np.bincount(local, weights=x * e[row], minlength=len(used)), e @ full]) + l2 * v
        new = v - step * g
        v, w = new + (k - 1) / (k + 2) * (new - w), new
    out = np.zeros(BUCKETS + wide + 1, np.float32)
    out[used], out[BUCKETS:] = w[: len(used)] * scale, w[len(used) :]
    return out


def score_linear(w: np.ndarray, docs: list[np.ndarray], dense: np.ndarray) -> np.ndarray:
    z = np.array([w[d].sum(dtype=np.float64) for d in docs]) if docs else np.empty(0)
    return _logistic(z + dense @ w[BUCKETS:-1] + w[-1])


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the probability from which counting rows as positive gives the best F1, held within 0.1 and 0.9."""
    if not len(p) or not y.sum():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + y.sum())
    f1[:-1][p[1:] == p[:-1]] = -1  # equal probabilities stay together
    k = int(np.argmax(f1))
    return float(np.clip((p[k] + (p[k + 1] if k + 1 < len(p) else 0)) / 2, 0.1, 0.9))  # few rows place it badly


def _hashed(text_at: int):
    """Replaces the text column by the packed hashed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Words()
        for batch in batches:
            words = pa.array([hashed(t.as_py()).tobytes() for t in batch.column(text_at).cast(pa.binary())], pa.binary())
            yield batch.set_column(text_at, "words", words)

    return run


def fit_chain(labelled: DataFrame, text_col: str, categories: Sequence[str], folds: int = 3) -> tuple[list[np.ndarray], list[float]]:
    """Each category's weights, trained on all rows, and its threshold, from a bounded table of texts and 0/1 columns.

    A threshold is the out-of-fold probability that gives the best F1 (0.5 if no row is positive).

    A null category counts as 0. An empty table gives zero weights, that is probabilities of 0.5.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(f"y{k}") for k, c in enumerate(categories)]
    key = F.xxhash64(text).alias("key")  # equal texts are in one fold
    fold = F.pmod(F.xxhash64(text, F.lit(1)), F.lit(folds)).cast("int").alias("fold")
    ys = ", ".join(f"y{k} int" for k in range(len(categories)))
    rows = labelled.select(text.alias("text"), key, fold, *flags)
    held, _ = table(rows.mapInArrow(trimmed(_hashed(0)), f"words binary, key long, fold int, {ys}"), "toxicity-sample")
    tasks = held.select("*", F.explode(F.array(*[F.lit(f) for f in range(-1, folds)])).alias("task"))  # -1: leaves nothing out
    chain: list[np.ndarray] = []
    thresholds: list[float] = []
    unseen: list[dict[int, float]] = []  # of each category so far: probabilities from models that did not see the text

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key"], kind="stable")  # sums in one order, so reruns agree
        docs = [np.frombuffer(d, np.int32) for d in pdf["words"]]
        dense = np.array([[p[k] for p in unseen] for k in pdf["key"]], dtype=float).reshape(len(pdf), len(unseen))
        task, y = int(pdf["task"].iloc[0]), pdf[f"y{len(unseen)}"].to_numpy(dtype=float)
        use = np.flatnonzero(pdf["fold"].to_numpy() != task)
        rest = np.flatnonzero(pdf["fold"].to_numpy() == task)
        w = fit_linear([docs[i] for i in use], dense[use], y[use])
        p = score_linear(w, [docs[i] for i in rest], dense[rest])
        return pd.DataFrame({"task": [task], "weights": [w.tobytes()], "keys": [pdf["key"].to_numpy()[rest]], "p": [p], "y": [y[rest]]})

    for k in range(len(categories)):
        out = tasks.groupBy("task").applyInPandas(fit, "task int, weights binary, keys array<long>, p array<double>, y array<double>").collect()
        whole = [np.frombuffer(r["weights"], np.float32) for r in out if r["task"] == -1]
        chain.append(whole[0] if whole else np.zeros(BUCKETS + k + 1, np.float32))
        thresholds.append(best_threshold(np.array([p for r in out for p in r["p"]]), np.array([y for r in out for y in r["y"]])))
        unseen.append({i: p for r in out for i, p in zip(r["keys"], r["p"], strict=True)})
    return chain, thresholds


def score_chain(docs: DataFrame, chain: Sequence[np.ndarray], categories: Sequence[str], text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``p_<category>`` for each, one row per row of ``docs``. Null and empty texts have no words.

    Kept columns keep their names; where one is named like a score, the score has ``_`` behind its name.
    """
    model = docs.sparkSession.sparkContext.broadcast([np.asarray(w) for w in chain])  # of a size that the number of categories fixes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, weights = Words(), model.value
        for batch in batches:
            words = [hashed(t.as_py()) for t in batch.column(0).cast(pa.binary())]
            dense = np.empty((len(words), len(weights)))
            for k, w in enumerate(weights):
                dense[:, k] = score_linear(w, words, dense[:, :k])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(dense[:, k]) for k in range(len(weights))]], names=names)

    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])
    names = [*[f"k{i}" for i in range(len(keep))], *[f"p{k}" for k in range(len(categories))]]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]]
    scored = rows.mapInArrow(trimmed(run), ", ".join([*kinds, *[f"p{k} double" for k in range(len(categories))]]))
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"p{k}").alias(free_name(f"p_{c}", keep)) for k, c in enumerate(categories)])


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: dict[str, str], sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts and category flags of at most ``sample`` labelled documents, those of the smallest hashes of their id."""
    flags = [F.expr(c).cast("int").alias(f"_c{k}") for k, c in enumerate(categories.values())]
    chosen = labels.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), *flags)
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", *[f"_c{k}" for k in range(len(flags))]).limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(chosen), "_id")  # at most ``sample`` rows of a few bytes
    # documents that repeat an id could exceed the bound
    return joined.orderBy(F.xxhash64("_id"), F.xxhash64("_text")).limit(sample).select(F.col("_text").alias("text"), *[F.col(f"_c{k}").alias(c) for k, c in enumerate(categories)])


def classify(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, str],
    target: str = "toxic",
    sample: int = SAMPLE,
    threshold: float | None = None,
    folds: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Chain probabilities of every document, and whether it counts as ``target``.

    ``categories`` maps names to SQL expressions over ``labels`` that give 0 or 1, in the order of the chain.
    Labels without a document and documents without a label are fine; null flags count as 0; null
    and empty texts have no words, so the intercepts decide. Rows that repeat an id are each scored.
    Columns named in ``keep`` come along (default: the id) under their names; where one is named like a column of the
    result, the latter has ``_`` behind its name. Without ``threshold`` the one with the best out-of-fold F1 decides,
    held within 0.1 and 0.9, as few rows place it badly. Without any label all probabilities are 0.5, and nothing
    counts as the target.
    """
    small_batches(docs.sparkSession)
    train = labelled_sample(docs, labels, categories, sample, id_col, text_col)
    chain, best = fit_chain(train, "text", list(categories), folds)
    kept = [id_col] if keep is None else list(keep)
    scored = score_chain(docs, chain, list(categories), text_col, kept)
    limit = best[list(categories).index(target)] if threshold is None else threshold
    return scored.withColumn(free_name(f"is_{target}", kept), F.col(free_name(f"p_{target}", kept)) > limit)
