"""Shared parts of the vector searches: rows that take part, and parts of the index against blocks of queries.

The index is dealt by hash into parts of bounded size. A part is a key like any other, so Spark shuffles and places
it; its rows come first and stay in memory, then all queries stream past in blocks. The index is copied
once, and the queries, a fiftieth or less of the rows, once for each part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, table

LEAST_ROWS = 4096  # of a part of the index, but for tables of fewer


def valid_vectors(df: DataFrame, id_col: str, vector_col: str, zero: bool, keep: Sequence[Column] = ()) -> tuple[DataFrame, str]:
    """``n`` (a number of the row's own), ``id`` and ``vec`` array<double> of the rows that take part, then ``keep``.

    Left out are null ids, null and empty vectors, vectors that hold null or non-finite components,
    vectors of another length than the most frequent one (ties: the smaller), and zero vectors
    unless ``zero``.
    """
    vec = F.col(vector_col).cast("array<double>")
    ok = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(F.col(id_col).isNotNull() & (F.size(vec) > 0) & ok).select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("id"), vec.alias("vec"), *keep)
    if not zero:
        rows = rows.where(F.exists("vec", lambda x: x != 0))
    held, path = table(rows, "vectors")
    common = held.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1)
    dim = common.collect()
    return held.where(F.size("vec") == (dim[0]["dim"] if dim else 0)), path


def sample_matrix(rows: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the smallest hashes of their rows, as a matrix on the driver."""
    got = rows.select("vec", F.xxhash64("id", "n").alias("h"), "n").orderBy("h", "n").limit(most).collect()
    return np.array([r["vec"] for r in got], dtype=float)


LONGEST = 2**63 - 1


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``q``, both whole numbers held as doubles: exact, but for those beyond a
    long, which are its largest value or that negated. No partial sum exceeds the product of the norms, which tells in which numbers to add."""
    reach = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
    if reach.max(initial=0) < 2**52:
        return (x @ q).astype(np.int64)
    out = np.empty(len(x), np.int64)
    small, large = reach < 2**52, reach >= 2**62
    out[small] = (x[small] @ q).astype(np.int64)
    middle = ~small & ~large
    if middle.any():
        out[middle] = x[middle].astype(np.int64) @ q.astype(np.int64)
    whole = [int(v) for v in q] if large.any() else []
    for i in np.flatnonzero(large).tolist():
        out[i] = max(-LONGEST, min(LONGEST, sum(int(v) * w for v, w in zip(x[i], whole, strict=True))))
    return out


def search_parts(index: DataFrame, queries: DataFrame, columns: dict[str, str], search: Callable, part_rows: int, block: int, score: str = "double", rows: int | None = None) -> DataFrame:
    """``stream_parts`` over an index dealt by hash into parts of about ``part_rows`` rows, or fewer (not below ``LEAST_ROWS``) if tasks would idle.
    ``rows``, if known, is how many the index has."""
    rows = index.count() if rows is None else rows
    parts = max(1, -(-rows // part_rows), min(shuffle_width(index.sparkSession), -(-rows // LEAST_ROWS)))
    return stream_parts(index.withColumn("p", F.pmod(F.xxhash64("n"), F.lit(parts)).cast("int")), queries, parts, columns, search, block, score)


def stream_parts(index: DataFrame, queries: DataFrame, parts: int, columns: dict[str, str], search: Callable, block: int, score: str) -> DataFrame:
    """Run ``search`` on every part of the index and every block of queries.

    ``index`` and ``queries`` have ``n``, ``id`` and the binary columns of fixed length named in ``columns`` (with their
    numpy types); ``index`` also has ``p``, the number of its part (0 to ``parts`` - 1). A part is copied to its task once; the queries
    go to every part. ``search(part)`` gets a part's arrays and returns a
    function from the arrays of at most ``block`` queries to (ns, ids, scores) of the best rows of each.
    Result: query_n, query_id, ns, ids, scores (of type ``score``); one row for each query and part.
    """
    names = list(columns)
    side = lambda df, part, kind: df.select(part.alias("p"), F.lit(kind).alias("kind"), "n", "id", *names)
    held = side(index, F.col("p"), 0)
    asked = side(queries, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), 1)
    dealt = held.unionByName(asked).repartitionById(parts, "p").sortWithinPartitions("p", "kind", "n")
    kind_of_score = pa.int64() if score == "long" else pa.float64()

    def arrays(batches: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
        out = {n: np.concatenate([b.column(n).to_numpy() for b in batches]) for n in ("n", "id")}
        for name, kind in columns.items():
            raw = b"".join(x for b in batches for x in b.column(name).to_pylist())
            out[name] = np.frombuffer(raw, kind).reshape(len(out["n"]), -1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, find = None, [], None
        for batch in batches:
            p, kind = batch.column("p").to_numpy(), batch.column("kind").to_numpy()
            turns = [0, *(np.flatnonzero((np.diff(p) != 0) | (np.diff(kind) != 0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(turns, turns[1:], strict=False):
                if lo == hi:
                    continue
                if p[lo] != part:
                    part, rows, find = p[lo], [], None
                if kind[lo] == 0:
                    rows.append(batch.slice(lo, hi - lo))
                    continue
                if find is None:
                    if not rows:
                        continue
                    find, rows = search(arrays(rows)), rows[:1]  # the arrays hold what the batches held
                for at in range(lo, hi, block):
                    q = arrays([batch.slice(at, min(block, hi - at))])
                    ns, ids, scores = zip(*find(q), strict=True)
                    lists = lambda xs, t: pa.array([np.asarray(x).tolist() for x in xs], pa.list_(t))
                    yield pa.RecordBatch.from_arrays([pa.array(q["n"]), pa.array(q["id"]), lists(ns, pa.int64()), lists(ids, pa.int64()), lists(scores, kind_of_score)], names=["query_n", "query_id", "ns", "ids", "scores"])

    return dealt.mapInArrow(run, f"query_n long, query_id long, ns array<long>, ids array<long>, scores array<{score}>")
