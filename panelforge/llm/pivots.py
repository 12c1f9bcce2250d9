"""Exact top-k inner products by pivot-table elimination.

Vectors are integers. One more component lifts all rows onto a sphere, so a larger inner product is a
smaller Euclidean distance. Distances of every row to a few pivots are computed once and stored. For
a query, the largest difference between its distance to a pivot and a row's is a lower bound of their
distance, hence an upper bound of the inner product. Rows are evaluated in the order of their
bounds until the next bound is below the k-th best score; the rest can't get in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table
from .vectors import products, sample_matrix, search_parts, valid_vectors

PIVOTS = 24
SAMPLE = 2048  # vectors from which pivots are chosen at most
PART_ROWS = 1 << 16  # rows (with their distances) that a task holds
QUERY_BLOCK = 256
STEP = 128  # rows evaluated at first; twice as many each time after


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``x`` far from each other: each next one maximises the distance to those before."""
    chosen = [int(np.argmax((x**2).sum(axis=1)))]
    far = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)):
        chosen.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _search(k: int, radius2: float, evaluated: Callable[[int, int], None] | None = None):
    """For ``search_parts``. ``radius2``: squared norm of the sphere. Bounds get slack for rounding, so elimination stays exact.

    ``evaluated`` is told how many rows of how many each query looked at.
    """

    def prepared(part: dict[str, np.ndarray]):
        x, far = part["vec"], np.ascontiguousarray(part["far"].T)

        def find(asked: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            q, out = asked["vec"], []
            q2 = (q**2).sum(axis=1)
            for j in range(len(q)):
                gap = np.abs(far[0] - asked["far"][j, 0])
                for p in range(1, len(far)):
                    np.maximum(gap, np.abs(far[p] - asked["far"][j, p]), out=gap)
                bound = (q2[j] + radius2 - gap**2) / 2 + 1e-9 * (radius2 + q2[j]) + 1
                n, i, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                rounds, left = 0, np.arange(len(x))
                while len(left):
                    # the next rows in the order of their bounds; the others are not put in order
                    step = min(len(left), STEP << min(rounds, 8))
                    first = np.argpartition(-bound[left], step - 1)[:step] if step < len(left) else np.arange(len(left))
                    at = left[first]
                    if len(s) >= k:
                        at = at[bound[at] >= s[-1]]
                        if not len(at):
                            break
                    rounds += 1
                    if evaluated:
                        evaluated(len(at), len(x) if rounds == 1 else 0)
                    at = at[part["n"][at] != asked["n"][j]]
                    n, i = np.concatenate([n, part["n"][at]]), np.concatenate([i, part["id"][at]])
                    s = np.concatenate([s, products(x[at], q[j])])
                    best = np.lexsort((n, i, -s))[:k]
                    n, i, s = n[best], i[best], s[best]
                    left = np.delete(left, first)
                    if len(s) >= k:  # what can't get in is never looked at again
                        left = left[bound[left] >= s[-1]]
                out.append((n, i, s))
            return out

        return find

    return prepared


def top_products(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """The ``k`` rows with the largest integer inner product for each query: query_id, rank, ``id_col``, score.

    A component x becomes floor(``scale`` * x). Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but the query's own; equal scores go by the smaller id.
    Vectors that are null, empty, of odd length or hold null or non-finite components take no part. Rows that
    repeat an id are rows of their own. With fewer rows than ``k`` all are returned; an empty table gives an
    empty result; other columns are ignored. Scores are exact; those beyond a long count as its largest value or that negated.
    Rows of a scaled length from 1e150 on take no part either.
    """
    spark = rows.sparkSession
    held, path = valid_vectors(rows, id_col, vector_col, zero=True)
    # doubles from 2^53 on are whole already, and floor() gives longs
    floor = lambda x: F.when(F.abs(x) < 2**53, F.floor(x).cast("double")).otherwise(x)
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    whole = held.withColumn("vec", F.transform("vec", lambda x: floor(x * scale))).where(square < 1e300)
    radius2 = whole.agg(F.max(square)).first()[0]
    if radius2 is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    sample = sample_matrix(whole, SAMPLE)

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(0, radius2 - (x**2).sum(axis=1)))[:, None]], axis=1)

    pivots = choose_pivots(lifted(sample), PIVOTS)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            as_row = np.sqrt(((lifted(x)[:, None, :] - pivots[None]) ** 2).sum(axis=2))
            flat = np.concatenate([x, np.zeros((len(x), 1))], axis=1)  # queries are not lifted
            as_query = np.sqrt(((flat[:, None, :] - pivots[None]) ** 2).sum(axis=2))
            raw = x.astype("<f8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array([r.tobytes() for r in a], pa.binary()) for a in (raw, as_row.astype("<f8"), as_query.astype("<f8"))]],
                names=["n", "id", "vec", "far", "as_query"],
            )

    index, index_path = table(whole.mapInArrow(distances, "n long, id long, vec binary, far binary, as_query binary"), "pivot-table")
    asked = index.where(F.col("id") % every == 0).select("n", "id", "vec", F.col("as_query").alias("far"))
    found = search_parts(index.select("n", "id", "vec", "far"), asked, {"vec": "<f8", "far": "<f8"}, _search(k, float(radius2)), PART_ROWS, QUERY_BLOCK, "long")
    each = found.select("query_n", "query_id", F.explode(F.arrays_zip("scores", "ns", "ids")).alias("g"))
    order = Window.partitionBy("query_n").orderBy(F.desc("score"), "id", "n")
    flat = each.select("query_n", "query_id", F.col("g.ns").alias("n"), F.col("g.ids").alias("id"), F.col("g.scores").alias("score"))
    ranked = flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out, _ = table(ranked.select("query_id", "rank", F.col("id").alias(id_col), "score"), "pivot-result")
    forget(spark, [path, index_path])
    return out
