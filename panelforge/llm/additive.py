"""Approximate nearest neighbours by additive quantisation.

A unit vector is approximated by the sum of one entry from each of several codebooks of full
dimension. Each codebook is a k-means of what those before it leave over, on a bounded sample. Encoding
is a beam search: the best few partial sums are kept after each codebook. The index stores a byte per codebook and the norm of the sum, so a row's distance to a
query is read from the query's table of inner products with all entries. Equal vectors are one row of
the index, with the smallest ids of those that have it. The best rows by that score are ranked again
by the exact cosine of the original vectors, each for all of its ids.

How far a sum lies from its row depends on the data, so no fixed number of best rows is enough. The index also stores
the angle between them: by the triangle inequality, angle(query, sum) <= angle(query, row) + angle(row, sum). What that
leaves below the cosines already reached is dropped; every other row is scored exactly. Nothing is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, table
from .vectors import sample_matrix, search_parts, valid_vectors

BOOKS, ENTRIES, BEAM = 32, 256, 4
SAMPLE = 8192  # vectors that fit the codebooks at most
SHORTLIST = 192
PART_ROWS = 1 << 18  # index rows that a task holds at most
PART_BYTES = 64 << 20  # of their vectors
SCANNED = 4096  # index rows scored at once
CELLS = 1 << 22  # numbers of a working array
QUERY_BLOCK = 256


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ centres.T - 0.5 * (centres**2).sum(axis=1), axis=1)
        counts = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def fit_codebooks(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, seed: int = 5) -> np.ndarray:
    """Residual codebooks (books, entries, dim) for the unit vectors ``x``."""
    rng, residual = np.random.default_rng(seed), x.astype(np.float32)
    out = np.zeros((books, entries, x.shape[1]), np.float32)
    for m in range(books):
        out[m] = _k_means(residual, entries, rng)
        residual = residual - out[m][np.argmax(residual @ out[m].T - 0.5 * (out[m] ** 2).sum(axis=1), axis=1)]
    return out


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint8) of each row and the squared norms of the sums they stand for."""
    n, dim = x.shape
    books = books.astype(np.float32)
    residual = x[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books:
        entries = len(book)
        cost = (residual**2).sum(axis=2)[:, :, None] - 2 * (residual @ book.T) + (book**2).sum(axis=1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        parent, entry = best // entries, best % entries
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None].repeat(codes.shape[2], axis=2), axis=1), entry[:, :, None].astype(np.uint8)], axis=2)
        residual = np.take_along_axis(residual, parent[:, :, None].repeat(dim, axis=2), axis=1) - book[entry]
    first = np.argmin((residual**2).sum(axis=2), axis=1)
    rows = np.arange(n)
    sums = x - residual[rows, first]
    return codes[rows, first], (sums**2).sum(axis=1)


def _fit(units: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The length of each sum along its unit vector and across it."""
    sums = np.zeros_like(units)
    for m, book in enumerate(books):
        sums += book[codes[:, m]]
    along = (sums * units).sum(axis=1)
    return np.stack([along, np.sqrt(((sums - along[:, None] * units) ** 2).sum(axis=1))], axis=1)


def _possible(inner: np.ndarray, floor: np.ndarray, fit: np.ndarray, slack: float) -> np.ndarray:
    """Which rows (columns) may have a cosine of ``floor`` or more with each query, by the inner products of the queries with the
    rows' sums. With angles f (of the floor) and r (from row to sum): those whose sum is within f + r of the query."""
    along, across = fit.T
    cos = np.clip(floor, -1, 1)
    turn = np.stack([cos, -np.sqrt(1 - cos**2)], axis=1).astype(np.float32)
    out = inner >= turn @ fit.T - np.float32(slack)
    if cos.min() < 0 or along.min() < 0:  # f + r may be more than half a turn, and then holds for all
        out |= along + turn[:, :1] * np.hypot(along, across) < slack
    return out


def _search(books: np.ndarray, keep: int, shortlist: int):
    """For ``search_parts``: the ``keep`` rows of a part of largest cosine, equal ones by id and n.

    The ``shortlist`` best by 2 q.x - |x|^2, x the sum that a row's codes stand for, tell a cosine that ``keep`` rows reach;
    all rows that may reach it too are scored. The last digits are those of Spark's sums, which run from the first component to the last.
    """
    dim = books.shape[2]
    # rounding of table entries and of their sums in single precision, and of cosines in double precision
    slack = float(np.finfo(np.float32).eps * (dim + len(books) + 8) * (1 + np.linalg.norm(books, axis=2).max(axis=1).sum()))
    margin = 1e-15 * (dim + 8)

    def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        rows = max(1, CELLS // dim)
        return np.concatenate([np.cumsum(a[lo : lo + rows] * b[lo : lo + rows], axis=1)[:, -1] for lo in range(0, max(1, len(a)), rows)])

    def prepared(part: dict[str, np.ndarray]):
        n, ids, codes, x, fit = part["n"], part["id"], part["codes"], part["vec"], part["fit"]
        length = np.sqrt(in_order(x, x))
        halved = ((fit.astype(float) ** 2).sum(axis=1) / 2).astype(np.float32)

        def some(q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            q_length = np.sqrt(in_order(q, q))
            lookup = np.ascontiguousarray(np.einsum("med,qd->meq", books, _units(q).astype(np.float32), optimize=True))
            inner = np.empty((len(q), len(n)), np.float32)
            for lo in range(0, len(n), SCANNED):
                sums = np.zeros((len(n[lo : lo + SCANNED]), len(q)), np.float32)
                for m in range(len(books)):
                    sums += lookup[m][codes[lo : lo + SCANNED, m]]  # whole rows of the table, so in the order of memory
                inner[:, lo : lo + SCANNED] = sums.T
            floor = np.full(len(q), -np.inf)
            if len(n) > keep:
                most = min(max(shortlist, keep), len(n))
                for i, row in enumerate(inner):
                    first = np.argpartition(halved - row, most - 1)[:most]
                    floor[i] = np.partition(x[first] @ q[i] / (length[first] * q_length[i]), most - keep)[most - keep] - margin
            may = _possible(inner, floor, fit, slack)
            rows = np.flatnonzero(may.any(axis=0))
            top = np.full((len(q), keep), -np.inf)
            best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
            for lo in range(0, len(rows), SCANNED):
                here = rows[lo : lo + SCANNED]
                cos = np.where(may[:, here], q @ x[here].T / (q_length[:, None] * length[here]), -np.inf)
                top = np.partition(np.concatenate([top, cos], axis=1), -keep, axis=1)[:, -keep:]
                floor = np.maximum(floor, top[:, 0] - margin)
                at, hit = np.nonzero((cos >= floor[:, None]) & may[:, here])
                for cut in range(0, len(at), max(1, CELLS // dim)):
                    of, row = at[cut : cut + max(1, CELLS // dim)], here[hit[cut : cut + max(1, CELLS // dim)]]
                    score = in_order(q[of], x[row]) / (q_length[of] * length[row])
                    of, row, score = (np.concatenate(pair) for pair in zip(best, (of, row, score), strict=True))
                    order = np.lexsort((n[row], ids[row], -score, of))
                    of, row, score = of[order], row[order], score[order]
                    among = np.arange(len(of)) - np.searchsorted(of, of) < keep
                    best = of[among], row[among], score[among]
            ends = np.searchsorted(best[0], np.arange(len(q) + 1))
            return [(n[best[1][lo:hi]], ids[best[1][lo:hi]], best[2][lo:hi]) for lo, hi in zip(ends, ends[1:], strict=False)]

        def find(asked: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            step = max(1, CELLS // len(n))
            return [got for lo in range(0, len(asked["vec"]), step) for got in some(asked["vec"][lo : lo + step])]

        return find

    return prepared


def _scaled(vec: Column) -> Column:
    """``vec``, if its components are so large or small that their squares could overflow or vanish times the power of two
    that brings the largest near 1, which is exact. In two factors, as the power itself may be out of range."""
    largest = F.array_max(F.transform(vec, F.abs))
    power = -F.floor(F.log2(largest))
    half = F.floor(power / 2)
    return F.when(largest.between(1e-100, 1e100), vec).otherwise(F.transform(vec, lambda x: x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)))


def nearest(
    rows: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    shortlist: int = SHORTLIST,
    sample: int = SAMPLE,
) -> DataFrame:
    """The ``k`` rows of largest cosine for each query: query_id, rank, ``id_col``, score.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's
    own. Scores are exact, and equal ones go by the smaller id. Vectors that are null, zero, of odd length or hold
    null or non-finite components take no part. Rows that repeat an id are rows of their own, as
    queries and as candidates. With fewer rows than ``k`` all are returned; an empty table gives an empty
    result; other columns are ignored. Components may be as small or large as a double can be. Codebooks are fit on at
    most ``sample`` vectors; every vector is indexed, equal ones once. In each part of the index the ``shortlist`` vectors of best
    codes, besides the query's own, are scored first; then all that their codes do not exclude.
    """
    spark = rows.sparkSession
    valid, valid_path = valid_vectors(rows, id_col, vector_col, zero=False)
    schema = f"query_id long, rank int, {id_col} long, score double"
    # equal vectors tie, so the k + 1 smallest ids (one may be the query's own) are all that can be among the k best
    first = Window.partitionBy("h", "vec").orderBy("id", "n")
    few = valid.withColumn("h", F.xxhash64("vec")).withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1)
    members = few.groupBy("h", "vec").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("members"))
    classes, classes_path = table(members.select(F.col("members")[0]["n"].alias("n"), F.col("members")[0]["id"].alias("id"), "vec", "members"), "additive-classes")
    x = sample_matrix(classes, sample)
    if not len(x):
        return spark.createDataFrame([], schema)
    books = fit_codebooks(_units(x))
    model = spark.sparkContext.broadcast(books)  # BOOKS * ENTRIES * dim numbers, whatever the input

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vec = np.array(batch.column(2).flatten()).reshape(batch.num_rows, -1)
            units = _units(vec)
            codes = np.concatenate([encode(units[k : k + 500], model.value)[0] for k in range(0, len(units), 500)])
            fits = _fit(units, codes, model.value).astype("<f4")
            raw = [pa.array([v.tobytes() for v in side], pa.binary()) for side in (codes, fits, vec.astype("<f8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *raw], names=["n", "id", "codes", "fit", "vec"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<f8").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(raw, pa.binary())], names=["n", "id", "vec"])

    # encoded on the way to their parts; rows carry their codes and vector, queries their vector
    scaled = ("n", "id", _scaled(F.col("vec")).alias("vec"))
    held = classes.select(*scaled).mapInArrow(encoded, "n long, id long, codes binary, fit binary, vec binary")
    is_query = F.col("id") % every == 0
    none = F.lit(b"")
    asked = valid.where(is_query).select(*scaled).mapInArrow(packed, "n long, id long, vec binary").select("n", "id", none.alias("codes"), none.alias("fit"), "vec")
    part_rows = max(1, min(PART_ROWS, PART_BYTES // (8 * books.shape[2])))
    kinds = {"codes": "u1", "fit": "<f4", "vec": "<f8"}
    found = search_parts(held, asked, kinds, _search(books, k + 1, shortlist + 1), part_rows, QUERY_BLOCK, rows=classes.count())
    # of each part k + 1 vectors, of all parts again
    best = Window.partitionBy("query_n").orderBy(F.desc("g.scores"), "g.ids", "g.ns")
    each = found.select("query_n", "query_id", F.explode(F.arrays_zip("scores", "ns", "ids")).alias("g"))
    short = each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    short, short_path = table(short.select("query_n", "query_id", F.col("g.ns").alias("n")), "additive-shortlist")
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    left = valid.where(is_query).select(F.col("n").alias("query_n"), _scaled(F.col("vec")).alias("a")).withColumn("length_a", F.sqrt(dot("a", "a")))
    right = classes.select("n", _scaled(F.col("vec")).alias("b"), "members").withColumn("length_b", F.sqrt(dot("b", "b")))
    both = short.join(left, "query_n").join(right, "n")
    score = dot("a", "b") / (F.col("length_a") * F.col("length_b"))
    order = Window.partitionBy("query_n").orderBy(F.desc("score"), "id", "n")
    every_id = both.select("query_n", "query_id", score.alias("score"), F.explode("members").alias("m")).select("query_n", "query_id", "score", "m.id", "m.n")
    ranked = every_id.where("n <> query_n").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out, _ = table(ranked.select("query_id", "rank", F.col("id").alias(id_col), "score"), "additive-result")
    forget(spark, [valid_path, classes_path, short_path])
    return out
