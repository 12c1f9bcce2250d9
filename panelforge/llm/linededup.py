r"""Line deduplication across documents, with DataFrame functions only.

Lines are keyed by two 64-bit hashes. The table of long lines (hashes, document, position; no text) is
dealt by range of hash and document salt and sorted by document and position, so each task streams
through the occurrences of a hash, largest document first, and passes on one row for each document.
The salt splits a line that a third of all documents hold, here and where the occurrences meet their keeper.
Pre-aggregated counts of these rows tell which keys are frequent and which document keeps them. The result is, for each document that loses
lines, a bitmap of its lines in run-length form; texts are read again only to apply it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SALTS, forget, free_name, shuffle_width, table

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def _row_key(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; ``lower`` does just that where all characters are ASCII."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _runs(positions: Column) -> Column:
    """Sorted positions to runs (start, length)."""
    n = F.size(positions)
    starts = F.filter(positions, lambda x, i: (i == 0) | (F.get(positions, i - 1) != x - 1))
    ends = F.filter(positions, lambda x, i: (i == n - 1) | (F.get(positions, i + 1) != x + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    r"""Which lines each document loses: ``key`` (id and text hash), ``dropped`` (runs of zeros of its keep bitmap).

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at
    least ``min_chars`` characters that at least ``min_docs`` documents hold lose all their lines but
    those in the largest id. Documents that keep all lines have no row.

    Null texts are one empty line. A null id takes no part: it keeps its lines and does not count.
    Rows that repeat an id count as one document; equal rows get equal bitmaps. An empty table gives
    an empty result; other columns are ignored.
    """
    spark, text = docs.sparkSession, F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull()).select(_row_key(id_col, text_col).alias("key"), _lines(_lowered(text)).alias("lines"))
    exploded = rows.select("key", F.posexplode("lines").alias("pos", "line")).select("key", "pos", F.btrim("line", F.lit(SPACE)).alias("line"))
    long = exploded.where(F.char_length("line") >= min_chars)
    hashed = long.select("key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    seen, seen_path = table(hashed, "line-hashes")
    salt = F.pmod(F.xxhash64("key.id"), F.lit(SALTS)).alias("salt")
    dealt = seen.select("h1", "h2", F.col("key.id").alias("id"), "pos", salt).repartitionByRange(shuffle_width(spark), "h1", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("id").desc(), "pos")
    before = F.lag("id").over(stream)
    firsts = dealt.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("id")))
    parts = firsts.groupBy("h1", "h2", "salt").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    whole = Window.partitionBy("h1", "h2")  # at most a row for each salt
    totals = parts.select("h1", "h2", "salt", F.sum("n").over(whole).alias("n_docs"), F.max("most").over(whole).alias("keeper"))
    kept, kept_path = table(totals.where(F.col("n_docs") >= min_docs).drop("n_docs"), "line-keepers")
    lost = seen.withColumn("salt", salt).join(kept, ["h1", "h2", "salt"]).where(F.col("key.id") != F.col("keeper"))
    by_doc = lost.groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    out, _ = table(by_doc.select("key", _runs(F.col("positions")).alias("dropped")), "line-bitmaps")
    forget(spark, [seen_path, kept_path])
    return out


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the kept text, and ``n_lines`` and ``n_dropped`` as further columns.

    A text that loses nothing stays as it is, null included. The bitmaps grow with the input, so
    they are joined by shuffling at every size. Columns of ``docs`` keep their names; where one is named
    ``n_lines`` or ``n_dropped`` already, the new column has ``_`` behind its name.
    """
    # the columns of docs travel under numbers, so no name of theirs can clash
    text_at = docs.columns.index(text_col)
    own = docs.select(_row_key(id_col, text_col).alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    text = F.col(f"c{text_at}")
    counted = own.join(bitmaps.select("key", "dropped").hint("merge"), "key", "left").withColumn("lines", _lines(text.cast("string")))
    lost = F.flatten(F.transform("dropped", lambda r: F.sequence(r["start"], r["start"] + r["length"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost)
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    n_dropped = F.coalesce(F.aggregate("dropped", F.lit(0), lambda n, r: n + r["length"]), F.lit(0))
    changed = F.when(F.col("dropped").isNull(), text).otherwise(kept)
    return counted.select(
        *[(changed if i == text_at else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)],
        F.size("lines").cast("long").alias(free_name("n_lines", docs.columns)),
        n_dropped.cast("long").alias(free_name("n_dropped", docs.columns)),
    )
