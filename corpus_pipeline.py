"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

toxicity drops the documents that the classifier chain rejects; line_dedup takes lines that many documents
share out of all but one; minhash keeps one document of each near-duplicate group; mix repeats or
leaves out documents so that sources meet their target weights; bpe encodes what is left.

All stages but the last return the columns of their input, whatever these are named. Null texts are empty. Rows that
repeat an id, and rows without one, stay rows of their own unless a stage says otherwise. An empty
table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bpe, linededup, minhash, mixing, toxicity
from panelforge.llm.common import clear, free_name, made, shared_path
from panelforge.llm.queries import CATEGORIES


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the chain does not reject. Without labels nothing is rejected."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.classify(docs, labels, CATEGORIES, keep=docs.columns)
    return _columns(scored.where(~F.col(free_name("is_toxic", docs.columns))), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that other documents keep. Rows without an id keep theirs; n_chars (0 for null) follows the text."""
    kept = _columns(linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)), docs)
    return kept.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest id of each group (words of 5, similarity 0.8). Rows without an id or without words all stay."""
    found = minhash.near_duplicates(docs, words=5, percent=80)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    return _columns(docs.join(gone.hint("merge"), "doc_id", "left_anti"), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it; a null source is one of its own. Rows without words come as often as their source's certain copies."""
    return mixing.repeat_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, the number of token ids, and the digests of the ids and of the bytes that they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("minhash", drop_near_duplicates), ("mix", mix_sources), ("bpe", encode)]

#: SQL has neither the classifier nor the tokenizer; the stages are tested one by one instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage leaves in the shared folder is deleted once the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        clear(spark, [*before, path])
    return docs
