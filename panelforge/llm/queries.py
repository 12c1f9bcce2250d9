"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, alignment, bpe, chat, linededup, minhash, mixing, negatives, packing, pivots, shards, tokenfiles, toxicity, warc
from .common import forget, shared_path, table

#: Writer's options for a table that is large, written once and read twice.
DENSE = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
#: Of the chain, in this order.
CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), CATEGORIES)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path).where("gap is null")
    return records.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(encoded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times")


def op7_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(_table(spark, sf_dir, "embeddings"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    kinds = {f.name: f.dataType for f in rows.schema}
    probe = spark.range(0, 2, 1, 1).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), role.alias("role"), text.alias("text"))
    chats = chat.format_chats(rows.unionByName(probe))
    back = chats.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("trained", chat.trained_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.top_products(_table(spark, sf_dir, "embeddings"))


def op10_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents")
    # encoded once, read for the counts and for the sequences
    ids, ids_path = table(bpe.encode_whole(docs, ranks, public_tokenizers.PATTERN, width=2).select("doc_id", "ids"), "token-ids", DENSE)
    layout = shards.materialise(ids, shared_path(spark, "shards"), text_col="ids", width=2)
    forget(spark, [ids_path])
    return shards.read_shards(spark, layout).select("slot", "shard", "doc_id", "start", "n_docs", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"))


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bin_count")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = alignment.align(_table(spark, sf_dir, "documents"), a, public_tokenizers.PATTERN, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    sizes = (tokenfiles.byte_level(a, public_tokenizers.PATTERN, False).size, tokenfiles.sentence_pieces(b).size)
    scored = alignment.score_links(aligned.withColumn("groups_sha256", digest).drop("groups"), *sizes)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_line_dedup,
        op3_warc_salvage,
        op4_minhash_near_dedup,
        op5_byte_bpe,
        op6_pareto_mix,
        op7_additive_ann,
        op8_chat_format,
        op9_pivot_topk,
        op10_training_shards,
        op11_harmonic_packing,
        op12_token_alignment,
        op13_hard_negatives,
    )
}

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM lines),
frequent AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.keeper IS NOT NULL AND f.keeper <> doc_id AS dropped FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

_BITS = "(ascii(substr(bits, i * 5 + 1, 1)) - 48) * 16 + (ascii(substr(bits, i * 5 + 2, 1)) - 48) * 8 + (ascii(substr(bits, i * 5 + 3, 1)) - 48) * 4 + (ascii(substr(bits, i * 5 + 4, 1)) - 48) * 2 + ascii(substr(bits, i * 5 + 5, 1)) - 48"
_NIBBLES = str([f"{k:04b}" for k in range(16)])
_PAGES = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS hex FROM payloads),
spelled AS (SELECT *, array_to_string(list_transform(range(40), lambda i: ({_NIBBLES})[instr('0123456789abcdef', substr(hex, i + 1, 1))]), '') AS bits FROM firsts)
SELECT page_id, strlen(payload) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', {_BITS} + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM spelled"""

_NEAR = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words),
sized AS (SELECT doc_id, len(s) AS n, s FROM sets),
shingles AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, d.n AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM sized d LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""


def _chat_sql() -> str:
    t = chat.Template()
    patterns = [f"{c[0] if c[0] != '[' else chr(92) + '['}~*{''.join(chr(92) + x if x in '|[]' else x for x in c[1:])}" for c in t.controls]
    marks = lambda c: " + ".join(f"len(regexp_extract_all({c}, '{p}'))" for p in patterns)
    fixed = len(t.turn) + len(t.text) + len(t.end)
    return f"""
WITH probe(conv_id, turn, role, text) AS (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM probe))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + length(role) + length(text) + {marks("role")} + {marks("text")}) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ',' ORDER BY turn, role, text), '(system,)?user,assistant(,user,assistant)*') AS valid
FROM turns GROUP BY conv_id"""


_PRODUCTS = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.n AS qn, q.vec_id AS query_id, x.vec_id, x.n, CAST(list_inner_product(q.e, x.e) AS BIGINT) AS score FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.n <> x.n)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id, n) AS rank FROM scored) WHERE rank <= 10"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS n, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.n AS an, a.vec_id AS anchor_id, x.n, x.vec_id, a.label = x.label AS same, CAST(list_inner_product(a.e, x.e) AS BIGINT) AS score FROM v a JOIN v x ON a.vec_id % 100 = 0 AND a.n <> x.n),
positives AS (SELECT an, anchor_id, n AS pn, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY an ORDER BY score DESC, vec_id, n) AS r FROM scored WHERE same) WHERE r <= 5),
found AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.an, pn ORDER BY score DESC, vec_id, s.n) AS r
  FROM positives p JOIN scored s ON s.an = p.an AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE r <= 5"""

#: The same results in DuckDB SQL, where it can express them.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": _LINES,
    "op3_warc_salvage": _PAGES,
    "op4_minhash_near_dedup": _NEAR,
    "op8_chat_format": _chat_sql(),
    "op9_pivot_topk": _PRODUCTS,
    "op13_hard_negatives": _NEGATIVES,
}
