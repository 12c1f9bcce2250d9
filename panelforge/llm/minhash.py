"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard links, connected components.

Plan
----
1. One pass over the texts (Arrow batches) gives each document its exact set size, a 128-bit
   fingerprint of the set and the band keys of its circulant MinHash signature. Two fixed random
   permutations serve all coordinates: the first places a shingle on a circle, the second, shifted
   by k places, ranks it for coordinate k.
2. Documents with equal sets form a class (pre-aggregated by fingerprint); only the smallest id of a
   class goes on, so thousands of copies cost one representative.
3. Every band bucket links its members to its most central one; pairs are made distinct and confirmed on
   full shingle sets. Buckets whose members the confirmed links already join need no more pairs.
   The documents of the other buckets are compared without loss by a prefix filter: two sets that
   are similar enough share one of their rarest shingles (among the first ``n - c + 1`` by frequency, if
   ``c`` is the least number they have in common), so only documents of different components
   that share such a shingle are confirmed.
   Heavily edited copies, whose rarest shingles are their own, cost nothing here, and no bucket has
   all its pairs made.
4. Components of the confirmed links label the representatives, classes label the copies.

The band count follows from the threshold so that a pair exactly on it is missed by all bands with a
probability below ``miss`` (1e-8 by default).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, shuffle_width, small_batches, table, trimmed, with_least
from .components import connected_components

CIRCLE = 1 << 20  # places of the circle on which the permutations act
WORDS_KEPT = 300_000  # word hashes that a task remembers at most


def band_count(threshold: float, rows: int, miss: float) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-(threshold**rows))))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text. Remembers word hashes up to a fixed number."""

    def __init__(self, words: int):
        self.words, self.seen = words, {}
        rng = np.random.default_rng(20)
        self.mul = rng.integers(1, 2**63, words + 1, dtype=np.uint64) | np.uint64(1)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(31))
        x *= self.mul[-1]
        return x ^ (x >> np.uint64(29))

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the white space \x20 \x09-\x0D
        if not words:
            return np.empty(0, np.uint64)
        seen = self.seen
        if len(seen) > WORDS_KEPT:
            seen.clear()
        try:
            ids = [seen[w] for w in words]
        except KeyError:
            for w in set(words):
                if w not in seen:
                    seen[w] = xxhash.xxh64_intdigest(w)
            ids = [seen[w] for w in words]
        h = np.array(ids, dtype=np.uint64)
        n = min(self.words, len(h))
        out = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            out = self._mixed(out + h[k : len(h) - n + 1 + k]) * self.mul[k]
        return np.unique(self._mixed(out))


class CirculantMinHash:
    """``bands`` keys of ``rows`` coordinates each; coordinate k uses the second permutation shifted by k."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.first = rng.permutation(CIRCLE).astype(np.uint32)
        second = rng.permutation(CIRCLE).astype(np.uint32)
        self.second = np.concatenate([second, second[: self.k]])
        self.mul = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(0, 2**63, bands, dtype=np.uint64)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """Signatures of non-empty sets, one row each."""
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        at = self.first[(np.concatenate(sets) & np.uint64(CIRCLE - 1)).astype(np.int64)].astype(np.int64)
        sig = np.empty((len(sets), self.k), np.uint32)
        for k in range(self.k):
            sig[:, k] = np.minimum.reduceat(self.second[k:].take(at), starts)
        return sig

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        sig = self.signatures(sets).reshape(len(sets), self.bands, self.rows).astype(np.uint64)
        key = np.tile(self.salt, (len(sets), 1))
        for r in range(self.rows):
            key = (key ^ sig[:, :, r]) * self.mul[r]
            key ^= key >> np.uint64(32)
        return key.view(np.int64)


def _features(words: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, minhash = Shingler(words), CirculantMinHash(bands, rows, seed)

        def flush(ids: list, hashes: list, sets: list) -> pa.RecordBatch:
            full = [s for s in sets if len(s)]
            keys = iter(minhash.keys(full) if full else ())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array(hashes, pa.int64()),
                ],
                names=["id", "n_shingles", "fingerprint", "bands", "text_hash"],
            )

        ids, hashes, sets, held = [], [], [], 0
        for batch in batches:
            for i, text, h in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                ids.append(i)
                hashes.append(h)
                sets.append(shingle(text.as_py()))
                held += len(sets[-1])
                if held > 400_000 or len(ids) >= 4000:
                    yield flush(ids, hashes, sets)
                    ids, hashes, sets, held = [], [], [], 0
        if ids:
            yield flush(ids, hashes, sets)

    return run


def _shingles(words: int):
    """Rows (id, component, text) to one row for each shingle of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            for i, c, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                s = shingle(text.as_py()).view(np.int64)
                same = lambda v, n=len(s): pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([same(i), same(c), same(len(s)), pa.array(s)], names=["id", "component", "n", "shingle"])

    return run


def _linked(words: int, percent: int):
    """Reads rows (leader, part, member, text) sorted so that a leader's own row (member null) comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, leader, own = Shingler(words), None, None
        for batch in batches:
            a, b = [], []
            cols = [batch.column(k).to_pylist() for k in range(3)]
            for lead, part, member, text in zip(*cols, batch.column(3).cast(pa.binary()), strict=True):
                if member is None:
                    leader, own = (lead, part), shingle(text.as_py())
                    continue
                if leader != (lead, part):
                    raise ValueError(f"no text for document {lead}")
                other = shingle(text.as_py())
                small, large = sorted((len(own), len(other)))
                if small * 100 < percent * large:
                    continue
                both = len(own) + len(other) - len(np.union1d(own, other))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    a.append(lead)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Members of one leader that one task compares, so that a leader of very many is spread.
PART = 512


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (leader, member) whose full sets are similar enough, as links (a, b)."""
    spark = pairs.sparkSession
    counts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / PART).alias("parts"))
    dealt = pairs.join(counts, "leader").select("leader", F.pmod(F.xxhash64("member"), "parts").alias("part"), "member")
    members = dealt.join(texts.withColumnRenamed("id", "member"), "member").select("leader", "part", "member", "text")
    leaders = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("id", "leader"), "leader")
    rows = members.unionByName(leaders.select("leader", "part", F.lit(None).cast("long").alias("member"), "text"))
    dealt_rows = rows.repartition(shuffle_width(spark), "leader", "part").sortWithinPartitions("leader", "part", F.col("member").asc_nulls_first())
    return dealt_rows.mapInArrow(trimmed(_linked(words, percent)), "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    rows: int = 4,
    miss: float = 1e-8,
    seed: int = 7,
) -> DataFrame:
    """Near-duplicate classes of ``docs``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a document's set is its
    distinct ``words``-word shingles (fewer words: the whole sequence). Two documents are linked if
    100 * intersection >= ``percent`` * union. Returns one row per input row: the id, ``n_shingles``,
    ``component_id`` (smallest id reachable over links), ``kept`` (the id is its component's id).

    Nulls and texts without words have an empty set, are linked with nothing and are kept. A null
    id gets a null component and is kept. Rows that repeat an id are one document; if their texts
    differ, the text of the smallest hash (among those with words) decides its links. An empty table
    gives an empty result. Further columns of ``docs`` are ignored.
    """
    spark = small_batches(docs.sparkSession)
    bands = band_count(percent / 100, rows, miss)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    run = _features(words, bands, rows, seed)
    hashed = source.select("id", "text", F.xxhash64("text").alias("text_hash"))
    feats, feat_path = table(hashed.mapInArrow(trimmed(run), "id long, n_shingles long, fingerprint binary, bands array<long>, text_hash long"), "minhash-features")
    full = feats.where("n_shingles > 0 and id is not null")
    repeats = full.groupBy("id").agg(F.count_distinct("text_hash").alias("texts"), F.min("text_hash").alias("valid_hash")).where("texts > 1")
    repeated, repeat_path = table(repeats.select("id", "valid_hash"), "minhash-repeats")
    one_text = lambda df: df
    if not repeated.isEmpty():
        one_text = lambda df: df.join(repeated, "id", "left").where("valid_hash is null or valid_hash = text_hash").drop("valid_hash")
        full = one_text(full)
    same = with_least(full.select("id", "fingerprint"), ["fingerprint"], "id").where("id <> least")
    copies, copy_path = table(same.select(F.col("id").alias("a"), F.col("least").alias("b")), "minhash-copies")
    reps = full.select("id", "n_shingles", "bands").join(copies.select(F.col("a").alias("id")), "id", "left_anti")
    exploded = reps.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("members")).where("least <> most")
    buckets, bucket_path = table(exploded.join(shared.select("bucket", "members"), "bucket").select("bucket", "id", "n_shingles", "members"), "minhash-buckets")
    # documents at the centre of a group share its fullest buckets; they make the best leaders
    central = buckets.groupBy("id").agg(F.sum("members").alias("central"))
    # a repeated id may have a text without words beside those with words, which alone decide its links
    worded = hashed.where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    texts_of = one_text(worded.join(buckets.select("id").distinct(), "id", "left_semi"))
    texts, text_path = table(texts_of.dropDuplicates(["id"]).select("id", "text"), "minhash-texts")

    paths = [repeat_path, copy_path, bucket_path, text_path, feat_path]

    def close_enough(x: str, y: str):
        return F.least(x, y) * 100 >= F.greatest(x, y) * percent

    def leader_pairs(member: DataFrame) -> DataFrame:
        ranked = member.join(central, "id")
        lead = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("central"), "id", "n_shingles")).alias("lead"))
        lead = lead.select("bucket", F.col("lead.id").alias("leader"), F.col("lead.n_shingles").alias("leader_n"))
        on = (member["bucket"] == lead["bucket"]) & (member["id"] != lead["leader"]) & close_enough("n_shingles", "leader_n")
        return member.join(lead, on).select("leader", F.col("id").alias("member")).distinct()

    def rare_pairs(member: DataFrame) -> DataFrame:
        """Pairs of open documents of different components that share a shingle of both prefixes."""
        open_, path = table(member.select("id", "component").distinct(), "minhash-open")
        paths.append(path)
        dealt = texts.join(open_, "id").select("id", "component", "text").repartition(shuffle_width(spark), "id")
        sets, path = table(dealt.mapInArrow(trimmed(_shingles(words)), "id long, component long, n long, shingle long"), "minhash-sets")
        paths.append(path)
        common = sets.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
        need = F.ceil(F.col("n") * percent / 100)  # shingles of its own that a document shares with any partner
        ranked = sets.join(common, "shingle").withColumn("shared", F.count("*").over(Window.partitionBy("id"))).where(F.col("shared") >= need)
        # shingles without partner come first in the order; they use up places of the prefix
        rank = F.row_number().over(Window.partitionBy("id").orderBy("df", "shingle")) + F.col("n") - F.col("shared")
        prefix, path = table(ranked.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - need + 1).select("shingle", "id", "component", "n", "rank"), "minhash-prefix")
        paths.append(path)
        x, y = prefix.alias("x"), prefix.alias("y")
        on = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
        # fewest common shingles of a similar pair; one of them comes early enough in both orders to leave room for the others
        common_least = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
        early = (F.col("x.rank") + common_least <= F.col("x.n") + 1) & (F.col("y.rank") + common_least <= F.col("y.n") + 1)
        return x.join(y, on & early & close_enough("x.n", "y.n")).select(F.col("x.id").alias("leader"), F.col("y.id").alias("member")).distinct()

    links, path = table(_confirm(leader_pairs(buckets), texts, words, percent), "minhash-links")
    components, where = connected_components(links)
    paths += [path, where]
    known = components.select(F.col("node").alias("id"), "component")
    member = buckets.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_ = member.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    more, path = table(_confirm(rare_pairs(member.join(open_, "bucket", "left_semi")), texts, words, percent), "minhash-links")
    paths.append(path)
    final, where = connected_components(copies.unionByName(links).unionByName(more))
    paths.append(where)
    final = final.select(F.col("node").alias("id"), "component")
    out, _ = table(
        feats.select("id", "n_shingles").join(final, "id", "left").withColumn("component_id", F.coalesce("component", "id")).select(
            F.col("id").alias(id_col), "n_shingles", "component_id", (F.col("id").isNull() | (F.col("component_id") == F.col("id"))).alias("kept")
        ),
        "minhash-classes",
    )
    forget(spark, [p for p in paths if p])
    return out
