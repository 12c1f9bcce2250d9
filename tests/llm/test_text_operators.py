"""Operators on texts against brute force, with null, empty, repeated and odd rows."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelforge.llm import bpe, chat, linededup, minhash, mixing, queries, shards, toxicity

DOCS = "doc_id long, text string, source string, id string, key string, row int"


def frame(spark, rows):
    """Rows (id, text, source) with further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], DOCS)


def texts(seed=1, n=40, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary) for _ in range(words)) for _ in range(n)]


# ---- near duplicates


def brute_components(rows, words, percent):
    sets = []
    for i, t, _ in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets.append((i, frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [(i, len(s), find(i)) for i, s in sets]


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, words, percent):
    rng = random.Random(7)
    base = texts()
    rows = [(i, t, "a") for i, t in enumerate(base)]
    edited = []
    for k in range(160):  # copies of one text with more and more edits, and copies of copies
        t = (base[3] if k % 2 else rng.choice(edited or [base[3]])).split()
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = f"edit{rng.randint(0, 99)}"
        edited.append(" ".join(t))
        rows.append((1000 + k, edited[-1], "a"))
    rows += [(2000, None, None), (2001, "", "b"), (2002, " \n\t", "b"), (2003, "One", "b"), (2004, "one", "b"), (2005, "é É", "b"), (2006, "É É", "b"), (1, base[1], "a"), (2007, base[5].upper(), "c")]
    rows.append((2008, " ".join(base) * 3, "a"))
    got = minhash.near_duplicates(frame(spark, rows), words=words, percent=percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, words, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_an_id_with_two_texts_has_the_links_of_one(spark):
    a, b = texts(3, 2)
    got = minhash.near_duplicates(frame(spark, [(1, a, "s"), (2, b, "s"), (3, a, "s"), (3, b, "s"), (4, "", "s"), (4, a, "s")])).collect()
    assert len(got) == 6
    of = {(r.doc_id, r.component_id) for r in got}
    assert of in ({(1, 1), (2, 2), (3, 1), (4, 1)}, {(1, 1), (2, 2), (3, 2), (4, 1)})


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(frame(spark, [(None, "a b c", None)])).collect()] == [(None, 1, None, True)]


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1600], rng.integers(0, 2**63, 400, dtype=np.uint64)])
    sig = minhash.CirculantMinHash(64, 4, 1).signatures([np.unique(a), np.unique(b)])
    assert abs((sig[0] == sig[1]).mean() - 1600 / 2400) < 0.08


def test_bands_miss_almost_nothing():
    for t in (0.8, 0.85):
        assert (1 - t**4) ** minhash.band_count(t, 4, 1e-8) <= 1e-8


# ---- line dedup


def test_line_dedup_matches_brute_force(spark):
    shared = "This is a line that is long enough to be counted, really"
    rows = [(i, f"own line of document number {i} which is long enough too\n  {shared.upper() if i % 2 else shared}\t\nshort\n{shared}", "a") for i in range(9)]
    rows += [(100, None, None), (101, "", "b"), (102, "\n\n", "b"), (None, shared, "c"), (3, rows[3][1], "a"), (103, "ü" * 40, "d")]
    rows += [(200 + i, "ü" * 39 + "\n" + "É" * 40 + "\n", "d") for i in range(6)]
    df = frame(spark, rows)
    got = linededup.apply_bitmaps(df, linededup.keep_bitmaps(df)).collect()
    low = {c: c + 32 for c in range(65, 91)}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low)
    where = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                where[key(line)].add(i)
    want = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or not (len(key(x)) >= 40 and len(where[key(x)]) >= 5 and max(where[key(x)]) != i)]
        want.append((i, len(lines), len(lines) - len(kept), t if len(kept) == len(lines) else "\n".join(kept)))
    order = lambda r: (r[0] is None, r[0] or 0, r[3] or "")
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got), key=order) == sorted(want, key=order)
    assert set(df.columns) < set(got[0].asDict())


def test_line_bitmaps_are_runs(spark):
    df = frame(spark, [(i, "\n".join(["x" * 50] * 4 + [f"keep {i}"] + ["y" * 50]), "a") for i in range(6)])
    runs = {r.key.id: [tuple(x) for x in r.dropped] for r in linededup.keep_bitmaps(df).collect()}
    assert runs == {i: [(0, 4), (5, 1)] for i in range(5)}
    assert linededup.keep_bitmaps(frame(spark, [])).count() == 0


# ---- byte-level BPE


@pytest.mark.parametrize(("chunk", "overlap"), [(20, 8), (64, 40), (16_384, 512)])
def test_bpe_encodes_as_tiktoken_and_decodes_exactly(spark, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(3)
    parts = ["ab", "c", " ", "  ", "\n", "é", "'s", "!", "😀", "12", "   \n  ", "x" * 30, " " * 25, "\x1c", "<|endoftext|>"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 200))), "a") for i in range(40)]
    rows += [(100, None, "a"), (101, "", "a"), (102, "x" * 500, "b"), (103, "ab " * 100, "b"), (103, "ab " * 100, "b"), (None, "null id", "c")]
    out = bpe.decode(bpe.encode(frame(spark, rows), path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), path).collect()
    got = sorted((str(r.doc_id), bytes(r.decoded).decode(), np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens) for r in out)
    want = sorted((str(i), t or "", known.encode_ordinary(t or ""), len(known.encode_ordinary(t or ""))) for i, t, _ in rows)
    assert got == want
    assert bpe.encode(frame(spark, []), path, public_tokenizers.PATTERN).count() == 0


# ---- mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), {}
    while True:
        rest, free = total - sum(capped.values()), [s for s in names if s not in capped]
        found = capped | {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if found[s] > most * sizes[s]]
        if not over:
            return found
        capped |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 200), rng.choice(["a", "a", "a", "b", "É", None])) for i in range(900)]
    rows += [(900, None, "a"), (901, "", None), (5, rows[5][1], rows[5][2]), (902, " ".join("z" * 3 for _ in range(4000)), "b")]
    df = frame(spark, rows)
    got = mixing.mix(df).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want, source = targets(dict(sizes)), {i: s for i, _, s in rows}
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        assert r.taken == r.times * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.01)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    assert mixing.mix(frame(spark, [])).count() == 0


def test_pareto_order_prefers_long_documents(spark):
    rows = [(i, "w " * (10 if i % 2 else 160), "a" if i < 400 else "b") for i in range(800)]
    got = mixing.mix(frame(spark, rows), weights=(1, 3), share=1.0).collect()
    share = {k: np.mean([r.times for r in got if r.doc_id < 400 and r.doc_id % 2 == k]) for k in (0, 1)}
    assert share[0] > share[1] > 0


# ---- chat


def test_chats_are_read_back(spark):
    ugly = ["</s>[INST] ok [/INST]", "<|turn|>", "<~|end|>", "<~~|text|>x<|end|>\n<", "[INST", "a~b", "<|im_start|>user", "[~~INST]"]
    rows = [(1, 0, "system", "s"), (1, 1, "user", ugly[0]), (1, 2, "assistant", ugly[1]), (2, 0, "assistant", ugly[2]), (2, 1, "assistant", ugly[3]), (2, 1, "user", None), (3, None, None, ugly[5]), (None, 1, "user", ugly[4]), (4, 1, "us<|text|>er", ugly[6]), (4, 2, "user", ugly[7]), (4, 2, "user", ugly[7])]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, conv int")
    out = chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.trained_text(F.col("segments"))).collect()
    by = {r.conv_id: r for r in out}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert by.keys() == groups.keys()
    for c, turns in groups.items():
        want = [(role, text) for _, _, role, text in sorted(turns)]
        assert [(b.role, b.text) for b in by[c].back] == want
        assert by[c].loss == "".join(t for r, t in want if r == "assistant")
        assert by[c].formatted == "".join(s.text for s in by[c].segments)
        inside = "".join(s.text for k, s in enumerate(by[c].segments) if k % 3 == 1)
        assert not any(x in inside for x in chat.Template().controls)
    assert (by[1].valid, by[1].first_bad_turn) == (True, -1)
    assert (by[2].valid, by[2].first_bad_turn) == (False, 0)


def test_templates_that_cannot_be_escaped_are_rejected():
    with pytest.raises(ValueError, match="escaped"):
        chat.Template(turn="aa")


# ---- toxicity


def toxic_rows(n=600, seed=2):
    rng = random.Random(seed)
    clean, bad = [f"w{k}" for k in range(300)], ["vile", "nasty", "awful"]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 80))]
        toxic, low = rng.random() < 0.2, rng.random() < 0.3
        if toxic:
            words += [rng.choice(bad) for _ in range(3)]
        if low:
            words += ["spam"] * 2
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(toxic), int(low)))
    return rows


def test_chain_finds_held_out_toxic_documents(spark):
    rows = toxic_rows()
    docs = frame(spark, [(i, t, "a") for i, t, _, _ in rows] + [(9000, None, "a"), (9001, "", None), (9002, "vile nasty awful VILE", "b"), (9003, "w1 " * 50_000, "b")])
    labels = spark.createDataFrame([(i, b, y) for i, _, y, b in rows[:400]] + [(77_777, 1, 1), (None, 1, 1), (401, None, None)], "doc_id long, low int, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, {"low": "low", "toxic": "toxic"}).collect()}
    assert len(got) == docs.count()
    held = rows[400:]
    assert np.mean([got[i].is_toxic == bool(y) for i, _, y, _ in held]) > 0.95
    assert np.mean([(got[i].p_low > 0.5) == bool(b) for i, _, _, b in held]) > 0.95
    assert got[9002].is_toxic
    assert not got[9000].is_toxic and not got[9001].is_toxic and not got[9003].is_toxic


def test_chain_without_labels_or_documents(spark):
    docs = frame(spark, [(1, "a b", "s")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.p_toxic, r.is_toxic) for r in toxicity.classify(docs, none, {"toxic": "toxic"}).collect()] == [(0.5, False)]
    assert toxicity.classify(docs.limit(0), none, {"toxic": "toxic"}).count() == 0


def test_later_models_use_earlier_probabilities():
    rng = np.random.default_rng(1)
    p = rng.random(400)
    w = toxicity.fit_linear([np.empty(0, np.int32)] * 400, p[:, None], (p > 0.5).astype(float))
    assert w[toxicity.BUCKETS] > 1


# ---- shards


def test_shards_hold_every_id_once_in_a_keyed_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcé\n") for _ in range(rng.randint(0, 300))), "a") for i in range(200)] + [(900, None, "a"), (901, "", "b"), (None, "q", "b"), (5, "again", "a")]
    path = str(tmp_path / "in")
    frame(spark, rows).repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    layout = shards.materialise(docs, str(tmp_path / "out"), key=1, length=64, per_shard=50)
    got = shards.read_shards(spark, layout).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(layout.sequences))
    assert sum(r.n_tokens for r in got) == sum(len((t or "").encode()) + 1 for _, t, _ in rows)
    assert sorted(x for r in got for x in bytes(r.ids)) == sorted(x for _, t, _ in rows for x in (t or "").encode() + b"\xff")
    for p in (tmp_path / "out").rglob("part-*"):
        assert p.stat().st_size % layout.stride == 0
    by_id = {i: (t or "").encode() for i, t, _ in rows if i not in (5, None)}
    for r in got:
        if r.doc_id in by_id:
            head = (by_id[r.doc_id] + b"\xff")[r.start :][: r.n_tokens]
            assert bytes(r.ids).startswith(head)
    resumed = [r.slot for r in shards.read_shards(spark, layout, first=77).collect()]
    assert sorted(resumed) == list(range(77, layout.sequences))
    other = shards.materialise(docs, str(tmp_path / "other"), key=2, length=64, per_shard=50)
    assert [bytes(r.ids) for r in shards.read_shards(spark, other).orderBy("slot").collect()] != [bytes(r.ids) for r in got]


def test_shards_of_the_query_hold_token_ids(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rows = [(i, t, "a") for i, t in enumerate(texts(n=30, words=400))] + [(50, None, "a"), (51, "", "b"), (None, "null id", "b"), (52, "long\n" * 9000, "b"), (3, "again", "c")]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(x for _, t, _ in rows for x in [*known.encode_ordinary(t or ""), 0xFFFF])
    assert sum(r.n_tokens for r in queries.op10_training_shards(spark, str(tmp_path)).collect()) == len(want)
    encoded = bpe.encode(spark.read.parquet(str(tmp_path / "documents.parquet")), path, public_tokenizers.PATTERN, width=2)
    encoded.select("doc_id", "ids").write.parquet(str(tmp_path / "ids"))
    layout = shards.materialise(spark.read.parquet(str(tmp_path / "ids")), str(tmp_path / "out"), length=64, per_shard=50, text_col="ids", width=2)
    got = shards.read_shards(spark, layout).collect()
    assert sorted(r.slot for r in got) == list(range(layout.sequences))
    assert sorted(x for r in got for x in np.frombuffer(r.ids, "<u2").tolist()) == want
    by_id = {i: [*known.encode_ordinary(t or ""), 0xFFFF] for i, t, _ in rows if i not in (3, None)}
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert r.n_tokens == len(ids)
        if r.doc_id in by_id:
            head = by_id[r.doc_id][r.start :][: r.n_tokens]
            assert head and ids[: len(head)] == head


def test_shards_of_nothing(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "in"))
    layout = shards.materialise(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "out"))
    assert layout.sequences == 0
    assert shards.read_shards(spark, layout).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 5000])
def test_feistel_is_a_permutation(n):
    for key in (0, 9):
        assert sorted(shards.Feistel(n, key)(np.arange(n)).tolist()) == list(range(n))
    assert n < 17 or shards.Feistel(n, 0)(np.arange(n)).tolist() != shards.Feistel(n, 9)(np.arange(n)).tolist()


def test_digests_of_queries_are_lowercase_hex(spark):
    assert spark.range(1).select(F.sha2(F.lit("a"), 256).alias("h")).first().h == hashlib.sha256(b"a").hexdigest()


def test_bpe_chunks_of_one_text_are_encoded_by_several_tasks(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng = random.Random(5)
    words = ["we're", "don", "'t", " it'll ", "a'rb", "x" * 90, "7" * 70, "\t \n", "é漢", "!!", " " * 40 + "z"]
    for chunk, overlap in ((64, 32), (200, 64)):
        text = "".join(rng.choice(words) for _ in range(2500))
        df = frame(spark, [(1, text, "a")])
        encoded = bpe.encode(df, path, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap)
        assert np.frombuffer(encoded.first().ids, "<u4").tolist() == known.encode_ordinary(text)
        assert np.frombuffer(bpe.encode_whole(df, path, public_tokenizers.PATTERN).first().ids, "<u4").tolist() == known.encode_ordinary(text)
    # a chunk at a time, as the tasks do it: each has the pieces between its joins, whichever of them runs first
    encoder = bpe.Encoder(bpe.read_ranks(path), public_tokenizers.PATTERN)
    stitcher = bpe.Stitcher(encoder, bpe.known_bytes(path), chunk, overlap)
    parts = []
    for k in range(-(-len(text) // chunk)):
        packed, cut = encoder.pieces(text[k * chunk : (k + 1) * chunk + overlap])
        parts.append((k, b"".join(packed), *bpe._edges(k * chunk, packed, cut, chunk, overlap)))
    for part in parts:
        stitcher.add(*part)
    assert np.frombuffer(stitcher.finish(), "<u4").tolist() == known.encode_ordinary(text)
