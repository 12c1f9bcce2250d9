"""Packing, cross-tokenizer alignment and hard negatives against brute force, with their edge cases."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelforge.llm import alignment, negatives, packing, pivots, queries, tokenfiles, vectors

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASHING = ["n", "doc", "start", "length", "ids", "offset", "sequence_id", "doc_tokens", "block", "links", "times", "groups", "n_a", "n_best", "id", "vec", "p", "kind", "score", "rank", "windows", "cell"]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé漢🙂 ") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 40, 300, 1500])))) for i in range(n)]
    odd = ["", None, "  two  spaces\n\n\ttab ", "a" * 5000, "▁ and <0x41>", "<|endoftext|> in text </s>", "\u0000 nul", "é and ﬁ", "x"]
    rows += [(n + i, t) for i, t in enumerate(odd)]
    return [*rows, (3, rows[3][1]), (None, rows[5][1]), (None, None)]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def hf(special):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = not special
    return lambda text: t.encode(text, add_special_tokens=False).ids


# ---- packing


def pieces_of(df):
    return [r.asDict() for r in packing.pack(df, JSON, public_tokenizers.PATTERN).collect()]


def check_pieces(rows, got):
    """Every id once and in its place, sequences without gaps, bins of their count, and how many ids are padding."""
    encode = hf(True)
    want = Counter((i, *encode(t or ""), 0) for i, t in rows)
    by_doc, whole = defaultdict(list), Counter()
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    # rows that repeat an id are told apart by what fits: their pieces are sorted by start and sequence
    for (doc, n), found in by_doc.items():
        starts = defaultdict(list)
        for r in found:
            starts[r["start"]].append(r)
        while any(starts.values()):
            at, ids = 0, []
            while at < n:
                r = starts[at].pop(0)
                ids += np.frombuffer(r["ids"], "<u4").tolist()
                at += r["length"]
            assert at == n
            whole[(doc, *ids)] += 1
    assert whole == want
    padding, sequences = 0, defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
    for found in sequences.values():
        found.sort(key=lambda r: r["offset"])
        at = 0
        for r in found:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        counts = {r["bin_count"] for r in found}
        assert len(counts) == 1 and counts <= {None, len(found)}
        if at & (at - 1):
            assert counts != {None}
            padding += 1024 - at
    return padding, sum(r["length"] for r in got)


def test_pieces_hold_every_id_once_with_little_padding(spark):
    rows = texts()
    padding, total = check_pieces(rows, pieces_of(frame(spark, rows)))
    assert padding <= total / 64


@pytest.mark.parametrize("lengths", [[1023] * 40, [513] * 30, [700, 341, 18, 3] * 25, list(range(1, 400))])
def test_bins_of_any_lengths_are_nearly_full(lengths):
    packer = packing.Packer(1024, 1 / 64, 0)
    for i, n in enumerate(lengths):
        packer.add(i, np.arange(n, dtype="<u4"))
    packer.finish()
    filled = Counter()
    for _, _, length, _, _, sequence, _, _ in packer.rows:
        filled[sequence] += length
    assert sum(filled.values()) == sum(lengths)
    assert all(n > 1024 - 17 or n & (n - 1) == 0 for n in filled.values())


def test_packing_again_gives_the_same_and_tables_may_be_empty(spark):
    df = spark.createDataFrame(texts(2), "doc_id long, text string").repartition(2)
    assert pieces_of(df) == pieces_of(df)
    assert pieces_of(df.limit(0)) == []
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(df, JSON, public_tokenizers.PATTERN, capacity=1000)


def test_sequences_are_padded_unless_a_power_of_two(spark):
    rows = texts(3)
    found = packing.pack(frame(spark, rows), JSON, public_tokenizers.PATTERN)
    for r in packing.sequences(found, pad_id=7).collect():
        n, ids = r.n_tokens, np.frombuffer(r.ids, "<u4")
        assert len(ids) == (n if n & (n - 1) == 0 else 1024) and (ids[n:] == 7).all()
    encode = hf(True)
    assert packing.sequences(found).agg(F.sum("n_tokens")).first()[0] == sum(len(encode(t or "")) + 1 for _, t in rows)


def test_packing_query_derives_its_checksum_from_the_ids(spark):
    got = queries.op11_harmonic_packing(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    encode = hf(True)
    for r in random.Random(1).sample(got, 200):
        ids = [*encode(docs[r.doc_id] or ""), 0]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.start : r.start + r.length]))


# ---- alignment


def brute_alignment(rows):
    encode, model = hf(False), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    letters, spelled = tokenfiles.byte_letters(), Tokenizer.from_file(JSON)
    bytes_a = lambda i: bytes(letters[c] for c in spelled.id_to_token(i)) if i != 50256 else b"?"
    bytes_b = lambda i: bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    docs, holding = [], Counter()
    for doc, text in rows:
        a, b = (encode(" " + text), model.encode(text)) if text else ([], [])
        spans = []
        for ids, spell in ((a, bytes_a), (b, bytes_b)):
            at, ends = b"", []
            for i in ids:
                at += spell(i)
                ends.append(len(at))
            spans.append((at, ends))
        if not text or any(whole != b" " + text.encode() for whole, _ in spans):
            a, b, spans = [], [], [(b"", []), (b"", [])]
        both, groups, lo = sorted(set(spans[0][1]) & set(spans[1][1])), [], 0
        for hi in both:
            groups.append(tuple([i for i, e in zip(ids, ends, strict=True) if lo < e <= hi] for ids, (_, ends) in zip((a, b), spans, strict=True)))
            lo = hi
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        holding.update(links.keys())
        docs.append((doc, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (a, _), n in holding.items():
        best[a] = max(best[a], n)
    out = []
    for doc, n_a, n_b, groups, links in docs:
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        n_best = sum(n for (a, b), n in links.items() if holding[a, b] == best[a])
        out.append((doc, n_a, n_b, len(groups), sum(links.values()), n_best, sum(n * holding[k] for k, n in links.items()), text))
    return out


@pytest.mark.parametrize("block", [1, 50, 1 << 19])
def test_alignment_equals_brute_force(spark, block):
    rows = texts(4, 30)
    df = alignment.align(frame(spark, rows), JSON, public_tokenizers.PATTERN, MODEL, block=block)
    got = alignment.score_links(df, tokenfiles.byte_level(JSON, public_tokenizers.PATTERN, False).size, 32000)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    found = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got.collect())
    assert found == Counter(brute_alignment(rows))


def test_alignment_query_equals_brute_force(spark):
    got = queries.op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in brute_alignment(docs)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_alignment_of_an_empty_table(spark):
    df = alignment.align(frame(spark, texts(1, 1)).limit(0), JSON, public_tokenizers.PATTERN, MODEL)
    assert alignment.score_links(df, 50257, 32000).collect() == []


# ---- hard negatives


def brute_negatives(rows, every=100, positives=5, k=5, scale=256.0):
    held = [(i, label, [int(v) for v in np.floor(np.array(vec, float) * scale)]) for i, vec, label in rows if i is not None and label is not None and vec and all(v is not None and np.isfinite(v) for v in vec)]
    out = []
    for a, (i, label, x) in enumerate(held):
        if i % every:
            continue
        limit = 2**63 - 1
        scored = [(-max(-limit, min(limit, sum(p * q for p, q in zip(x, y, strict=True)))), j, b, other == label) for b, (j, other, y) in enumerate(held) if b != a]
        for p, j, _, _ in sorted(s for s in scored if s[3])[:positives]:
            near = sorted(s for s in scored if not s[3] and 80 * -p <= 100 * -s[0] <= 100 * -p)[:k]
            out += [(i, j, r, n, -p, -s) for r, (s, n, _, _) in enumerate(near, 1)]
    return Counter(out)


def vectors_of(n=600, dim=6, size=1.0, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * size
    rows = [(int(i), [float(v) for v in x[i]], int(rng.integers(0, 4))) for i in range(n)]
    rows[7] = (7, rows[0][1], rows[0][2])  # ties and copies
    rows[8] = (8, rows[0][1], 3 - rows[0][2])
    rows[9] = (9, [0.0] * dim, 1)
    bad = [(None, rows[1][1], 1), (n, None, 1), (n + 1, [], 1), (n + 2, [float("nan"), *rows[2][1][1:]], 1), (n + 3, [None, *rows[2][1][1:]], 2), (n + 4, rows[3][1], None), (n + 5, [float("inf"), *rows[2][1][1:]], 2)]
    return [*rows, *bad, rows[4], (0, rows[5][1], 2), (100, [0.0] * dim, 1), (-100, rows[6][1], 0)]


@pytest.mark.parametrize("size", [1.0, 1e3, 1e6, 3e8])
def test_negatives_equal_brute_force(spark, size):
    rows = vectors_of(size=size)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).withColumns({c: F.lit("own") for c in CLASHING})
    got = Counter(tuple(r) for r in negatives.hard_negatives(df).collect())
    assert got == brute_negatives(rows) and sum(got.values()) > 50


def test_few_or_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.1], 2)]
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect()] == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert negatives.hard_negatives(spark.createDataFrame([(0, [0.0, 0.0], 1), (5, [0.0, 0.0], 1)], schema)).collect() == []
    assert [tuple(r) for r in negatives.hard_negatives(spark.createDataFrame([(0, [0.0], 1), (5, [0.0], 1), (6, [2.0], 2)], schema)).collect()] == [(0, 5, 1, 6, 0, 0)]


def test_intervals_hold_every_score_and_spare_most_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 4)) * 20
    x = np.floor((centres[rng.integers(0, 8, 3000)] + rng.normal(size=(3000, 4))) * 256)
    norms, references = np.linalg.norm(x, axis=1), negatives.choose_references(x[:500], 16)
    angles = negatives.angles_to(x, norms, references)
    for j in range(20):
        least, most = negatives.score_bounds(angles.T, angles.T, angles[j], norms, norms[j])
        true = x @ x[j]
        assert (least <= true).all() and (true <= most).all()
    seen = []
    columns = {"n": np.arange(3000), "id": np.arange(3000), "vec": x, "angles": angles, "norm": norms[:, None], "label": np.zeros((3000, 1), np.int64)}
    part = negatives.Part(columns, lambda looked, of: seen.append(looked / of))
    top = int(np.sort(x @ x[0])[-200])
    asked = {c: v[:1] for c, v in columns.items()} | {"label": np.ones((1, 1), np.int64)}
    got = part.search(0, asked, False, [(int(0.95 * top), top)], 5)
    score = lambda b: int(x[b] @ x[0])
    assert sorted(s for s, _, _ in got) == sorted(sorted((s for b in range(1, 3000) if int(0.95 * top) <= (s := score(b)) <= top), reverse=True)[:5])
    assert seen[0] < 0.5


def test_products_are_exact_beyond_doubles():
    rng = np.random.default_rng(1)
    for size in (1e3, 1e7, 1e9, 1e12, 1e40):
        x, q = np.floor(rng.normal(size=(50, 8)) * size), np.floor(rng.normal(size=8) * size)
        limit = 2**63 - 1
        want = [max(-limit, min(limit, sum(int(a) * int(b) for a, b in zip(r, q, strict=True)))) for r in x]
        assert vectors.products(x, q).tolist() == want


def test_top_products_of_large_vectors(spark):
    rows = [(i, [1e6 * i, 1.0], None) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = Counter(tuple(r) for r in pivots.top_products(df).collect())
    x, limit = [[int(np.floor(1024 * v)) for v in r[1]] for r in rows], 2**63 - 1
    want = Counter()
    for i in range(0, 300, 100):
        scored = sorted((-max(-limit, min(limit, sum(a * b for a, b in zip(x[i], x[j], strict=True)))), j) for j in range(300) if j != i)
        want.update((i, r, j, -s) for r, (s, j) in enumerate(scored[:10], 1))
    assert got == want
