"""Vector searches and archives against brute force."""

import base64
import hashlib
import random

import numpy as np
import pytest

from panelforge.llm import additive, components, pivots, warc


def vectors(n=1200, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.5).astype(np.float32)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<float>, id string, n int")


ODD = [(7001, None), (7002, []), (7003, [1.0] * 15), (7004, [float("nan")] * 16), (7005, [float("inf")] + [0.0] * 15), (7006, [None] + [1.0] * 15), (None, [1.0] * 16)]


def test_additive_recall_and_exact_scores(spark):
    v = vectors()
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + ODD + [(7050, [0.0] * 16), (7100, v[3].tolist())]
    got = additive.nearest(frame(spark, rows)).collect()
    x = np.vstack([v, v[3]]).astype(float)
    ids = np.array([*range(len(v)), 7100])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = unit @ unit[q]
        order = [k for k in np.lexsort((ids, -score)) if k != q][:5]
        mine = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(float(unit[q] @ unit[list(ids).index(r.vec_id)]), abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(ids[order]))
        total += 5
    assert hits / total >= 0.9
    assert not {r.vec_id for r in got} & {i for i, _ in ODD}


def test_additive_takes_the_smallest_ids_of_a_large_group_and_what_is_near_it(spark):
    v = vectors(700, 16, seed=3)
    copy = v[0]
    near = [(copy + 1e-3 * d).astype(np.float32) for d in np.random.default_rng(1).normal(size=(3, 16))]
    rows = [(i, copy.tolist()) for i in range(400)] + [(1000 + i, x.tolist()) for i, x in enumerate(v[1:])] + [(5000 + 50 * i, x.tolist()) for i, x in enumerate(near)]
    random.Random(2).shuffle(rows)
    got = additive.nearest(frame(spark, rows)).collect()
    found = lambda q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
    for q in range(0, 400, 50):
        assert found(q) == [i for i in range(6) if i != q][:5]
    unit = {i: np.array(x, float) / np.linalg.norm(np.array(x, float)) for i, x in rows}
    for q in (5000, 5050, 5100):
        near_first = sorted((i for i in unit if i != q), key=lambda i: (-round(float(unit[i] @ unit[q]), 12), i))
        assert found(q) == near_first[:5]


@pytest.mark.parametrize(("n", "dim", "groups", "spread"), [(4000, 256, 0, 1.0), (6000, 32, 4, 1e-3), (3000, 16, 12, 3e-5)])
def test_additive_finds_the_nearest_whatever_the_codes_are_worth(spark, n, dim, groups, spread):
    """Many dimensions without structure, groups closer than the codes tell apart: far more than a shortlist is as good by code."""
    rng = np.random.default_rng(n)
    v = spread * rng.normal(size=(n, dim)) + (rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] if groups else 0)
    v = v.astype(np.float32).astype(float)
    got = additive.nearest(frame(spark, [(i, x.tolist()) for i, x in enumerate(v)])).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert len(got) == n // 50 * 5
    for q in range(0, n, 50):
        score = unit @ unit[q]
        score[q] = -2
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.score for r in mine] == pytest.approx(np.sort(score)[: -6 : -1].tolist(), abs=1e-13)
        assert score[[r.vec_id for r in mine]].tolist() == pytest.approx([r.score for r in mine], abs=1e-13)


def test_additive_ties_of_parallel_vectors_go_by_id(spark):
    """Multiples of one vector by powers of two tie exactly, and are more than a shortlist."""
    v = vectors(600, 8, seed=9).astype(float)
    rows = [(i, (v[0] * 2.0 ** (i - 250)).tolist()) for i in range(500)] + [(1001 + i, x.tolist()) for i, x in enumerate(v[1:])]
    random.Random(4).shuffle(rows)
    got = additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for q in range(0, 500, 50):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [i for i in range(6) if i != q][:5]


def test_additive_bound_holds_for_bad_codes():
    """No row that reaches the floor is excluded, also where sums lie far from their rows or opposite to them, and floors are negative."""
    x = additive._units(vectors(500, 8, seed=6).astype(float))
    rng = np.random.default_rng(0)
    books = rng.normal(size=(3, 16, 8)).astype(np.float32)
    codes = rng.integers(0, 16, (500, 3)).astype(np.uint8)
    fit = additive._fit(x, codes, books).astype(np.float32)
    sums = sum(books[m][codes[:, m]] for m in range(3)).astype(float)
    assert np.hypot(*fit.T) == pytest.approx(np.linalg.norm(sums, axis=1), rel=1e-5)
    assert (fit[:, 0] < 0).any()
    q = x[:40]
    for floor in (-0.9, -0.2, 0.0, 0.5, 0.999):
        may = additive._possible((q @ sums.T).astype(np.float32), np.full(40, floor), fit, 1e-5)
        assert may[q @ x.T >= floor].all()
    assert not may.all()


def test_additive_on_few_rows(spark):
    got = additive.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])])).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 2, 0.0)]
    assert additive.nearest(frame(spark, [])).count() == 0
    assert additive.nearest(frame(spark, [(1, None)])).count() == 0


def test_beam_search_encodes_better_than_greedy():
    x = additive._units(vectors(600).astype(float))
    books = additive.fit_codebooks(x, books=4, entries=16)
    error = {}
    for beam in (1, 4):
        codes, norms = additive.encode(x, books, beam)
        sums = sum(books[m][codes[:, m]] for m in range(4))
        assert np.allclose((sums**2).sum(axis=1), norms, atol=1e-4)
        error[beam] = ((x - sums) ** 2).sum()
    assert error[4] <= error[1]


def test_pivot_search_is_exact(spark):
    v = vectors(900)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + ODD + [(7000, [0.0] * 16), (7100, v[3].tolist()), (7101, v[3].tolist())]
    got = pivots.top_products(frame(spark, rows)).collect()
    x = np.floor(np.vstack([v, np.zeros(16), v[3], v[3]]).astype(float) * 1024).astype(int)
    ids = np.array([*range(len(v)), 7000, 7100, 7101])
    for q in np.flatnonzero(ids % 100 == 0):
        score = x @ x[q]
        order = [k for k in np.lexsort((ids, -score)) if k != q][:10]
        mine = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r["rank"])
        assert [(r.vec_id, r.score) for r in mine] == [(ids[k], score[k]) for k in order]
    assert pivots.top_products(frame(spark, [])).count() == 0


def test_pivot_bounds_eliminate_rows():
    v = np.floor(vectors(600).astype(float) * 1024)
    radius2 = (v**2).sum(axis=1).max()
    far = lambda a, p: np.sqrt(((a[:, None] - p[None]) ** 2).sum(axis=2))
    lift = lambda a: np.c_[a, np.sqrt(np.maximum(0, radius2 - (a**2).sum(axis=1)))]
    p = pivots.choose_pivots(lift(v), 24)
    q = np.c_[v[:5], np.zeros(5)]
    gap = np.abs(far(q, p)[:, None, :] - far(lift(v), p)[None]).max(axis=2)
    bound = ((v[:5] ** 2).sum(axis=1)[:, None] + radius2 - gap**2) / 2
    assert (bound + 1e-3 >= v[:5] @ v.T).all()
    # the search evaluates a part of the rows only, and misses none
    seen = []
    part = {"n": np.arange(600), "id": np.arange(600), "vec": v.astype(np.int64), "far": far(lift(v), p)}
    asked = {"n": np.arange(5), "id": np.arange(5), "vec": v[:5].astype(np.int64), "far": far(q, p)}
    found = pivots._search(10, float(radius2), lambda looked, of: seen.append((looked, of)))(part)(asked)
    for j, (n, _, s) in enumerate(found):
        score = (v @ v[j]).astype(int)
        want = [k for k in np.lexsort((np.arange(600), -score)) if k != j][:10]
        assert n.tolist() == want and s.tolist() == score[want].tolist()
    assert sum(of for _, of in seen) == 5 * 600
    assert sum(looked for looked, _ in seen) < 0.7 * 5 * 600


def test_searches_of_many_parts_and_blocks(spark, monkeypatch):
    for module in (additive, pivots):
        monkeypatch.setattr(module, "PART_ROWS", 100)
        monkeypatch.setattr(module, "QUERY_BLOCK", 3)
    test_additive_recall_and_exact_scores(spark)
    test_pivot_search_is_exact(spark)


def test_cosines_of_tiny_and_huge_vectors(spark):
    v = vectors(200, 8, seed=4).astype(float)
    scales = [1e-200, 1e200, 1.0, 1e-310, 1e300]
    rows = [(i, (x / np.abs(x).max() * scales[i % 5]).tolist()) for i, x in enumerate(v)]
    got = additive.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    unit = np.array([x / np.abs(x).max() for _, x in ((i, np.array(x)) for i, x in rows)])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for q in range(0, 200, 10):
        score = unit @ unit[q]
        want = [k for k in np.lexsort((np.arange(200), -score)) if k != q][:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == want
        assert all(r.score == pytest.approx(score[r.vec_id], rel=1e-6) for r in mine)


def test_products_beyond_a_long_count_as_its_largest(spark):
    got = pivots.top_products(frame(spark, [(0, [1e30, 1.0]), (1, [1.0, 1.0]), (100, [-1e30, 1.0])])).collect()
    assert sorted(tuple(r) for r in got) == [(0, 1, 1, 2**63 - 1), (0, 2, 100, -(2**63) + 1), (100, 1, 0, -(2**63) + 1), (100, 2, 1, -(2**63) + 1)]  # ties by id


# ---- archives


def pages(spark, rows):
    return spark.createDataFrame([(*r, b"p", "k") for r in rows], "page_id long, url string, html string, payload binary, kind string")


PAGES = [(1, "http://a", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 5000), (6, "http://e", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "http://f", "<p>same</p>"), (7, "http://g", "x" * 300_000), (1, "http://a", "<p>same</p>")]


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, tmp_path, compress):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, PAGES), path, compress=compress, per_file=3)
    got = warc.read_archives(spark, path).collect()
    assert all(r.gap is None for r in got)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        again = i is not None and first[h or ""] != i
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in got) == sorted(want)
    warc.write_archives(pages(spark, []), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("compress", [True, False])
def test_archives_keep_pages_with_very_long_urls(spark, tmp_path, compress):
    rng = random.Random(8)
    url = "data:," + "".join(rng.choice("abcdefgh0123") for _ in range(100_000))
    rows = [(1, url, "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, url + "x", "other")]
    warc.write_archives(pages(spark, rows), str(tmp_path / "w"), compress=compress)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted((r.page_id, r.url, r.gap, r.kind, r.refers_to) for r in got) == [(1, url, None, "response", None), (2, "http://b", None, "revisit", 1), (3, url + "x", None, "response", None)]


def members(compress):
    import gzip

    import zstandard

    raw = [warc.build_record(i, f"http://{i}", b"payload %d " % i * 40, None) for i in range(6)]
    if compress == "zstd":
        return [zstandard.ZstdCompressor(write_checksum=True).compress(r) for r in raw]
    return [gzip.compress(r) for r in raw] if compress == "gzip" else raw


@pytest.mark.parametrize("compress", ["none", "gzip", "zstd"])
def test_salvage_recovers_what_follows_damage(compress):
    parts = members(compress)
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    data = parts[0] + parts[1] + bytes(broken) + parts[3] + b"garbage" + parts[4] + parts[5][: len(parts[5]) // 2]
    got = list(warc.salvage(data))
    assert [r.page_id for _, _, r in got if not isinstance(r, str)] == [0, 1, 3, 4]
    gaps = [(at, n) for at, n, r in got if isinstance(r, str)]
    start = len(parts[0]) + len(parts[1])
    assert gaps[0] == (start, len(parts[2]))
    assert gaps[1] == (start + len(parts[2]) + len(parts[3]), 7)
    assert gaps[2][1] == len(parts[5]) // 2
    ends = [(at, at + n) for at, n, _ in got]
    assert ends[0][0] == 0 and ends[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))


def test_salvage_survives_random_damage():
    rng = random.Random(6)
    whole = b"".join(members("gzip") + members("none") + members("zstd"))
    for _ in range(60):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data))
            data[at : at + rng.randint(0, 30)] = bytes(rng.randrange(256) for _ in range(rng.randint(0, 30)))
        spans = [(a, n) for a, n, _ in warc.salvage(bytes(data))]
        assert all(x[0] + x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        assert sum(1 for *_, r in warc.salvage(bytes(data)) if not isinstance(r, str)) >= 10
    assert list(warc.salvage(b"")) == []


# ---- components


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(8)
    links = {"chain": [(k, k + 1) for k in range(60)], "star": [(0, k) for k in range(1, 50)], "random": [(rng.randrange(90), rng.randrange(90)) for _ in range(70)], "none": []}[shape]
    links = [*links, (500, None), (7, 7)] if shape != "none" else []
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df)[0].collect()}
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            p, q = sorted((find(a), find(b)))
            parent[q] = p
    assert got == {x: find(x) for x in parent}
