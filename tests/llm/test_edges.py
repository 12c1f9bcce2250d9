"""Edge cases of the text operators and of the pipeline: clashing names, long texts, brute force where SQL can't tell."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from panelforge.llm import bpe, chat, common, linededup, minhash, mixing, shards, toxicity, warc

CLASHING = ["times", "size", "taken", "n_lines", "n_dropped", "key", "dropped", "lines", "p_toxic", "is_toxic", "n_tokens", "ids", "row", "chunk", "component", "kept", "bucket", "_copy", "c0", "k1"]


def clashing(df):
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


def sample_rows(n=60):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    shared = " ".join(word() for _ in range(12))
    rows = [(i, "\n".join([" ".join(word() for _ in range(30)), *([shared] if i % 3 == 0 else [])]), rng.choice(["a", "b", None])) for i in range(n)]
    twin = rows[1][1].split(" ")
    rows += [(n, " ".join([*twin[:-1], "changed"]), "a"), (n + 1, None, "a"), (n + 2, "", None), (3, rows[3][1], rows[3][2]), (None, rows[5][1], "b"), (None, None, None)]
    return rows, shared


# ---- names that clash


def test_bitmaps_leave_clashing_columns_alone(spark):
    rows, shared = sample_rows()
    docs = clashing(documents(spark, rows))
    out = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    assert out.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    got = out.collect()
    assert len(got) == len(rows) and all(r[c] == f"own {c}" for r in got for c in CLASHING)
    assert sum(shared in (r.text or "") for r in got if r.doc_id is not None) == 1  # in the largest id
    assert sum(r.n_dropped_ for r in got) == sum(i is not None and i % 3 == 0 and i < 60 for i, _, _ in rows) - 1


def test_mix_and_scores_leave_clashing_columns_alone(spark):
    rows, _ = sample_rows()
    docs = clashing(documents(spark, rows))
    plain = mixing.mix(documents(spark, rows), keep=["doc_id", "text", "source"]).collect()
    got = mixing.repeat_rows(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHING)
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter({(r.doc_id, r.text, r.source): r.times * n for r, n in Counter(plain).items() if r.times})
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    scored = toxicity.classify(docs, labels, {"low_quality": "1 - quality", "toxic": "toxic"}, keep=docs.columns)
    assert scored.columns == [*docs.columns, "p_low_quality", "p_toxic_", "is_toxic_"]
    assert scored.where("p_toxic = 'own p_toxic' and p_toxic_ between 0 and 1").count() == len(rows)


# ---- long texts


def test_operators_take_whole_long_texts(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(150_000))
    line = "a line that five documents and more have in common, and that is long"
    text = f"{long}\n{line}\n{long[::-1]}"
    rows = [(1, text, "a"), (2, text + " end", "a"), (3, "short", "b"), *[(10 + k, line, "b") for k in range(5)]]
    docs = documents(spark, rows)
    kept = {r.doc_id: r for r in linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs)).collect()}
    assert kept[1].text == f"{long}\n{long[::-1]}" and (kept[1].n_lines, kept[1].n_dropped) == (3, 1)
    near = {r.doc_id: r for r in minhash.near_duplicates(docs, words=3, percent=85).collect()}
    split = text.lower().split()
    assert near[1].n_shingles == len({tuple(split[k : k + 3]) for k in range(len(split) - 2)})
    assert (near[2].component_id, near[2].kept, near[3].component_id) == (1, False, 3)
    sizes = {r.doc_id: r.size for r in mixing.mix(docs).collect()}
    assert sizes[1] == len(text.split()) and sizes[3] == 1
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(docs.where("doc_id <= 3"), path, public_tokenizers.PATTERN).collect()}
    assert got[1] == known.encode_ordinary(text) and got[2] == known.encode_ordinary(text + " end")
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "d"))
    layout = shards.materialise(spark.read.parquet(str(tmp_path / "d")), str(tmp_path / "s"), length=512, per_shard=64)
    stored = b"".join(bytes(r.ids) for r in shards.read_shards(spark, layout).collect())
    assert Counter(stored)[255] == len(rows) and len(stored) == sum(len(t.encode()) + 1 for _, t, _ in rows)
    said = [(1, 0, "user", text), (1, 1, "assistant", text + "<|end|>")]
    out = chat.format_chats(spark.createDataFrame(said, "conv_id long, turn int, role string, text string"))
    back = out.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("trained")).first()
    assert [(t.role, t.text) for t in back.turns] == [(r, t) for _, _, r, t in said] and back.trained == text + "<|end|>"


# ---- brute force


def test_mix_is_the_pareto_order_of_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 90), rng.choice("aab")) for i in range(500)] + [(1000, None, "a"), (1001, "w " * 3000, "b")]
    docs = documents(spark, rows)
    row = F.xxhash64(F.lit(11), F.col("doc_id"))
    u_of = {r[0]: r[1] for r in docs.select("doc_id", (F.shiftrightunsigned(row, 11).cast("double") + 0.5) / float(1 << 53)).collect()}
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    sizes = {i: len((t or "").split()) for i, t, _ in rows}
    for s in "ab":
        ids = [i for i, _, x in rows if x == s]
        total, target = sum(sizes[i] for i in ids), got[ids[0]].target
        copies, mean = int(target // total), total / len(ids)
        rest = target - copies * total
        part = rest / total
        key = {}
        for i in ids:
            if sizes[i]:
                ratio = u_of[i] / (1 - u_of[i]) / (part / (1 - part) * (sizes[i] / mean) ** 0.5)
                key[i] = ratio / (ratio + 1)
        order, chosen, gap, after = sorted(key, key=key.get), set(), rest, -1.0
        for _ in range(mixing.ROUNDS):
            upto, last, all_fit = 0, None, True
            for i in order:
                if key[i] > after and sizes[i] <= gap:
                    if upto + sizes[i] > gap:
                        all_fit = False
                        break
                    upto, last = upto + sizes[i], i
                    chosen.add(i)
            if all_fit:
                break
            after, gap = (after if last is None else key[last]), gap - upto
        assert {i: got[i].times for i in ids} == {i: copies + (i in chosen) for i in ids}


def test_inclusion_follows_the_odds(spark):
    rows = [(i, "w " * (4 if i % 2 else 64), "a") for i in range(8000)]
    got = mixing.mix(documents(spark, rows), weights=(1,), share=0.4).collect()
    p = {k: np.mean([r.times for r in got if r.doc_id % 2 == k]) for k in (0, 1)}
    # the odds of a document of 64 words are sqrt(16) = 4 times those of one of 4 words
    assert p[0] / (1 - p[0]) / (p[1] / (1 - p[1])) == pytest.approx(4, rel=0.2)


def test_later_models_are_trained_on_what_earlier_ones_say_of_texts_they_did_not_see(spark):
    rng = random.Random(12)
    rows = []
    for k in range(400):
        bad = k % 3 == 0
        words = [rng.choice(["grim", "foul", "vile"]) if bad and rng.random() < 0.6 else rng.choice("abcdefgh") for _ in range(6)]
        rows.append((" ".join([*words, f"only{k}"]), int(bad != (rng.random() < 0.15)), int(bad)))
    df = spark.createDataFrame(rows, "text string, first int, second int")
    chain, _ = toxicity.fit_chain(df, "text", ["first", "second"])
    keyed = df.select("text", "first", "second", F.xxhash64("text").alias("key"), F.pmod(F.xxhash64("text", F.lit(1)), F.lit(3)).alias("fold")).collect()
    keyed.sort(key=lambda r: r.key)
    hashed, fold = toxicity.Words(), np.array([r.fold for r in keyed])
    docs, y = [hashed(r.text.encode()) for r in keyed], np.array([(r.first, r.second) for r in keyed], float)
    none = np.empty((len(docs), 0))
    unseen = np.zeros((len(docs), 1))
    for f in range(3):
        use, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        w = toxicity.fit_linear([docs[i] for i in use], none[use], y[use, 0])
        unseen[rest, 0] = toxicity.score_linear(w, [docs[i] for i in rest], none[rest])
    want = toxicity.fit_linear(docs, unseen, y[:, 1])
    assert np.allclose(chain[1], want, atol=1e-5)
    seen = toxicity.score_linear(chain[0], docs, none)[:, None]
    assert not np.allclose(chain[1], toxicity.fit_linear(docs, seen, y[:, 1]), atol=1e-3)


# ---- files and the shared folder


def test_large_records_are_written_apart_with_fewer_to_a_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SMALL_RECORD", 1000)
    rows = [(k, "http://x", "y" * (10 + k)) for k in range(40)] + [(100 + k, "http://z", f"{k}" + "z" * 3500) for k in range(6)] + [(200, "u" * 20_000, None), (201, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df.coalesce(1), str(tmp_path / "w"), compress=False, per_file=8)
    got = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert Counter(r.page_id for r in got) == Counter(r[0] for r in rows) and not any(r.gap for r in got)
    assert {r.page_id: r.url for r in got}[200] == "u" * 20_000
    assert {r.page_id: r.refers_to for r in got if r.kind == "revisit"} == {201: 200}
    per_file = Counter(r.path for r in got)
    assert max(n for p, n in per_file.items() if "size-0" in p) == 8
    assert max(n for p, n in per_file.items() if "size-2" in p) == 2
    assert max(n for p, n in per_file.items() if "size-5" in p) == 1


def test_shards_notice_partitions_that_changed():
    batch = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([1, 2]), pa.array([b"abc", b"de"], pa.binary())], names=["part", "doc", "ids"])
    cut = lambda counts: sum(b.num_rows for b in shards._cut({0: 0}, counts, 2, 1, 4, 1)(iter([batch])))
    assert cut({0: 2}) == 2
    with pytest.raises(ValueError, match="first pass"):
        cut({0: 3})
    with pytest.raises(ValueError, match="first pass"):
        list(shards._cut({5: 0}, {5: 2}, 2, 1, 4, 1)(iter([batch])))


def test_results_can_be_cleared_from_the_shared_folder(spark):
    before = common.made()
    kept, path = common.table(spark.range(3).toDF("x"), "mine")
    other, _ = common.table(spark.range(3).toDF("x"), "other")
    common.clear(spark, [*before, path])
    assert common.made() == [*before, path] and kept.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        other.count()
    common.clear(spark, before)


def test_least_of_a_key_that_is_split(spark):
    rows = [("hot", k) for k in range(500, 100, -1)] + [("one", 7), ("two", 9), ("two", 9), (None, 1)]
    got = {(r.key, r.v, r.least, r.times) for r in common.with_least(spark.createDataFrame(rows, "key string, v long").where("key is not null"), ["key"], "v").collect()}
    assert got == {("hot", k, 101, 400) for k in range(101, 501)} | {("one", 7, 7, 1), ("two", 9, 9, 2)}


# ---- the pipeline


def write_tables(spark, path, rows, labels):
    clashing(documents(spark, rows)).repartition(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_every_stage_and_the_whole_run(spark, tmp_path):
    rows, shared = sample_rows()
    rng = random.Random(2)
    rows += [(300 + k, " ".join(rng.choice(["vile", "foul", "grim", "x", "y"]) for _ in range(20)), "a") for k in range(60)]
    sf_dir = write_tables(spark, tmp_path, rows, [(i, 1, int(300 <= i < 340)) for i in [*range(40), *range(300, 340)]])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((i, t) for i, t, _ in rows if i is None or i < 300)
    lines = corpus_pipeline.drop_lines(spark, docs, sf_dir)
    got = lines.collect()
    assert lines.columns == docs.columns and all(r.n_chars == len(r.text or "") for r in got)
    assert sum(shared in (r.text or "") for r in got if r.doc_id is not None) == 1
    single = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert single.columns == docs.columns
    assert Counter(r.doc_id for r in single.collect()) == Counter(i for i, _, _ in rows if i != 60)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    before = common.made()
    final = corpus_pipeline.run(spark, sf_dir)
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / stage.__name__)
        stage(spark, step, sf_dir).write.parquet(path)
        step = spark.read.parquet(path)
    assert Counter(map(tuple, final.collect())) == Counter(map(tuple, step.collect())) and final.count()
    assert len(set(common.made()) - set(before)) >= 1


def test_the_pipeline_on_nothing(spark, tmp_path):
    sf_dir = write_tables(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
