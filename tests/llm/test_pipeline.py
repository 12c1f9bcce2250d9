"""The pipeline's stages on rows with null and repeated ids."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from panelforge.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_mix_stage_takes_every_row_as_often_as_planned(spark, tmp_path):
    rng = random.Random(9)
    rows = [(None if i % 7 == 0 else i, f"t{i} " + "w " * rng.randint(1, 60), "en", rng.choice(["a", "b", None])) for i in range(400)]
    # the same ids and sizes in two sources, of which one is repeated often
    rows += [(i, f"again{i} x y", "en", s) for i in range(1000, 1020) for s in ("a", "b")] + [(2000, None, "en", "a"), (2001, "", "en", "b")]
    spark.createDataFrame([(i, t, n, s, len(t or "")) for i, t, n, s in rows], DOCS).repartition(3).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    key = lambda r: (r.doc_id, r.text, r.source)
    got = Counter(map(key, corpus_pipeline.mix_sources(spark, docs, "").collect()))
    assert any(i is None for i, _, _ in got)
    # brute force: each row alone, by the plan of its id, size and source
    plan = mixing.mix(docs).collect()
    size_of = {(i, t, s): len((t or "").split()) for i, t, _, s in rows}
    total = {s: sum(n for (_, _, x), n in size_of.items() if x == s) for s in ("a", "b", None)}
    assert len(set(total.values())) == 3
    times = {(r.doc_id, r.size, r.source_size): r.times for r in plan}
    want = {k: times[k[0], n, total[k[2]]] for k, n in size_of.items()}
    assert got == Counter({k: n for k, n in want.items() if n})
    target = {r.source_size: r.target for r in plan}
    for s in total:
        assert sum(n * size_of[k] for k, n in got.items() if k[2] == s) == pytest.approx(target[total[s]], rel=0.01)


def test_the_other_stages_keep_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(40)), "en", "a", 1) for i in (1, 2, None, None, 3, 3)]
    spark.createDataFrame(rows, DOCS).repartition(2).write.parquet(str(tmp_path / "in"))
    docs = spark.read.parquet(str(tmp_path / "in"))
    for stage in (corpus_pipeline.drop_lines, corpus_pipeline.drop_near_duplicates):
        assert Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect()) == Counter((r[0], r[1]) for r in rows)
    assert Counter(r.doc_id for r in corpus_pipeline.encode(spark, docs, "").collect()) == Counter(r[0] for r in rows)
