"""Tables in key order, digests, and bundles that are there whole or not at all."""

import datetime as dt
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from panelforge.sources import bundles, writers

D = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]


def table(spark, n=30, parts=4):
    rows = [(d, f"{(7 * k + i) % n:06d}", float(k % 3) if k % 5 else None) for i, d in enumerate(D) for k in range(n)]
    return spark.createDataFrame(rows, "date date, stock_code string, x double").repartition(parts)


def in_name_order(path, kind):
    import pyarrow.parquet as pq

    files = sorted(p for p in Path(path).glob(f"part-*.{kind}"))
    if kind == "csv":
        return [tuple(line.split(",")) for f in files for line in f.read_text().splitlines()[1:]], len(files)
    return [tuple(r.values()) for f in files for r in pq.read_table(f).to_pylist()], len(files)


def test_files_read_in_name_order_are_sorted(spark, tmp_path):
    df = table(spark).unionByName(table(spark).limit(40).withColumn("x", F.lit(9.0))).unionByName(table(spark).limit(3).withColumn("stock_code", F.lit(None).cast("string")))
    writers.write_sorted(df, str(tmp_path / "p"), ["stock_code", "date"], files=5)
    rows, files = in_name_order(tmp_path / "p", "parquet")
    assert files > 1 and len(rows) == df.count()
    order = [((r[1] is not None, r[1] or ""), r[0], (r[2] is not None, r[2] or 0.0)) for r in rows]
    assert order == sorted(order)
    # however the rows came
    writers.write_sorted(df.repartition(7), str(tmp_path / "q"), ["stock_code", "date"], files=3)
    assert in_name_order(tmp_path / "q", "parquet")[0] == rows
    writers.write_csv(df, str(tmp_path / "c"), keys=["date", "stock_code"])
    lines, _ = in_name_order(tmp_path / "c", "csv")
    assert [r[:2] for r in lines] == sorted(r[:2] for r in lines) and len(lines) == len(rows)


def test_digests_do_not_depend_on_order_but_on_rows(spark):
    df = table(spark)
    same = [writers.table_digest(x).first() for x in (df, df.repartition(3, "x"), df.orderBy("x").coalesce(1), df.select("x", "stock_code", "date"))]
    assert len({r.digest for r in same}) == 1 and same[0].rows == 900
    one = df.limit(1)
    for other in (df.unionByName(one), df.where(F.col("date") != D[0]), df.withColumn("x", F.when((F.col("date") == D[1]) & (F.col("stock_code") == "000003"), 7.5).otherwise(F.col("x"))), df.withColumn("y", F.lit(None)), df.limit(0)):
        assert writers.table_digest(other).first().digest != same[0].digest
    assert writers.folded({"a": "1", "b": "2"}) == writers.folded({"b": "2", "a": "1"}) != writers.folded({"a": "2", "b": "1"})


def test_bundles_show_finished_versions_only(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/b"
    quality = spark.createDataFrame([("is_csi300", D[0], 1)], "flag string, date date, n int")
    with pytest.raises(FileNotFoundError):
        bundles.read_bundle(spark, root)
    first = bundles.write_bundle(spark, "pit_membership", {"panel": table(spark), "quality": quality}, root, {"k": 1}, "one")
    assert first["tables"]["panel"]["rows"] == 900 and first["summary"] == {"k": 1} and bundles.verify_bundle(spark, root) == []
    # a job that is lost between two tables
    real, written = bundles.write_sorted, []

    def lost(df, path, *args, **kwargs):
        written.append(path.rsplit("/", 1)[-1])
        if "quality" in path:
            raise RuntimeError("lost")
        real(df, path, *args, **kwargs)

    monkeypatch.setattr(bundles, "write_sorted", lost)
    changed = table(spark).withColumn("x", F.lit(1.0))
    with pytest.raises(RuntimeError):
        bundles.write_bundle(spark, "pit_membership", {"panel": changed, "quality": quality}, root, version="two")
    assert bundles.read_manifest(spark, root) == first and bundles.verify_bundle(spark, root) == []
    with pytest.raises(FileNotFoundError, match="two"):
        bundles.read_manifest(spark, root, "two")
    # the same version takes up what was written
    written.clear()
    monkeypatch.setattr(bundles, "write_sorted", lambda df, path, *a, **k: (written.append(path.rsplit("/", 1)[-1]), real(df, path, *a, **k)))
    second = bundles.write_bundle(spark, "pit_membership", {"panel": changed, "quality": quality}, root, version="two")
    assert written == ["quality.parquet"]
    assert bundles.read_manifest(spark, root) == second and bundles.read_bundle(spark, root)["panel"].where("x = 1").count() == 900
    assert bundles.read_bundle(spark, root, "one")["panel"].where("x = 1").count() < 900
    # the same rows written anew have the same digests
    third = bundles.write_bundle(spark, "pit_membership", {"panel": changed.repartition(2), "quality": quality}, root)
    assert third["digest"] == second["digest"] != first["digest"] and third["version"] != "two"
    assert bundles.drop_versions(spark, root) == ["one", "two"] and bundles.verify_bundle(spark, root) == []


def test_a_changed_file_is_noticed(spark, tmp_path):
    root = str(tmp_path / "b")
    bundles.write_bundle(spark, "daily_dataset", {"panel": table(spark, parts=1)}, root, version="v")
    table(spark).limit(5).coalesce(1).write.mode("append").parquet(f"{root}/versions/v/panel.parquet")
    assert bundles.verify_bundle(spark, root) == ["panel"]


def test_kinds_declare_tables_and_keys(spark, tmp_path):
    df = table(spark)
    for kind, tables, said in (("other", {"panel": df}, "unknown kind"), ("daily_dataset", {"nav": df}, "no tables"), ("daily_dataset", {}, "needs a table"), ("daily_dataset", {"panel": df.drop("date")}, "date")):
        with pytest.raises(ValueError, match=said):
            bundles.write_bundle(spark, kind, tables, str(tmp_path))
    assert all(keys for tables in bundles.KINDS.values() for keys in tables.values())


def test_raw_features_are_exported_with_their_checks(spark, tmp_path):
    flags = {c: (F.col("stock_code").cast("int") % 5 == i).cast("int") for i, c in enumerate(("is_csi300", "is_csi500", "is_csi1000", "is_csi2000"))}
    context = table(spark, 10).where(F.col("date") < D[3]).select("date", "stock_code").withColumns({"industry": F.concat(F.lit("i"), F.col("stock_code").cast("int") % 3), "board": F.lit("SSE_MAIN"), "market_cap": F.lit(1.0), **flags})
    signal = context.select("date", "stock_code", F.lit(0.5).alias("value")).where(F.col("stock_code") != "000001")
    universe = context.select("date", "stock_code").where(F.col("date") < D[2])
    root = str(tmp_path / "raw")
    told = bundles.export_raw_features(spark, context, {"alpha": signal}, root, universe, ["a note"])
    s = told["summary"]
    assert (s["row_count"], s["date_count"], s["stock_count"], s["index_constituent_row_count"]) == (20, 2, 10, 16)
    assert s["signals"] == [{"signal": "alpha_raw", "rows": 20, "missing": 2, "dates": 2}] and s["notes"] == ["a note"]
    assert {r["column"]: r["rows_set"] for r in s["one_hots"]["industry_one_hot"]} == {"industry__i0": 8, "industry__i1": 6, "industry__i2": 6}
    again = bundles.export_raw_features(spark, context.repartition(5), {"alpha": signal.coalesce(1)}, str(tmp_path / "raw2"), universe)
    assert again["digest"] == told["digest"]
    assert bundles.verify_bundle(spark, root) == []
    lines, _ = in_name_order(f"{root}/versions/{told['version']}/raw_training_features.csv", "csv")
    assert len(lines) == 20 and lines[0][0] == "2024-01-01"
    current = json.loads(Path(root, "CURRENT").read_text())
    assert current == {"version": told["version"]}
