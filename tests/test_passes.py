"""How often operators pass over what they are given."""

import datetime as dt

from pyspark.sql import functions as F

from panelforge.sources import bundles


def counted(df):
    """``df`` and the number of rows that were made for it so far."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), made


def test_an_export_passes_over_its_inputs_once(spark, tmp_path):
    flags = {c: (F.col("id") % 5 == i).cast("int") for i, c in enumerate(("is_csi300", "is_csi500", "is_csi1000", "is_csi2000"))}
    plain = spark.range(40).select(F.lit(dt.date(2024, 1, 1)).alias("date"), F.lpad(F.col("id").cast("string"), 6, "0").alias("stock_code"), F.concat(F.lit("i"), F.col("id") % 3).alias("industry"), F.lit("SSE_MAIN").alias("board"), F.lit(1.0).alias("market_cap"), *[c.alias(n) for n, c in flags.items()])
    context, made = counted(plain)
    told = bundles.export_raw_features(spark, context, {"alpha": plain.select("date", "stock_code", F.lit(0.5).alias("value"))}, str(tmp_path / "raw"), plain.select("date", "stock_code"))
    assert {n: t["rows"] for n, t in told["tables"].items() if n.endswith("one_hot")} == {"industry_one_hot": 40, "board_one_hot": 40, "index_one_hot": 40}
    assert made.value == 40
    assert bundles.read_bundle(spark, str(tmp_path / "raw"))["raw_training_features"].count() == 40
