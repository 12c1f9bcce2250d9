"""Exact quantiles of whole columns, by ranks over ranges of values instead of one task that holds them all.

Equal values are counted first, so a value that a third of all rows have is one row. The counted values are dealt by range and
written once; every range's total, a row each, gives the rank at which the range begins, and a running count inside the range
gives the ranks that each value holds. The rows that hold a wanted rank are the result: a few for each series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import checkpointed


def quantile_name(q: float) -> str:
    return "p" + f"{q * 100:g}".replace(".", "_")


def exact_quantiles(rows: DataFrame, series: str, value: str, quantiles: Sequence[float]) -> DataFrame:
    """``series`` and p0_1, p50, ...: the quantiles of the values that are not null, linear between ranks.

    There are few series (columns, horizons), a row for each is broadcast. A series without values has no row.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(series).alias("_s"), (F.col(value).cast("double") + 0.0).alias("_v")).agg(F.count("*").alias("_n"))
    dealt = checkpointed(counted.repartitionByRange("_s", "_v").withColumn("_p", F.spark_partition_id()))  # ranges may differ when they are drawn again
    parts = dealt.groupBy("_s", "_p").agg(F.sum("_n").alias("_total"))  # a row for each range and series
    before = Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("_s", "_p", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    last = parts.groupBy("_s").agg((F.sum("_total") - 1).alias("_last"))
    place = lambda q: F.lit(float(q)) * F.col("_last")
    places = last.select("_s", "_last", F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)).cast("long"), F.ceil(place(q)).cast("long")) for q in quantiles]))).alias("_wanted"))
    inside = Window.partitionBy("_s", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = dealt.withColumn("_c", F.sum("_n").over(inside)).join(F.broadcast(starts), ["_s", "_p"])  # a row for each range and series
    held = upto.join(F.broadcast(places), "_s").withColumn("_to", F.col("_start") + F.col("_c"))
    found = held.select("_s", "_v", F.explode(F.filter("_wanted", lambda r: (r >= F.col("_to") - F.col("_n")) & (r < F.col("_to")))).alias("_rank"))
    ranks = found.groupBy("_s").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))  # two entries a quantile at most
    out = last.join(ranks, "_s")
    value_at = lambda r: F.try_element_at("_at", r.cast("long"))
    low, high = (lambda q: value_at(F.floor(place(q)))), (lambda q: value_at(F.ceil(place(q))))
    between = lambda q: low(q) + (high(q) - low(q)) * (place(q) - F.floor(place(q)))
    return out.select(F.col("_s").alias(series), *[between(q).alias(quantile_name(q)) for q in quantiles])
