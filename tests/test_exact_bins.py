"""Bins of whole columns by exact ranks, and sums that many rows do not blur."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import boosting
from panelforge.operators.boosting import Booster


def columns(n=120_000):
    rng = np.random.default_rng(5)
    return np.column_stack([rng.lognormal(size=n), np.where(rng.random(n) < 0.4, -0.0, np.round(rng.normal(size=n), 2)), np.arange(n) / 3.0])


def edges(x, bins):
    ranks = [max(1, math.ceil(k / bins * len(x))) for k in range(1, bins)]
    return [sorted(set((np.sort(c)[np.array(ranks) - 1] + 0.0).tolist())) for c in x.T]


@pytest.fixture(scope="module")
def rows(spark):
    x = columns()
    df = spark.createDataFrame([(r,) for r in x[::-1].tolist()], "x array<double>")
    return x, df.select("x", F.lit(1.0).alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("valid")).repartition(5)


def test_edges_hold_their_ranks_in_tables_larger_than_a_sketch(rows):
    x, df = rows
    booster = Booster(max_bin=32).named(["a", "b", "c"], {})
    found, told = booster._measured(df)
    assert told["rows"] == len(x) and [e.tolist() for e in found.edges] == edges(x, 32)


def test_bounds_that_miss_a_rank_are_widened(rows):
    x, df = rows
    want = edges(x, 8)
    near = {0: ([want[0][2]] * 7, [want[0][2]] * 7), 1: ([-9.0] * 7, [-8.0] * 7), 2: ([1e9] * 7, [math.nan] * 7)}
    found = boosting.exact_edges(df, near, 8)
    assert [sorted(set(found[f])) for f in range(3)] == want


def test_root_gains_are_those_of_exact_sums(spark):
    """0.1 is no multiple of a step, so its rounding adds up over rows of one sign."""
    n = 3_000_000
    df = spark.range(n, numPartitions=6).select((F.col("id") % 3).cast("double").alias("f"), (F.when(F.col("id") % 3 == 0, 1.0).otherwise(-1.0)).alias("y"))
    got = {r.position: r.gain for r in boosting.root_gains(df, ["f"], F.col("y"), F.lit(1.0), alpha=0.1).collect()}
    half = lambda g, h: g * g / (h + 2.0)
    third, whole = n // 3, half(0.1 * n / 3, n)
    assert got[1] == pytest.approx(half(-0.1 * third, third) + half(0.1 * 2 * third, 2 * third) - whole, abs=1e-9)
