r"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target of words. A document is taken whole: ``floor(target / source size)``
certain copies of each document first, and for the rest a sample without replacement. Its order is
Pareto's: random odds u / (1 - u) divided by the odds of inclusion, smallest first, where longer
documents have larger odds (with the square root of their size). The sample ends where its words
reach the rest of the target, so its size is fixed and not a matter of chance.

No source is ever sorted as a whole. The order's key is cut into equal bins, pre-aggregated sums of
the bins show in which one the end lies, that bin is cut again in the same way, and only the bin
within it is walked through: one in ``BINS`` squared of a source's documents. What the last
document would have overshot is filled from the documents behind it that are small enough, in
``ROUNDS`` rounds of the same kind; less than a document's size is left of the target where any is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, free_name, table

BINS = 4096
ROUNDS = 3


def word_count(text: Column) -> Column:
    r"""Runs of anything but ``[\x20\x09-\x0D]``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Per source of (source, source_size): ``place``, ``target``, ``copies`` and ``rest`` (words to sample).

    Sources are in order of code points, null last, and weigh ``weights``, repeating. They share
    ``share`` times all words; a target stops at ``most`` times its source's size, and the excess goes
    to the others by weight until none is above. Filled in the order of the level at which they stop,
    that takes one pass over the source table, which has one row for each source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(order)).withColumn("weight", F.get(cycle, (F.col("place") - 1) % len(weights)))
    cap = F.col("source_size") * most
    level = Window.orderBy(F.col("source_size") * most / F.col("weight"), "place")
    everything = Window.partitionBy()
    words_left = F.sum("source_size").over(everything) * share - (F.sum(cap).over(level) - cap)
    weight_left = F.sum("weight").over(everything) - (F.sum("weight").over(level) - F.col("weight"))
    full = F.col("words_left") / F.col("weight_left") >= cap / F.col("weight")
    with_level = placed.withColumn("words_left", words_left).withColumn("weight_left", weight_left).withColumn("full", full)
    first_open = F.min_by(F.col("words_left") / F.col("weight_left"), F.when(~F.col("full"), -F.col("weight_left"))).over(everything)
    target = F.when(F.col("full"), cap).otherwise(first_open * F.col("weight"))
    found = with_level.withColumn("target", target)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return found.select("source", "source_size", "place", "target", copies.alias("copies"), (F.col("target") - copies * F.col("source_size")).alias("rest"))


def repeat_rows(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` takes it, with the columns of ``docs`` and no others."""
    times = free_name("times", docs.columns)
    taken = mix(docs, keep=docs.columns, **options).where(F.col(times) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))).alias(times)).drop(times)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 11,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """How often each document is taken: id, ``size`` (words), ``source_size``, ``target`` (of its source),
    ``times`` (whole copies in the mix) and ``taken`` (words, repeats counted). One row per input row.

    Null and empty texts have no words and are taken as often as the certain copies of their source.
    A null source is a source of its own, the last. Rows that repeat an id share their random number,
    so those of one size are sampled together or not at all. An empty table gives an empty result;
    other columns are ignored. Reruns agree, as the random numbers are hashes of the ids.
    Columns named in ``keep`` come along in place of the id; ``docs`` is then read once more for them at the end. Where
    one of them is named like a column of the result, the latter has ``_`` behind its name.
    """
    row = F.xxhash64(F.lit(seed), F.col(id_col))
    # 53 bits, kept off 0 and 1
    u = ((F.shiftrightunsigned(row, 11)).cast("double") + 0.5) / float(1 << 53)
    kept = [] if keep is None else [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), u.alias("u"))
    held, held_path = table(rows.select("id", "source", "size", "u"), "mix-sizes")
    sizes = held.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean_size"))
    totals, totals_path = table(sizes, "mix-sources")
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    joined = targets.join(totals.select(F.col("source").alias("s2"), "mean_size"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    plan, plan_path = table(joined, "mix-targets")
    part = F.col("rest") / F.greatest(F.col("source_size"), F.lit(1))
    odds = part / (1 - part) * F.sqrt(F.col("size") / F.col("mean_size"))
    ratio = F.col("u") / (1 - F.col("u")) / odds
    # the odds ratio itself is unbounded; this keeps its order and lies in (0, 1)
    key = F.when((F.col("size") > 0) & (F.col("rest") > 0), ratio / (ratio + 1))

    def keyed(rows: DataFrame) -> DataFrame:
        dealt = rows.join(plan.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")))
        return dealt.withColumn("key", key).drop("source", "s2", "u", "mean_size")

    ranked, ranked_path = table(keyed(held), "mix-order")

    fine = F.floor(F.col("key") * (BINS * BINS))
    candidates = ranked.where(F.col("key").isNotNull()).select("place", "key", "size", F.floor(fine / BINS).alias("bin"), fine.alias("fine"))

    def edges(sums: DataFrame, at: str, before: Column) -> DataFrame:
        """Per source of sums (place, ``at``, gap, words): the bin in which the words pass the gap, and the words before it."""
        upto = before + F.sum("words").over(Window.partitionBy("place").orderBy(at))
        over = sums.withColumn("upto", upto).where(F.col("upto") > F.col("gap"))
        return over.groupBy("place").agg(F.min_by(F.struct(F.col(at).alias("bin"), (F.col("upto") - F.col("words")).alias("before")), at).alias("edge"))

    state = plan.select("place", F.lit(-1.0).alias("after"), F.col("rest").alias("gap"), F.array().cast("array<struct<after:double,upto:double,gap:double>>").alias("taken"))
    paths = [held_path, totals_path, plan_path, ranked_path]
    for _ in range(ROUNDS):
        fits = candidates.join(state, "place").where((F.col("key") > F.col("after")) & (F.col("size") <= F.col("gap")))
        bins = fits.groupBy("place", "bin", "gap").agg(F.sum("size").alias("words"))
        coarse = edges(bins, "bin", F.lit(0))
        inside = fits.join(coarse, "place").where(F.col("bin") == F.col("edge.bin"))
        parts = inside.groupBy("place", "fine", "gap", F.col("edge.before").alias("earlier")).agg(F.sum("size").alias("words"))
        edge = edges(parts, "fine", F.col("earlier"))
        ends = fits.join(edge, "place").where(F.col("fine") == F.col("edge.bin"))
        walk = ends.withColumn("upto", F.col("edge.before") + F.sum("size").over(Window.partitionBy("place").orderBy("key")))
        last = walk.groupBy("place").agg(
            F.max(F.when(F.col("upto") <= F.col("gap"), F.col("key"))).alias("last_key"),
            F.max(F.when(F.col("upto") <= F.col("gap"), F.col("upto"))).alias("last_words"),
            F.first("edge").alias("edge"),
        )
        all_words = bins.groupBy("place").agg(F.sum("words").alias("all_words"))
        moved = state.join(all_words, "place", "left").join(last, "place", "left")
        # without an edge all candidates fit; without a last key the bin's first document is too large
        whole = F.col("edge").isNull()
        cut = F.when(whole, 2.0).otherwise(F.coalesce("last_key", F.col("edge.bin") / float(BINS * BINS) - 1e-18))
        words = F.when(whole, F.coalesce("all_words", F.lit(0))).otherwise(F.coalesce("last_words", "edge.before"))
        step = F.struct(F.col("after"), cut.alias("upto"), F.col("gap"))
        nxt = moved.select("place", cut.alias("after"), (F.col("gap") - words).alias("gap"), F.concat("taken", F.array(step)).alias("taken"))
        state, path = table(nxt, "mix-cuts")
        paths.append(path)
    # a row's key follows from its own columns and its source's plan, so no join by id brings the columns
    chosen = (ranked if keep is None else keyed(rows)).join(state.select("place", "taken"), "place")
    k, n = F.col("key"), F.col("size")
    sampled = F.coalesce(F.exists("taken", lambda s: (k > s["after"]) & (k <= s["upto"]) & (n <= s["gap"])), F.lit(False))
    times = F.col("copies") + sampled.cast("long")
    names = {id_col: F.col("id")} if keep is None else {c: F.col(f"k{i}") for i, c in enumerate(keep)}
    counted = chosen.withColumn("times", times).withColumn("taken", F.col("times") * n)
    # named last, as a kept column may be named like one of those above
    results = [F.col(a).alias(free_name(a, names)) for a in ("size", "source_size", "target", "times", "taken")]
    out, _ = table(counted.select(*[c.alias(a) for a, c in names.items()], *results), "mix-result")
    forget(docs.sparkSession, paths)
    return out
