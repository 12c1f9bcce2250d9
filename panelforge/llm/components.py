"""Connected components of a link table, by hooking to smaller neighbours and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, table


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> tuple[DataFrame, str | None]:
    """Smallest reachable id of every node that occurs in ``links``.

    Each round lets a node point to its smallest neighbour below itself, flattens the pointers by
    doubling, and replaces the links by links between the roots, so the link table shrinks every
    round. Everything stays in tables of the shared folder; the driver sees only emptiness tests.

    Null ends and self links are ignored; repeated links count once; an empty table gives an empty
    result. Returns (frame of node, component; its path in the shared folder).
    """
    spark = links.sparkSession
    lo, hi = F.least(F.col(a), F.col(b)), F.greatest(F.col(a), F.col(b))
    ordered = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, edge_path = table(ordered.select(hi.alias("u"), lo.alias("v")).distinct(), "cc-links")
    whole, whole_path = None, None
    while not edges.isEmpty():
        used = []
        hook, path = table(edges.groupBy("u").agg(F.min("v").alias("p")), "cc-hook")
        while True:  # pointers go to smaller ids only, so doubling ends
            step = hook.withColumn("moved", F.lit(False))
            for _ in range(3):
                q = step.select(F.col("u").alias("p"), F.col("p").alias("pp"))
                step = step.join(q, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved"))
            nxt, nxt_path = table(step, "cc-flat")
            used.append(path)
            moved = not nxt.where("moved").isEmpty()
            hook, path = nxt.select("u", "p"), nxt_path
            if not moved:
                break
        used.append(path)
        nodes = hook.select(F.col("u").alias("node"), F.col("p").alias("component"))
        if whole is None:
            merged = nodes
        else:
            to = nodes.select(F.col("node").alias("component"), F.col("component").alias("root"))
            merged = whole.join(to, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
            merged = merged.unionByName(nodes.join(whole.select("node"), "node", "left_anti"))
        kept, kept_path = table(merged, "cc-nodes")
        side = lambda c: hook.select(F.col("u").alias(c), F.col("p").alias(f"{c}_root"))
        rooted = edges.join(side("u"), "u", "left").join(side("v"), "v", "left")
        ru, rv = F.coalesce("u_root", "u"), F.coalesce("v_root", "v")
        short = rooted.where(ru != rv).select(F.greatest(ru, rv).alias("u"), F.least(ru, rv).alias("v")).distinct()
        shorter, shorter_path = table(short, "cc-links")
        forget(spark, [*used, edge_path, *([whole_path] if whole_path else [])])
        whole, whole_path, edges, edge_path = kept, kept_path, shorter, shorter_path
    forget(spark, [edge_path])
    if whole is None:
        t = ordered.schema[a].dataType
        return spark.createDataFrame([], "node long, component long").select(F.col("node").cast(t), F.col("component").cast(t)), None
    # roots point at themselves
    roots = whole.select(F.col("component").alias("node"), "component").distinct()
    return whole.unionByName(roots.join(whole.select("node"), "node", "left_anti")), whole_path
