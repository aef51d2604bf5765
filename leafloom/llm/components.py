"""Connected components over an edge table by alternating large-star and small-star steps.

Every step groups with a minimum (combined before the shuffle) and joins that minimum back. Edges of hubs get theirs from a
broadcast table instead, so no hub's edges meet in one task: hubs have more than HUB edges, and more than one in HUBS of all
edge ends, which is why there are never more than HUBS of them. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_materialized, materialize

HUB, HUBS = 64, 20_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """edges: two long columns. Returns (node, component): every node that has an edge, and the smallest node it reaches.

    Nulls and loops are ignored; repeated edges count once; no edges give an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    e = e.where("_a is not null and _b is not null and u > v").select("u", "v").distinct()
    now = materialize(e, "cc-edges")
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        nxt = materialize(_small_star(_large_star(now, state[0]), state[0]), "cc-round")
        nxt_state = _state(nxt)
        drop_materialized(now)
        now, done, state = nxt, nxt_state == state, nxt_state
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    own = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(own)


def grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, component) after further links (a, b), between whose components only the few links that join two are followed."""
    side = lambda k: found.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))
    between = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    more = materialize(connected_components(between.where("a <> b").distinct()), "cc-grown")
    moved = found.join(more.select(F.col("node").alias("component"), F.col("component").alias("_now")), "component", "left").select("node", F.coalesce("_now", "component").alias("component"))
    return moved.unionByName(more).distinct()


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def _with_least(e: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """e (u, w) with m of least (u, m, n), n being the number of edges of u."""
    hub = F.col("n") > max(HUB, 2 * edges // HUBS)
    # at most HUBS rows of two numbers: safe to broadcast
    known = e.join(F.broadcast(least.where(hub).select("u", F.col("m").alias("_hub_m"))), "u", "left")
    # edges of hubs have their minimum already: they spread by their other end and meet nothing
    keyed = known.withColumns({"_hub": F.col("_hub_m").isNotNull(), "_key": F.when(F.col("_hub_m").isNull(), F.col("u")).otherwise(F.col("w"))})
    rest = least.where(~hub).select(F.lit(False).alias("_hub"), F.col("u").alias("_key"), F.col("m").alias("_m"))
    return keyed.join(rest, ["_hub", "_key"], "left").select("u", "w", F.coalesce("_hub_m", "_m").alias("m"))


def _large_star(e: DataFrame, edges: int) -> DataFrame:
    both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    out = _with_least(e.select(F.col("v").alias("u"), F.col("u").alias("w")), least, edges).select(F.col("w").alias("u"), F.col("m").alias("v"))
    return out.where("u > v")


def _small_star(e: DataFrame, edges: int) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    down = _with_least(e.select("u", F.col("v").alias("w")), least, edges).where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("v"))
    return down.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
