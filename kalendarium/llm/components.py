"""Connected components of a link table in rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalendarium.llm.common import stored


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Each node passes its smallest neighbour (or itself) on: to its larger neighbours, or to its
    smaller ones and itself. Minima are partial aggregates and come back by a join, so a node with a
    third of all links is a skewed join and not one group."""
    one_way = links.select("a", "b")
    back = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = one_way.unionByName(back) if larger else one_way.unionByName(back).filter("b < a")
    least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = near.join(least, "a")
    if larger:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node of its component. Rounds
    grow with the logarithm of the component size; each is written to the shared folder."""
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), f"{folder}/links-0")
    state, turn = None, 0
    while True:
        found = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if (found["n"], found["h"]) == state or not found["n"]:
            break
        state, turn = (found["n"], found["h"]), turn + 1
        now = stored(_stars(stored(_stars(now, True), f"{folder}/large-{turn}"), False), f"{folder}/small-{turn}")
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
