"""Connected components by alternating large-star and small-star steps (Kiveris et al., "Connected components in MapReduce
and beyond"). Links stay distributed; each round is written to the shared folder, so lost executors cost one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import discard, stored


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node of ``links`` (columns ``u`` and ``v``, of one integer type)
    but the roots themselves. Loops and repeated links are ignored."""

    def settle(edges: DataFrame) -> tuple[DataFrame, tuple]:
        kept = stored(edges.filter("u <> v").distinct(), "links")
        state = kept.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        return kept, (state["n"], state["x"])

    old, state = settle(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while state[0]:
        both = old.unionByName(old.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, found = settle(small.unionByName(lower.select("u", F.col("m").alias("v"))))
        done = found == state
        discard(old.sparkSession, old, sweep=False)
        old, state = new, found
        if done:
            break
    return old.select(F.col("u").alias("node"), F.col("v").alias("root"))
