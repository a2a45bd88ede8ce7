"""Connected components of links that are too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from millrace.session import scratch_dir


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root): for every node that has a link, the least node it can reach.

    Links are rewritten in alternating star steps: first every node's larger neighbours, then its
    smaller ones, are tied to the least of them, until nothing changes, which takes about as many
    rounds as the logarithm of the longest path. Every step is written to the shared folder, so a
    lost executor costs one step. Minima are combined before each shuffle, and a node with many
    neighbours is joined by its neighbours' side, which Spark can split.
    """
    spark, folder = links.sparkSession, scratch_dir(links.sparkSession, "components")

    def kept(table: DataFrame, name: str) -> DataFrame:
        table.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    ordered = links.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    pairs, seen = kept(ordered, "links"), None
    for k in range(rounds):
        both = pairs.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            pairs.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = both.groupBy("node").agg(F.min("other").alias("m")).select(
            "node", F.least("m", "node").alias("m"))
        large = kept(both.filter("other > node").join(least, "node").select(
            F.col("other").alias("high"), F.col("m").alias("low")).distinct(), f"large{k}")
        down = large.groupBy("high").agg(F.min("low").alias("m"))
        joined = large.join(down, "high")
        pairs = kept(joined.filter("low <> m").select(F.col("low").alias("high"), F.col("m").alias("low"))
                     .unionByName(down.select("high", F.col("m").alias("low"))).distinct(), f"small{k}")
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("links did not settle")
    roots = pairs.select("low").distinct()
    return pairs.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(
        roots.select(F.col("low").alias("node"), F.col("low").alias("root")))
