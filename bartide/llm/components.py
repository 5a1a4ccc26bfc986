"""Connected components of a graph that is never gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bartide.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id connected with it) of every id in `edges` (a, b); ids without an edge are absent.

    Alternating star steps: every id hands its larger neighbours to the smallest one it knows, until each component is a
    star around its smallest id. Rounds grow with the logarithm of the size; each one is a stored table."""
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = stored(links)
    state = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e"))
        links = stored(small.select("e.a", "e.b").where("a <> b").distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    members = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return members.union(links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
