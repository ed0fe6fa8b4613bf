"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): ``root`` is the least node it is connected to.

    Each round is two shuffles of at most as many edges as there are; rounds end when nothing changes, after about log(n) of them.
    """
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = state(now)
    by = Window.partitionBy("u")
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.withColumn("m", F.least(F.col("u"), F.min("v").over(by)))
        large = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.withColumn("m", F.min("v").over(by))
        links = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        now = checkpointed(links.where("u <> v").distinct())
        last, seen = seen, state(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
