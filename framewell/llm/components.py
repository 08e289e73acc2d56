"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewell.llm.common import new_folder, remove


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without links have no row; null ends are no nodes.

    Alternating large-star and small-star rounds: each rewrites the links so that they point to
    smaller nodes, until every component is a star around its smallest node. Each round is written
    to the shared folder; nothing but two sums reaches the driver.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    spark = links.sparkSession
    folder = new_folder(spark, "links")
    edges.write.parquet(folder)
    edges, seen = spark.read.schema(edges.schema).parquet(folder), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        past, folder = folder, new_folder(spark, "links")
        moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct().write.parquet(folder)
        edges = spark.read.schema(edges.schema).parquet(folder)
        remove(spark, past)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    # every link now is (node, smallest node)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
