"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import remove, scratch


def _state(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.lit(0))).first()
    return tuple(r)


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """Every neighbour is linked to the least neighbour: of larger neighbours (large star) or among smaller ones (small star)."""
    if small:
        around = edges
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = around.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = least.select("u", F.col("m").alias("v"))
        return linked.unionByName(own).distinct()
    around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return around.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the least node that can be reached) of every node that has an edge to another."""
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    path, before = scratch(spark, "edges"), None
    e.write.parquet(path)
    while True:
        e = spark.read.schema("u long, v long").parquet(path)
        now = _state(e)
        if now == before or now[0] == 0:
            break
        before, old, path = now, path, scratch(spark, "edges")
        _stars(_stars(e, small=False), small=True).write.parquet(path)
        remove(spark, old)
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
