"""Running totals, numbers and exact quantiles over a whole table, by ranges of its order: no task sees all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.state import cut


def running(df: DataFrame, order: list[Column], to: str, weight: Column | None = None) -> DataFrame:
    """df with the sum of `weight` (1 each) over all rows up to its own in the order.

    Rows are dealt into ranges of the order and kept so; each range adds what the ranges before it sum up to, of which there
    are as many as shuffle partitions.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long") if weight is None else weight
    ranged = cut(df.withColumn("__w", one).repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.sum("__w").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    within = F.sum("__w").over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranged.join(F.broadcast(before), "__part").withColumn(to, within + F.col("__before")).drop("__part", "__w", "__before")


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float]:
    """Exact quantiles of a column, interpolated linearly; nulls and NaN are left out; empty without rows."""
    values = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("c"))
    upto = running(values, [F.col("v")], "upto", F.col("c"))
    n = upto.agg(F.max("upto")).first()[0]
    if not n:
        return []
    places = sorted({f(s * (n - 1)) for s in shares for f in (math.floor, math.ceil)})
    hit = [(F.col("upto") - F.col("c") <= p) & (F.col("upto") > p) for p in places]
    held = upto.select("v", F.array(*hit).alias("hit")).where(F.exists("hit", lambda x: x)).collect()  # a row for each place at most
    at = {p: r.v for r in held for p, x in zip(places, r.hit, strict=True) if x}
    out = []
    for s in shares:
        place = s * (n - 1)
        low, high = math.floor(place), math.ceil(place)
        out.append(at[low] if low == high else (high - place) * at[low] + (place - low) * at[high])
    return out
