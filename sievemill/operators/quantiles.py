"""Exact quantiles without a one-task state: counted values, range-partitioned, with offsets of whole partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemill.runtime import stored


def quantiles(df: DataFrame, column: str, shares: tuple[float, ...]) -> list[float | None]:
    """The quantiles of a numeric column by linear interpolation between order statistics; nulls are left out, None without values.

    Equal values are counted first; the counts are range-partitioned, and only partitions that hold a wanted rank are looked
    into. One row a partition and one value a rank come to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored first, as finding the ranges reads the counts once more than using them
    counted = stored(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n")), "values")
    held = stored(counted.repartitionByRange(parts, "v").withColumn("p", F.spark_partition_id()), "quantiles")
    sizes = held.groupBy("p").agg(F.sum("n").alias("n"), F.min("v").alias("low")).orderBy("low").collect()
    total = sum(r["n"] for r in sizes)
    if not total:
        return [None] * len(shares)
    places = [q * (total - 1) for q in shares]
    wanted: dict[int, tuple[int, int]] = {}  # rank -> partition and rank within it
    for rank in sorted({f(x) for x in places for f in (math.floor, math.ceil)}):
        before = 0
        for r in sizes:
            if rank < before + r["n"]:
                wanted[rank] = (r["p"], rank - before)
                break
            before += r["n"]
    running = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
    some = held.where(F.col("p").isin(*{p for p, _ in wanted.values()})).withColumn("c", running)
    row = some.agg(*(F.min(F.when((F.col("p") == p) & (F.col("c") > at), F.col("v"))).alias(f"r{rank}") for rank, (p, at) in wanted.items())).first()
    out = []
    for x in places:
        lo, hi = math.floor(x), math.ceil(x)
        a, b = float(row[f"r{lo}"]), float(row[f"r{hi}"])
        out.append(a if lo == hi or a == b else (hi - x) * a + (x - lo) * b)
    return out
