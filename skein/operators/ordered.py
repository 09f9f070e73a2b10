"""Running sums over a whole table, without a window that holds it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.sources.store import cut


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """The rows dealt in ranges of `order`, with the range's number `_part`; written once, so every reader sees the same ranges."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running_sums(df: DataFrame, values: list[str], order: list[str], by: list[str] | None = None) -> DataFrame:
    """Adds `<value>_upto` for each value: its sum over the group's rows up to this one, by `order`.

    Each range sums its own rows; what came before is one row for each range and group."""
    by = by or []
    rows = ranged(df, *by, *order)
    sums = rows.groupBy("_part", *by).agg(*(F.sum(v).alias(v) for v in values))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("_part").alias("_p"), *(F.col(b).alias(f"_b_{b}") for b in by), *(F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values))
    same = F.col("_part") == F.col("_p")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_b_{b}"))
    own = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(v).over(own).alias(f"_own_{v}") for v in values)).join(before, same)
    return out.select(*df.columns, *((F.col(f"_own_{v}") + F.col(f"_{v}")).alias(f"{v}_upto") for v in values))
