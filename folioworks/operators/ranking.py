"""Numbering rows over a total order without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.session import cut_lineage


def number_rows(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1..n over `order` (which must be total).

    The rows are range-partitioned by the whole order, so one hot leading value is spread too. Each
    partition numbers its own rows; only the per-partition counts (one row per partition) are summed.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    staged = (
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    staged = cut_lineage(staged)  # range bounds are sampled: freeze the placement before counting it
    staged = staged.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_idx", F.col("_mid").bitwiseAND((1 << 33) - 1)
    )
    offsets = (
        staged.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .select("_pid", "_before")
    )
    return (
        staged.join(F.broadcast(offsets), "_pid")  # at most one row per shuffle partition
        .withColumn(name, F.col("_before") + F.col("_idx") + 1)
        .drop("_mid", "_pid", "_idx", "_before")
    )


def number_rows_within(df: DataFrame, group: str, order: list, name: str = "rank") -> DataFrame:
    """1..n inside each value of `group`, safe when one group holds most rows."""
    ranked = number_rows(df, [F.col(group), *order], "_all")
    first = ranked.groupBy(group).agg(F.min("_all").alias("_first"))
    return (
        ranked.join(first, group)
        .withColumn(name, F.col("_all") - F.col("_first") + 1)
        .drop("_all", "_first")
    )
