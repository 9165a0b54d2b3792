"""Positions, running totals and exact quantiles over a whole table, without one big sort task.

Rows are range-partitioned on the order and written once, so partition numbers
stay the same if an executor is lost. Each partition adds up its own rows; the
offsets between partitions are one small row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import cut_lineage


def running_totals(
    frame: DataFrame, order: Sequence[str], values: Sequence[str], *, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``<value>_before``: the total of each value over the rows that come earlier.

    ``order`` must tell all rows of a ``by`` group apart.
    """
    by, order = list(by), list(order)
    ranged = cut_lineage(frame.repartitionByRange(*[F.col(c) for c in by + order])).withColumn(
        "_part", F.spark_partition_id()
    )
    totals = ranged.groupBy(*by, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier_parts = Window.partitionBy(*by).orderBy("_part") if by else Window.orderBy("_part")
    earlier_parts = earlier_parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_part",
        *[F.coalesce(F.sum(f"_{v}").over(earlier_parts), F.lit(0)).alias(f"_{v}") for v in values],
    )
    inside = (
        Window.partitionBy(*by, "_part").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranged.join(offsets, [*by, "_part"])
        .withColumns(
            {
                f"{v}_before": F.col(f"_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))
                for v in values
            }
        )
        .drop("_part", *[f"_{v}" for v in values])
    )


def positions(frame: DataFrame, order: Sequence[str], *, by: Sequence[str] = ()) -> DataFrame:
    """Add ``position``, the 0-based place of each row in the order."""
    counted = running_totals(frame.withColumn("_one", F.lit(1)), order, ["_one"], by=by)
    return counted.withColumnRenamed("_one_before", "position").drop("_one")


def quantiles(
    frame: DataFrame, value: str, fractions: dict[str, float], *, by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per ``by`` group.

    Equal values are counted together before anything is ordered, so a value that
    makes up a large part of a group is one row.
    """
    by = list(by)
    counted = frame.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(
        F.count(F.lit(1)).alias("n")
    )
    ordered = running_totals(counted, [value], ["n"], by=by)
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("size"))
    placed = ordered.join(sizes, by) if by else ordered.withColumn("size", sizes.scalar())

    def at(index: Column) -> Column:
        here = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    aggregates: list[Column] = []
    for name, fraction in fractions.items():
        point = F.lit(fraction) * (F.col("size") - 1)
        aggregates += [
            at(F.floor(point)).alias(f"{name}_low"),
            at(F.ceil(point)).alias(f"{name}_high"),
            F.max(point - F.floor(point)).alias(f"{name}_part"),
        ]
    result = placed.groupBy(*by).agg(*aggregates)
    return result.select(
        *by,
        *[
            (
                F.col(f"{name}_low")
                + (F.col(f"{name}_high") - F.col(f"{name}_low")) * F.col(f"{name}_part")
            ).alias(name)
            for name in fractions
        ],
    )
