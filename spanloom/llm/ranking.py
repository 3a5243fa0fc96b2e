"""Places of rows in a sorted order, also within groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, partitions


def placed(rows: DataFrame, order: list[str], work: Workspace) -> DataFrame:
    """rows (a kept table), range-sorted by order (nulls first) and written with _row, which ascends along the order, and _part, the partition that has written it."""
    parts = partitions(work.spark, work.size(rows))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_row", F.monotonically_increasing_id())
    # Written before anything is counted: a range exchange that runs twice may draw other bounds.
    return work.keep(placed).withColumn("_part", F.shiftright("_row", 33))


def offsets(placed: DataFrame, group: str) -> DataFrame:
    """group, _part, _first (the least _row there), _before (the group's rows in earlier parts), _size (the group's rows): a row for each group and part that has some."""
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    whole = Window.partitionBy(group)
    return counts.select(group, "_part", "_first", (F.sum("_n").over(whole.orderBy("_part")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_size"))


def ranked(rows: DataFrame, group: str, order: list[str], work: Workspace, name: str = "at") -> DataFrame:
    """rows and, as name, their place from 0 within their group by order; null is a group too. A large group is spread over many parts, which are joined with their offsets."""
    at = placed(rows, [group, *order], work)
    off = offsets(at, group).withColumnsRenamed({group: "_group", "_part": "_of"})
    return at.join(off, at[group].eqNullSafe(off["_group"]) & (at["_part"] == off["_of"])).select(*rows.columns, (F.col("_row") - F.col("_first") + F.col("_before")).alias(name))
