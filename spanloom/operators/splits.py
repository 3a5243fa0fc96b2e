"""Reproducible splits and samples, at the level of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import split_by_quota
from .lineage import fixed

CAP = 9999


def document_split(docs: DataFrame, key: str = "doc_id", share: float = 0.1, cap: int = CAP) -> DataFrame:
    """key, split: eval and test of floor(share * N) documents each, cap at most; train of the rest. Order is by md5 of the key."""
    return split_by_quota(docs.select(key), key, (share, share), cap, ("eval", "test", "train"))


def training(docs: DataFrame, key: str = "doc_id", share: float = 0.1, cap: int = CAP) -> DataFrame:
    """docs of the training split. The keys of the rest, 2 * cap of them at most, are sent to all tasks, so that no document is shuffled for it."""
    rest = document_split(docs, key, share, cap).groupBy(key).agg(F.max((F.col("split") == "train").cast("int")).alias("_train")).where("_train = 0").select(key)
    return docs.where(F.col(key).isNotNull()).join(F.broadcast(rest), key, "left_anti")


def coin(key: Column, salt: str, p: float) -> Column:
    """True for a share p of keys, by md5: the same on any engine."""
    number = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("/" + salt))), 1, 8), 16, 10).cast("long")
    return number < F.lit(int(p * (1 << 32)))


def sample(rows: DataFrame, key: str, p: float, salt: str = "sample") -> DataFrame:
    """A Bernoulli sample, repeatable by key."""
    return rows.where(coin(F.col(key), salt, p))


def split_counts(rows: DataFrame, kept: Column, split: str = "split") -> DataFrame:
    """Rows saved, seen and filtered out, by split."""
    return rows.groupBy(split).agg(F.sum(kept.cast("long")).alias("saved"), F.count("*").alias("total")).withColumn("filtered", F.col("total") - F.col("saved"))


def only_in(test: DataFrame, train: DataFrame, *keys: str) -> DataFrame:
    """Distinct entities of the test rows that training rows never have."""
    return test.select(*keys).distinct().join(train.select(*keys).distinct(), list(keys), "left_anti")


def in_one_alone(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that one side has and the other does not."""
    a, b, on = left.distinct(), right.distinct(), left.columns
    return a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti"))


def numbered(rows: DataFrame, *by: str, name: str = "number") -> DataFrame:
    """Rows with their number from 0 in an order, without a task that holds all of them.

    Range-sorted partitions number their own rows; the sums of the sizes before them, one
    row for each partition, are joined on. The sorted rows are written once and counted from
    what was written, since a range partitioning that runs twice may draw other bounds.
    by must tell all rows apart.
    """
    placed = fixed(rows.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"), (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_nth")))
    before = placed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_nth")).cast("long")).drop("_part", "_nth", "_n", "_before")
