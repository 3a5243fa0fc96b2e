"""Writers: lines, JSON lines, XML, splits, predictions, upserts."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.graph import upsert


def lines(rows: DataFrame, value: str, path: str, mode: str = "errorifexists") -> None:
    """One stripped example a line; line breaks inside become spaces."""
    rows.select(F.trim(F.regexp_replace(value, r"[\r\n]+", " ")).alias("value")).write.mode(mode).text(path)


def json_lines(rows: DataFrame, path: str, mode: str = "errorifexists", shuffle_by: str | None = None) -> None:
    """JSON lines; with shuffle_by in the pseudo-random but repeatable order of that column's md5."""
    if shuffle_by:
        rows = rows.withColumn("_order", F.md5(F.col(shuffle_by).cast("string"))).repartitionByRange("_order").sortWithinPartitions("_order").drop("_order")
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def split_json(rows: DataFrame, split: str, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).partitionBy(split).json(path)


def article_files(articles: DataFrame, path: str) -> None:
    """An XML text for each article, under a folder of its file name; articles that are there already stay as they are, malformed ones are not written. articles: doi, xml."""
    named = well_formed(articles.select(tx.file_name("doi").alias("article"), "xml"))
    spark = articles.sparkSession
    try:
        known = spark.read.text(path).select("article").distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    if known is not None:
        named = named.join(known, "article", "left_anti")
    named.write.mode("append").partitionBy("article").text(path)


def well_formed(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Rows whose XML can be parsed again."""

    def fine(x: str | None) -> bool:
        try:
            ET.fromstring(x or "")
            return True
        except ET.ParseError:
            return False

    return rows.where(F.arrow_udf(lambda column: pa.array([fine(x) for x in column.to_pylist()], pa.bool_()), "boolean")(xml))


def split_files(rows: DataFrame, split: str, name: str, xml: str, path: str) -> None:
    """XML texts in a folder for each split, one under each name, as read again by xml_corpus() with recursive."""
    rows.select(F.col(split).alias("split"), F.col(name).alias("name"), xml).write.partitionBy("split", "name").text(path)


def predictions_csv(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows with all their columns, the generated ones too."""
    rows.write.mode(mode).option("escape", '"').csv(path, header=True)


def pretty_json(column: str) -> F.Column:
    return F.to_json(F.col(column), {"pretty": "true", "ignoreNullFields": "false"})


def new_rows(rows: DataFrame, written: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not written yet."""
    return rows.join(written.select(key), key, "left_anti")


def upsert_table(spark: SparkSession, path: str, new: DataFrame, key: str, to: str) -> None:
    """The table at path with new rows put in the place of old ones of their key, written to another path."""
    upsert(spark.read.parquet(path), new, key).write.mode("errorifexists").parquet(to)
