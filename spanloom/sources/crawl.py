"""A crawl by levels: the answers of one level name the addresses of the next.

What has been answered is a table in a folder that driver and executors share. A level's
frontier is what the answers of the level before name, each address once, less what the
table has already; so an address is fetched once, and a crawl that was cut off goes on where
it stopped. Frontiers are fetched on the executors in waves of bounded size, each written
when it has ended: a lost driver costs a wave at most, a lost executor its tasks' addresses.

Addresses that gave no answer, or one of rest.AGAIN, are tried in further waves and by the
next crawl; any other answer settles an address, a missing page too.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rest

#: path: the ids on the way to an address, that of its collection first.
ADDRESS = "url string, path array<string>"
ANSWER = "level int, url string, path array<string>, status int, body string"
WAVE, TASK, TRIES = 100_000, 200, 3

Follow = Callable[[DataFrame], DataFrame]


def answers(spark: SparkSession, store: str) -> DataFrame:
    """All that has been answered so far."""
    try:
        return spark.read.schema(ANSWER).option("recursiveFileLookup", "true").parquet(store)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ANSWER)


def settled(found: DataFrame) -> DataFrame:
    """Answers that are not asked for again."""
    return found.where(~F.col("status").isin(0, *rest.AGAIN))


def _fetched(pause: float, get: Callable[[str], tuple[int, str]]):
    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        due = 0.0
        for rows in batches:
            got = []
            for url in rows["url"]:
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + pause
                got.append(get(url))
            yield rows.assign(status=[s for s, _ in got], body=[b for _, b in got])

    return each


def crawl(seeds: DataFrame, follow: Sequence[Follow], store: str, get: Callable[[str], tuple[int, str]] = rest.answer, pause: float = 0.0, wave: int = WAVE, task: int = TASK, tries: int = TRIES) -> DataFrame:
    """All answers of level 0 (seeds: url, path) and of each level that follow leads to, which turns the answers of a level (url, path, body) into the addresses of the next.

    pause: seconds between the requests of one task, so that a cluster of n slots makes n / pause
    requests a second at most. wave: addresses fetched before they are written; task: addresses of
    one task. An address that several answers name has the least of their paths.
    """
    spark = seeds.sparkSession
    for level in range(len(follow) + 1):
        if level:
            above = settled(answers(spark, store)).where((F.col("level") == level - 1) & (F.col("status") == 200))
            seeds = follow[level - 1](above.select("url", "path", "body"))
        for _ in range(tries):
            known = settled(answers(spark, store)).select("url")
            todo = seeds.where("url is not null").groupBy("url").agg(F.min("path").alias("path")).join(known, "url", "left_anti")
            left = todo.count()
            if not left:
                break
            waves = -(-left // wave)
            for k in range(waves):
                # By hash, so that waves are the same however the frontier is computed again.
                mine = todo.where(F.pmod(F.xxhash64("url"), F.lit(waves)) == k).repartition(max(1, -(-left // (waves * task))), "url")
                got = mine.mapInPandas(_fetched(pause, get), "url string, path array<string>, status int, body string")
                got.select(F.lit(level).alias("level"), "url", "path", "status", "body").write.parquet(f"{store.rstrip('/')}/level-{level}/{uuid.uuid4().hex}")
    return answers(spark, store)


def _first_text(*fields: str) -> Column:
    """The first of the fields that is neither null nor empty."""
    return F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in fields])


def collection_levels(base: str) -> list[Follow]:
    """What a collection's answers lead to: its list of papers, papers, figures by number, panels by id."""
    base = base.rstrip("/")
    in_collection = lambda *rest_of: F.concat_ws("/", F.lit(f"{base}/collection"), F.get("path", 0), *rest_of)

    def lists(found: DataFrame) -> DataFrame:
        named = found.select(F.get(F.from_json("body", "array<struct<collection_id:string>>"), F.lit(0))["collection_id"].alias("id")).where("id <> ''")
        return named.select(F.array("id").alias("path")).select(in_collection(F.lit("papers")).alias("url"), "path")

    def papers(found: DataFrame) -> DataFrame:
        each = found.select("path", F.inline(F.from_json("body", "array<struct<doi:string,id:string>>")))
        each = each.select("path", _first_text("doi", "id").alias("paper")).where("paper is not null")
        return each.select(in_collection(F.lit("paper"), "paper").alias("url"), F.concat("path", F.array("paper")).alias("path"))

    def figures(found: DataFrame) -> DataFrame:
        counted = found.select("url", "path", F.from_json("body", "nbFigures string")["nbFigures"].try_cast("int").alias("n")).where("n > 0")
        each = counted.select("url", "path", F.explode(F.sequence(F.lit(1), "n").cast("array<string>")).alias("k"))
        return each.select(F.concat_ws("/", "url", F.lit("figure"), "k").alias("url"), F.concat("path", F.array("k")).alias("path"))

    def panels(found: DataFrame) -> DataFrame:
        each = found.select("path", F.from_json("body", "figure_id string, panels array<string>").alias("f")).select("path", "f.figure_id", F.explode("f.panels").alias("panel"))
        return each.where("panel <> ''").select(F.concat_ws("/", F.lit(f"{base}/panel"), "panel").alias("url"), F.concat("path", F.array("figure_id", "panel")).alias("path"))

    return [lists, papers, figures, panels]


def crawl_collection(spark: SparkSession, base: str, name: str, store: str, **settings) -> DataFrame:
    """All answers for a collection of a REST API, by its name; settings: those of crawl()."""
    seeds = spark.createDataFrame([(f"{base.rstrip('/')}/collection/{name}", [])], ADDRESS)
    return crawl(seeds, collection_levels(base), store, **settings)


def by_kind(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Articles (body), figures (doi, body) and panels (figure_id, body) of a collection's answers, as readers.article_xml_of_answers() takes them."""
    good = found.where("status = 200")
    level = lambda k: good.where(F.col("level") == k)
    return level(2).select("body"), level(3).select(F.get("path", F.lit(1)).alias("doi"), "body"), level(4).select(F.get("path", F.lit(3)).alias("figure_id"), "body")
