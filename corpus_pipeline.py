"""The corpus pipeline over documents, stage by stage.

1. Language ID: the model is learnt from the stage's own labelled rows; documents in
   which it finds no language (no text, no letter) go; a missing lang is filled in,
   unless no labelled row has text, so that there is no language to learn.
2. Line dedup: later copies of repeated line runs go; a document that had lines and
   has lost them all goes too.
3. Near-dedup: five-word shingles, similarity 0.8; of each group one document stays, that
   of the smallest doc_id (of equal ids, or none, that of the least hash).
4. Decontamination: documents in which a benchmark window occurs go; documents of equal
   id are judged by their own texts.
5. Packing into sequences.

Each stage takes (spark, docs, sf_dir) and, but for the last, returns the columns of
documents. run() writes each stage's rows and reads them again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontaminate, langid, linededup, neardup, packing
from spanloom.llm.workspace import Workspace

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = langid.identify(docs, model, carry=("text", "lang", "source", "n_chars"))
    known = found.where("lang_pred <> 'und'")
    return known.select("doc_id", F.col("carried_text").alias("text"), F.coalesce("carried_lang", "lang_pred").alias("lang"), F.col("carried_source").alias("source"), F.col("carried_n_chars").alias("n_chars"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(docs, carry=("lang", "source"))
    left = found.where("n_removed < n_lines or n_lines = 0")
    return left.select("doc_id", "text", F.col("carried_lang").alias("lang"), F.col("carried_source").alias("source"), F.length("text").cast("long").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(docs, words=5, percent=80, trees=24).where("first")
    kept = found.groupBy(F.col("doc_id").alias("kept_id"), "doc").agg(F.count("*").alias("copies"))
    kept = Workspace(spark).keep(kept)
    own = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    left = docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]) & (own == kept["doc"]), "left_semi").select(*COLUMNS)
    # Rows of equal id and text are one document; texts are shuffled for that only if there are any.
    return left.dropDuplicates(["doc_id", "text"]) if kept.where("copies > 1").limit(1).count() else left


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias("leak_id"), "key").distinct()
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["key"]), "left_anti").select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("minhash_near_dedup", near_copies), ("decontamination", benchmark), ("packing", sequences)]

#: Line runs, MinHash groups and token counts are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    work = Workspace(spark)
    for _, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
