"""Command line: fetch, crawl, split, extract, prepare, examples, prompts, train, tag."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .api import TextTagger
from .functions import text as tx
from .functions.labels import CODE_MAPS
from .operators import lmprep, splits, tagging, tokens, xmlspans
from .sources import crawl, namedfiles, readers, writers, xmlrecords


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("fetch", help="crawl a collection of a REST API level by level, and write its article files")
    p.add_argument("collection")
    p.add_argument("to")
    p.add_argument("--api", required=True, help="the API's address")
    p.add_argument("--store", required=True, help="a shared folder for the answers; a crawl that was cut off goes on from it")
    p.add_argument("--pause", type=float, default=0.1, help="seconds between the requests of a task")
    p = sub.add_parser("crawl", help="article files from saved answers: articles, figures and panels as JSON lines with a doi, a figure_id and a body")
    p.add_argument("answers")
    p.add_argument("to")
    p = sub.add_parser("split", help="split a folder of XML files")
    p.add_argument("corpus")
    p.add_argument("to")
    p.add_argument("--files", action="store_true", help="a file under its own name for each, in folders train, eval and test")
    p = sub.add_parser("extract", help="examples by one XPath, or twins by two")
    p.add_argument("corpus")
    p.add_argument("to")
    p.add_argument("-P", "--xpath", nargs="+", default=[".//fig"])
    p.add_argument("-N", "--min-length", type=int, default=80)
    p.add_argument("--keep-xml", action="store_true")
    p.add_argument("--record", help="the element that is one document, for files with many of them")
    p = sub.add_parser("prepare", help="label words of XML examples, one a line")
    p.add_argument("lines")
    p.add_argument("to")
    p = sub.add_parser("examples", help="language-model examples from lines: ids, parts of speech, special tokens")
    p.add_argument("lines")
    p.add_argument("to")
    p.add_argument("--tokenizer", required=True, help="a tokenizers JSON file")
    p.add_argument("--max-length", type=int, nargs="+", default=[512])
    p = sub.add_parser("train", help="train a token tagger from word examples")
    p.add_argument("words")
    p.add_argument("to")
    p.add_argument("--labels", default="entity_types")
    p = sub.add_parser("prompts", help="prompt and completion rows from a CSV file")
    p.add_argument("csv")
    p.add_argument("to")
    p = sub.add_parser("tag", help="tag texts")
    p.add_argument("texts", nargs="+")
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    if a.command == "split":
        corpus = readers.xml_corpus(spark, a.corpus)
        named = corpus.join(splits.document_split(corpus, "path"), "path").withColumn("name", F.regexp_extract("path", "[^/]+$", 0))
        if a.files:
            namedfiles.write(named, F.concat_ws("/", "split", "name"), "xml", a.to)
        else:
            writers.split_files(named, "split", "name", "xml", a.to)
    elif a.command == "extract":
        corpus = readers.xml_corpus(spark, a.corpus)
        if a.record:
            corpus = xmlrecords.records(spark, a.corpus, a.record).select(F.concat_ws("#", "path", "start", "number").alias("path"), "xml")
        writers.lines(xmlspans.examples(corpus, "path", "xml", a.xpath, a.min_length, a.keep_xml), "value", a.to)
    elif a.command == "prepare":
        # Written once: ids of repeated lines must not change, and each line is parsed once for all code maps.
        rows = readers.lines(spark, a.lines).withColumn("id", F.monotonically_increasing_id())
        encoded = xmlspans.xml_spans(rows, "id", "value").persist()
        out = encoded.where("text is not null").select("id", "text", tx.words("text").alias("words"))
        for m in CODE_MAPS:
            labels = tokens.collected(xmlspans.word_labels(encoded, "id", m), "id", "pos", "iob2")
            out = out.join(labels.withColumnRenamed("iob2", m.name), "id", "left").withColumn(m.name, F.coalesce(m.name, F.array().cast("array<string>")))
        label_ids = F.create_map(*[x for m in CODE_MAPS for x in (F.lit(m.name), F.col(m.name))])
        writers.json_lines(out.select("words", "text", label_ids.alias("label_ids")), a.to, shuffle_by="text")
    elif a.command == "fetch":
        found = crawl.crawl_collection(spark, a.api, a.collection, a.store, pause=a.pause)
        writers.article_files(readers.article_xml_of_answers(*crawl.by_kind(found)), a.to)
    elif a.command == "crawl":
        bodies = lambda name: spark.read.schema("doi string, figure_id string, body string").json(f"{a.answers}/{name}.jsonl")
        writers.article_files(readers.article_xml_of_answers(bodies("articles"), bodies("figures"), bodies("panels")), a.to)
    elif a.command == "examples":
        rows = readers.lines(spark, a.lines).withColumn("doc_id", F.monotonically_increasing_id())
        out = lmprep.examples_of_lines(rows, lmprep.file_tokenizer(a.tokenizer), a.max_length)
        writers.json_lines(out.drop("doc_id"), a.to, shuffle_by="input_ids")
    elif a.command == "train":
        rows = readers.json_lines(spark, a.words, "words").select(F.col("id").alias("doc_id"), F.posexplode(F.arrays_zip("words", F.element_at("label_ids", a.labels).alias("label"))).alias("pos", "t"))
        tagging.fit(rows.select("doc_id", "pos", F.col("t.words").alias("word"), F.col("t.label").alias("iob2"))).write().save(a.to)
    elif a.command == "prompts":
        rows = readers.seq2seq_csv(spark, a.csv)
        writers.split_json(rows.select("split", tx.prompt("input_text", F.lit("\n\n###\n\n")).alias("prompt"), tx.prompt(F.lit(" "), "output_text", F.lit(" [END]")).alias("completion")), "split", a.to)
    else:
        for row in TextTagger(spark)(a.texts).orderBy("doc_id").toLocalIterator():
            print(row["tagged"])


if __name__ == "__main__":
    main()
