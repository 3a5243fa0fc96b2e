"""Round trips: tables written by a sink to the shared folder, read again by a source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lineage
from ..operators import splits as sp
from ..operators.xmlspans import escape
from ..sources import eventfiles, namedfiles, readers, writers, xmlrecords
from .eval_queries import SPLIT
from .tree import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(r"SELECT md5(line) AS line, count(*) AS n FROM (SELECT trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS line FROM documents) WHERE line <> '' GROUP BY line")
def lines_round_trip(spark, sf_dir):
    to = lineage.new_folder(spark)
    writers.lines(documents(spark, sf_dir), "text", to)
    return readers.lines(spark, to).groupBy(F.md5("value").alias("line")).agg(F.count("*").alias("n"))


@query(r"SELECT md5(text) AS text, len(words) AS n_words, md5(array_to_string(words, ' ')) AS words, n FROM (SELECT text, regexp_extract_all(text, '[\p{L}\p{N}]+|[^ \p{L}\p{N}]') AS words, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)")
def json_lines_round_trip(spark, sf_dir):
    to = lineage.new_folder(spark)
    rows = documents(spark, sf_dir).where("text is not null").select(tx.words("text").alias("words"), "text", F.create_map(F.lit("kind"), F.array(F.lit("O"))).alias("label_ids"))
    writers.json_lines(rows, to, shuffle_by="text")
    read = readers.json_lines(spark, to, "words").where("label_ids['kind'][0] = 'O'")
    return read.select(F.md5("text").alias("text"), F.size("words").cast("long").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words")).groupBy("text", "n_words", "words").agg(F.count("*").alias("n"))


@query(SPLIT.replace("SELECT doc_id, CASE", "SELECT split, doc_id, md5(text) AS text FROM documents JOIN (SELECT doc_id, CASE", 1) + ") USING (doc_id) WHERE text IS NOT NULL")
def split_json_round_trip(spark, sf_dir):
    docs, to = documents(spark, sf_dir), lineage.new_folder(spark)
    writers.split_json(docs.where("text is not null").join(sp.document_split(docs), "doc_id").select("split", "doc_id", "text"), "split", to)
    return spark.read.schema("doc_id long, text string, split string").json(to).select("split", "doc_id", F.md5("text").alias("text"))


@query(SPLIT.replace("SELECT doc_id, CASE", "SELECT concat(split, '/page', doc_id, '.xml') AS name, md5(concat('<doc>', doc_id, '</doc>')) AS content FROM documents JOIN (SELECT doc_id, CASE", 1) + ") USING (doc_id)")
def named_files_round_trip(spark, sf_dir):
    """Documents as files of their own names in folders of their splits."""
    docs, to = documents(spark, sf_dir), lineage.new_folder(spark)
    split = sp.document_split(docs)
    namedfiles.write(split, F.concat(F.col("split"), F.lit("/page"), F.col("doc_id").cast("string"), F.lit(".xml")), F.concat(F.lit("<doc>"), F.col("doc_id").cast("string"), F.lit("</doc>")), to)
    return readers.xml_corpus(spark, to, recursive=True).select(F.regexp_extract("path", "[^/]+/[^/]+$", 0).alias("name"), F.md5("xml").alias("content"))


@query(r"""SELECT split, md5(input) AS input, md5(output) AS output, count(*) AS n FROM (
  SELECT CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, regexp_replace(text, '\r', ' ', 'g') AS input, concat('"', source, '", ', lang) AS output FROM documents WHERE doc_id % 4 <> 3 AND text <> '')
GROUP BY ALL""")
def csv_round_trip(spark, sf_dir):
    """Examples with quotes, commas and line breaks through CSV; rows of unknown subsets stay out."""
    rows = documents(spark, sf_dir).where("text <> ''").select(F.when(F.col("doc_id") % 4 == 3, "odd").otherwise(F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), (F.col("doc_id") % 3 + 1).cast("int"))).alias("subset"), F.regexp_replace("text", "\r", " ").alias("input_text"), F.concat(F.lit('"'), "source", F.lit('", '), "lang").alias("output_text"))
    to = lineage.new_folder(spark)
    writers.predictions_csv(rows, to)
    return readers.seq2seq_csv(spark, to).groupBy("split", F.md5("input_text").alias("input"), F.md5("output_text").alias("output")).agg(F.count("*").alias("n"))


@query("SELECT translate(n_name, '/.', '_-') AS article, md5(concat('<article>', n_name, CASE WHEN n_nationkey % 2 = 0 THEN ' first' ELSE ' second' END, '</article>')) AS xml FROM nation WHERE n_nationkey % 5 <> 4")
def article_files_round_trip(spark, sf_dir):
    """Articles written twice: what is there stays, what is malformed is not written."""
    nations, to = table(spark, sf_dir, "nation"), lineage.new_folder(spark)
    xml = lambda word: F.concat(F.lit("<article>"), "n_name", F.lit(f" {word}"), F.when(F.col("n_nationkey") % 5 == 4, "<a>").otherwise(""), F.lit("</article>"))
    writers.article_files(nations.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("doi"), xml("first").alias("xml")), to)
    writers.article_files(nations.select(F.col("n_name").alias("doi"), xml("second").alias("xml")), to)
    return spark.read.text(to, wholetext=True).select("article", F.md5(F.regexp_replace("value", r"\n\z", "")).alias("xml"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status FROM orders UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 7 = 0")
def upsert_round_trip(spark, sf_dir):
    """Rows put in the place of others in a table of files, and added to it."""
    old, first, second = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS status"), lineage.new_folder(spark), lineage.new_folder(spark)
    old.write.parquet(first)
    new = old.where("id % 3 = 0").selectExpr("id", "'new' AS status").unionByName(old.where("id % 7 = 0").selectExpr("-id AS id", "'added' AS status"))
    writers.upsert_table(spark, first, new, "id", second)
    return spark.read.parquet(second)


@query(r"SELECT doc_id, md5(regexp_replace(text, '[\r\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g')) AS text FROM documents WHERE text IS NOT NULL")
def xml_records_round_trip(spark, sf_dir):
    """Documents as elements of large XML files, cut out again by many tasks."""
    to = lineage.new_folder(spark)
    bare = F.regexp_replace("text", "[\r\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")
    rows = documents(spark, sf_dir).where("text is not null").select(F.concat(F.lit('<doc id="'), F.col("doc_id").cast("string"), F.lit('"><!-- </doc> -->'), escape(bare), F.lit("</doc>")).alias("value"))
    rows.write.text(to)
    found = xmlrecords.records(spark, to, "doc")
    inner = F.regexp_extract("xml", r"(?s)^<doc id=\"-?[0-9]+\"><!-- </doc> -->(.*)</doc>$", 1)
    return found.select(F.regexp_extract("xml", '^<doc id="(-?[0-9]+)"', 1).cast("long").alias("doc_id"), F.md5(tx.unescaped(inner)).alias("text"))


@query("SELECT count(*) + 1 AS least, sum(CASE WHEN length(text) > 80 THEN 1 ELSE 0 END) > 0 AS long_ones, true AS whole FROM documents")
def event_files(spark, sf_dir):
    """A number of each document as a logged scalar: records found again by their framing, one more for the head of each file."""
    to = lineage.new_folder(spark)
    spark.dataSource.register(eventfiles.EventFiles)
    docs = documents(spark, sf_dir)
    docs.select(F.col("doc_id").alias("step"), F.lit(0.0).alias("wall_time"), F.when(F.length("text") > 80, "long").otherwise("short").alias("tag"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("value"), F.lit(None).cast("binary").alias("image")).coalesce(1).write.format("eventfiles").mode("append").save(to)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "events.out.*").load(to)
    marks = F.size(F.split(F.decode("content", "ISO-8859-1"), "\n[\u0004\u0005]?(?:long|short)")) - 1
    return read.groupBy().agg((F.sum(marks.cast("long")) + F.count("*")).alias("least"), F.max(F.contains(F.decode("content", "ISO-8859-1"), F.lit("long"))).alias("long_ones"), F.min(F.contains(F.decode("content", "ISO-8859-1"), F.lit("brain.Event:2"))).alias("whole"))
