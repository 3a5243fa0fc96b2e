"""XML selection variants, numbering, truncation, searches over settings, parameterised and scored queries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import grid, splits
from ..operators import inference as inf
from ..operators import tokens as tk
from ..operators import xmlspans as xs
from . import tree
from .infer_queries import ids
from .parametric import Query
from .text_queries import TOKENS
from .tree import table
from .xml_queries import panel_xml

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


TAG_XML = "concat('<sd-tag id=\"sdTag', tag_id, '\" entity_type=\"', entity_type, '\" role=\"', role, '\" category=\"', category, '\">', text, '</sd-tag>')"


@query(tree.SQL + f"SELECT panel_id, list_sort(list({TAG_XML})) AS found FROM tag GROUP BY panel_id")
def xml_keep_markup(spark, sf_dir):
    found = xs.select_elements(panel_xml(spark, sf_dir), "panel_id", "xml", "./sd-tag", keep_xml=True)
    return found.where("n is not null").groupBy("panel_id").agg(F.array_sort(F.collect_list("value")).alias("found"))


ROWS = "SELECT event_id, concat('<p>', event_type, '<a>x', event_id, '</a> tail ', '<b>y<c/></b>', CASE WHEN event_id % 3 = 0 THEN '<a>z</a>' ELSE '' END, ' end</p>') AS xml FROM events"


def event_xml(spark, sf_dir):
    k = F.col("event_id").cast("string")
    xml = F.concat(F.lit("<p>"), "event_type", F.lit("<a>x"), k, F.lit("</a> tail <b>y<c/></b>"), F.when(F.col("event_id") % 3 == 0, "<a>z</a>").otherwise(""), F.lit(" end</p>"))
    return table(spark, sf_dir, "events").select("event_id", xml.alias("xml"))


@query("SELECT event_id, unnest(CASE WHEN event_id % 3 = 0 THEN [0, 1, 2] ELSE [0, 1] END) AS n, unnest(CASE WHEN event_id % 3 = 0 THEN [concat('<a>x', event_id, '</a> tail '), '<a>z</a> end', '<b>y<c /></b>'] ELSE [concat('<a>x', event_id, '</a> tail '), '<b>y<c /></b> end'] END) AS value FROM events")
def xml_union_with_tails(spark, sf_dir):
    return xs.select_elements(event_xml(spark, sf_dir), "event_id", "xml", "./a|./b", keep_xml=True, remove_tail=False)


@query("SELECT event_id, 0 AS n, '<b>y<c /></b>' AS value FROM events")
def xml_must_have(spark, sf_dir):
    return xs.select_elements(event_xml(spark, sf_dir), "event_id", "xml", "./a|./b", keep_xml=True, must_have="c")


@query("SELECT event_id, concat('out ', event_type, ' in') AS text, CASE WHEN event_id % 2 = 0 THEN concat('0-', length(event_type) + 7, '-GENEPROD') ELSE concat('0-', length(event_type) + 7, '-TISSUE') END AS span FROM events")
def flatten_nested_tags(spark, sf_dir):
    """Outer tags without a type take that of the tag inside them; those with one keep it."""
    t = F.when(F.col("event_id") % 2 == 0, "").otherwise(" entity_type='tissue'")
    xml = F.concat(F.lit("<p><sd-tag"), t, F.lit(">out "), "event_type", F.lit(" <sd-tag entity_type='gene'>in</sd-tag></sd-tag></p>"))
    found = xs.xml_spans(table(spark, sf_dir, "events").select("event_id", xml.alias("xml")), "event_id", "xml", flatten=True)
    spans = F.filter("spans", lambda s: s["map"] == "entity_types")
    return found.select("event_id", "text", F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ";").alias("span"))


@query(tree.SQL + "SELECT doi, arg_min(fig_label, figure_id) AS fig_label FROM article JOIN figure USING (article_id) GROUP BY doi")
def first_figure(spark, sf_dir):
    t = tree.load(spark, sf_dir)
    return t.article.join(t.figure, "article_id").groupBy("doi").agg(F.min_by("fig_label", "figure_id").alias("fig_label"))


@query("SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS line FROM documents")
def ordinal_ids(spark, sf_dir):
    return splits.numbered(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", name="line").select("doc_id", "line")


@query("SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}]+|[^ \\p{L}\\p{N}]'), lambda w: CAST(concat('0x', substr(md5(w), 1, 4)) AS INTEGER))[1:16] AS input_ids FROM documents ORDER BY doc_id LIMIT 50")
def truncated_examples(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.slice(ids("text"), 1, 16).alias("input_ids")).orderBy("doc_id").limit(50)


@query("SELECT page_id, concat(a, '###tt9HHSlkWoUM###', b) AS twin FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE url END AS a, CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('p', page_id) END AS b FROM pages) WHERE a <> '' AND b IS NOT NULL")
def twins_without_blanks(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("url")).alias("a"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("p"), F.col("page_id").cast("string"))).alias("b"))
    return p.where((F.coalesce("a", F.lit("")) != "") & (F.coalesce("b", F.lit("")) != "")).select("page_id", F.concat("a", F.lit(tx.DELIMITER), "b").alias("twin"))


@query("SELECT CAST(r - 1 AS BIGINT) AS trial, learning_rate, epochs, round(epochs * 1000 * learning_rate - epochs * epochs / 10, 9) AS score FROM (SELECT row_number() OVER (ORDER BY i, epochs) AS r, * FROM (VALUES (1, 0.0001::DOUBLE), (2, 0.00005::DOUBLE), (3, 0.001::DOUBLE)) a(i, learning_rate), (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) b(epochs))")
def setting_search(spark, sf_dir):
    trials = grid.grid(spark, {"learning_rate": [1e-4, 5e-5, 1e-3], "epochs": [1, 2, 3]})
    return grid.search(trials, lambda t: t["epochs"] * 1000 * t["learning_rate"] - t["epochs"] ** 2 / 10).withColumn("score", F.round("score", 9))


@query("SELECT * FROM (VALUES ('NER', 0.025::DOUBLE, 0.025::DOUBLE), ('PANELIZATION', 0.0::DOUBLE, 0.0::DOUBLE), ('GENEPROD_ROLES', 1.0::DOUBLE, 0.0::DOUBLE), ('SMALL_MOL_ROLES', 1.0::DOUBLE, 0.0::DOUBLE)) t(task, masking, replacement)")
def task_settings(spark, sf_dir):
    rows = [(t, grid.for_task(t).masking_probability, grid.for_task(t).replacement_probability) for t in grid.TASKS]
    return spark.createDataFrame(rows, "task string, masking double, replacement double")


@query("SELECT n_name AS doi, n_regionkey AS collection, 'read' AS how FROM nation WHERE n_regionkey >= 1 AND n_regionkey < 4")
def parameterised_query(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("spanloom_nation")
    q = Query("SELECT n_name AS doi, n_regionkey AS collection, :how AS how FROM spanloom_nation WHERE n_regionkey >= :low AND n_regionkey < :high", ("doi", "collection"))
    return q.run(spark, low=1, high=4, how="read")


@query(TOKENS + "SELECT doc_id, pos, CASE WHEN length(word) > 6 THEN 'LONG' ELSE 'O' END AS label, length(word) / 100.0::DOUBLE AS score FROM tok")
def scored_tokens(spark, sf_dir):
    """Tokens through a scorer, batch by batch."""

    def make():
        def score(rows: pd.DataFrame) -> pd.DataFrame:
            n = rows["word"].str.len()
            return pd.DataFrame({"doc_id": rows["doc_id"], "pos": rows["pos"], "label": ["LONG" if x > 6 else "O" for x in n], "score": n / 100.0})

        return score

    return inf.score(tk.tokens(table(spark, sf_dir, "documents")).select("doc_id", "pos", "word"), make, "doc_id long, pos int, label string, score double")


@query("SELECT doi FROM (SELECT concat('a', n_nationkey) AS doi FROM nation WHERE n_nationkey % 2 = 0 EXCEPT SELECT concat('a', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0) UNION ALL (SELECT concat('a', n_nationkey) FROM nation WHERE n_nationkey % 3 = 0 EXCEPT SELECT concat('a', n_nationkey) FROM nation WHERE n_nationkey % 2 = 0)")
def symmetric_difference(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("a"), F.col("n_nationkey").cast("string")).alias("doi"), "n_nationkey")
    return splits.in_one_alone(n.where("n_nationkey % 2 = 0").select("doi"), n.where("n_nationkey % 3 = 0").select("doi"))
