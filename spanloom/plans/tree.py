"""The document tree over the star-schema tables, in DataFrames and in SQL.

region = collection, nation = article, customer = figure, orders = panel,
lineitem = tag. Both sides define the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Further properties, the same expressions on both sides.
ARTICLE = "concat('Journal of ', n_name) AS journal_name; concat(2000 + n_nationkey, '-01-31') AS pub_date; concat('PM', n_nationkey) AS pmid; CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('PMC', n_nationkey) END AS pmcid; '' AS import_id; concat(2000 + n_nationkey, '') AS pub_year"
PANEL = "concat('<sd-panel>', o_orderpriority, ' </sd-panel>') AS formatted_caption; concat('x=', o_custkey % 100, ', y=', o_orderkey % 100) AS coords"


@dataclass(frozen=True)
class Tree:
    collection: DataFrame
    article: DataFrame
    figure: DataFrame
    panel: DataFrame
    tag: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str) -> Tree:
    t = lambda name: table(spark, sf_dir, name)
    return Tree(
        collection=t("region").selectExpr("r_regionkey AS collection_id", "r_name AS collection_name"),
        article=t("nation").selectExpr("n_nationkey AS article_id", "n_regionkey AS collection_id", "concat('10.', n_regionkey, '/', n_name) AS doi", "n_name AS title", "CASE WHEN n_nationkey % 3 = 0 THEN 'deleting' ELSE 'loaded' END AS status", *ARTICLE.split("; ")),
        figure=t("customer").selectExpr("c_custkey AS figure_id", "c_nationkey AS article_id", "c_name AS fig_label", "CASE WHEN c_acctbal < 0 THEN '' ELSE concat('<b>', c_mktsegment, '</b> by <i>', c_name, '</i>') END AS caption", "concat('fig?id=', c_custkey) AS href"),
        panel=t("orders").selectExpr("o_orderkey AS panel_id", "o_custkey AS figure_id", "concat(o_orderpriority, '-', o_orderkey) AS panel_label", "concat('<p>', o_orderpriority, '</p>') AS caption", "concat('panel?id=', o_orderkey) AS href", *PANEL.split("; ")),
        tag=t("lineitem").selectExpr("concat(l_orderkey, '-', l_linenumber) AS tag_id", "l_orderkey AS panel_id", "l_linenumber AS tag_number", "l_linestatus = 'F' AS in_caption", "CASE l_returnflag WHEN 'A' THEN 'assayed' WHEN 'R' THEN 'intervention' ELSE '' END AS role", "CASE WHEN l_returnflag = 'N' THEN 'assay' ELSE '' END AS category", "CASE l_partkey % 4 WHEN 0 THEN 'gene' WHEN 1 THEN 'protein' WHEN 2 THEN 'geneprod' ELSE 'molecule' END AS entity_type", "concat('part', l_partkey % 50) AS text"),
    )


#: The same tables for the oracle.
SQL = """WITH collection AS (SELECT r_regionkey AS collection_id, r_name AS collection_name FROM region),
article AS (SELECT n_nationkey AS article_id, n_regionkey AS collection_id, concat('10.', n_regionkey, '/', n_name) AS doi, n_name AS title, CASE WHEN n_nationkey % 3 = 0 THEN 'deleting' ELSE 'loaded' END AS status, """ + ARTICLE.replace("; ", ", ") + """ FROM nation),
figure AS (SELECT c_custkey AS figure_id, c_nationkey AS article_id, c_name AS fig_label, CASE WHEN c_acctbal < 0 THEN '' ELSE concat('<b>', c_mktsegment, '</b> by <i>', c_name, '</i>') END AS caption, concat('fig?id=', c_custkey) AS href FROM customer),
panel AS (SELECT o_orderkey AS panel_id, o_custkey AS figure_id, concat(o_orderpriority, '-', o_orderkey) AS panel_label, concat('<p>', o_orderpriority, '</p>') AS caption, concat('panel?id=', o_orderkey) AS href, """ + PANEL.replace("; ", ", ") + """ FROM orders),
tag AS (SELECT concat(l_orderkey, '-', l_linenumber) AS tag_id, l_orderkey AS panel_id, l_linenumber AS tag_number, l_linestatus = 'F' AS in_caption, CASE l_returnflag WHEN 'A' THEN 'assayed' WHEN 'R' THEN 'intervention' ELSE '' END AS role, CASE WHEN l_returnflag = 'N' THEN 'assay' ELSE '' END AS category, CASE l_partkey % 4 WHEN 0 THEN 'gene' WHEN 1 THEN 'protein' WHEN 2 THEN 'geneprod' ELSE 'molecule' END AS entity_type, concat('part', l_partkey % 50) AS text FROM lineitem)
"""


def column(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n) for n in names])
