"""Graph queries over the document tree."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as g
from . import tree

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None, prelude: bool = True):
    """Register a function of a Tree under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(tree.load(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = (tree.SQL if prelude else "") + sql
        return f

    return add


CAUSAL = """, sets AS (
  SELECT panel_id,
    list_sort(list(DISTINCT concat('<', e, '> ', text, ' </', e, '>')) FILTER (role = 'assayed')) AS o,
    list_sort(list(DISTINCT concat('<', e, '> ', text, ' </', e, '>')) FILTER (role = 'intervention')) AS i,
    list_sort(list(DISTINCT text) FILTER (category = 'assay')) AS m
  FROM (SELECT *, regexp_replace(entity_type, '^(gene|protein)$', 'geneprod') AS e FROM tag WHERE in_caption) GROUP BY panel_id
), statements AS (
  SELECT panel_id, figure_id, regexp_replace(caption, '<[^>]*>', '', 'g') AS caption,
    concat('Effect of ', array_to_string(i, ' or '), ' on ', array_to_string(o, ' or '), ' by ', array_to_string(m, ', '), '.') AS statement
  FROM sets JOIN panel USING (panel_id) WHERE len(o) > 0 AND len(i) > 0 AND len(m) > 0
)
"""


@query(CAUSAL + "SELECT * FROM statements")
def causal_statements(t):
    return g.causal_statements(t.panel, t.tag)


@query(CAUSAL + """, ranked AS (
  SELECT panel_id, row_number() OVER (ORDER BY md5(CAST(panel_id AS VARCHAR)), panel_id) AS r, count(*) OVER () AS n FROM panel
)
SELECT CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'validation' ELSE 'test' END AS subset,
       concat('Caption: ', caption, ' ### ', statement, ' [END]') AS text
FROM statements JOIN ranked USING (panel_id)""")
def causal_prompts_by_split(t):
    return g.causal_prompts(t.panel, t.tag)


@query("SELECT article_id, doi FROM article")
def all_articles(t):
    return g.articles(t.article)


@query("SELECT doi, figure_id, fig_label, href, caption FROM article JOIN figure USING (article_id)")
def figures_by_article(t):
    return g.figures_of_articles(t.article, t.figure)


@query("""SELECT figure_id, panel_id, panel_label, panel.caption, tags FROM figure JOIN panel USING (figure_id)
JOIN (SELECT panel_id, list_sort(list(DISTINCT text)) AS tags FROM tag WHERE in_caption GROUP BY panel_id) USING (panel_id)""")
def panels_with_tags(t):
    return g.panels_with_tags(t.figure, t.panel, t.tag)


@query("SELECT doi, status FROM article")
def article_status(t):
    return g.loading_status(t.article)


@query("SELECT * REPLACE (CASE WHEN doi LIKE '10.1/%' THEN 'checked' ELSE status END AS status) FROM article")
def set_status(t):
    return g.set_status(t.article, "checked", F.col("doi").like("10.1/%"))


@query("SELECT DISTINCT collection_name FROM collection")
def collection_names(t):
    return g.collection_names(t.collection)


@query("SELECT collection_name, collection_id FROM collection WHERE collection_name = 'ASIA'")
def collection_by_name(t):
    return g.collection_by_name(t.collection, "ASIA")


DOOMED = """, doomed AS (
  SELECT DISTINCT a.article_id FROM article a JOIN figure f USING (article_id) JOIN panel p USING (figure_id) JOIN tag USING (panel_id) WHERE a.status = 'deleting'
)
"""


@query(DOOMED + "SELECT tag_id, panel_id FROM tag WHERE panel_id NOT IN (SELECT panel_id FROM panel JOIN figure USING (figure_id) JOIN doomed USING (article_id))")
def delete_tree_survivors(t):
    return g.delete_tree(t.article, t.figure, t.panel, t.tag, F.col("status") == "deleting")[0].select("tag_id", "panel_id")


@query(DOOMED + "SELECT count(DISTINCT article_id) AS deleted FROM doomed")
def delete_tree_count(t):
    return g.delete_tree(t.article, t.figure, t.panel, t.tag, F.col("status") == "deleting")[1]


@query(""", new AS (SELECT * REPLACE (concat(title, ' (new)') AS title) FROM article WHERE article_id % 2 = 0 UNION ALL SELECT * REPLACE (article_id + 1000 AS article_id, concat(doi, '-b') AS doi) FROM article WHERE article_id % 5 = 0)
SELECT * FROM new UNION ALL SELECT * FROM article WHERE doi NOT IN (SELECT doi FROM new)""")
def upsert_articles(t):
    changed = t.article.where("article_id % 2 = 0").withColumn("title", F.concat("title", F.lit(" (new)")))
    added = t.article.where("article_id % 5 = 0").withColumns({"article_id": F.col("article_id") + 1000, "doi": F.concat("doi", F.lit("-b"))})
    return g.upsert(t.article, changed.unionByName(added), "doi")


@query(""", batch AS (SELECT figure_id * 2 AS source, panel_id + 7 AS target, 'has_panel' AS rel_type FROM panel)
SELECT * FROM batch WHERE source IN (SELECT figure_id FROM figure) AND target IN (SELECT panel_id FROM panel)""")
def edge_batch(t):
    batch = t.panel.select((F.col("figure_id") * 2).alias("source"), (F.col("panel_id") + 7).alias("target"), F.lit("has_panel").alias("rel_type"))
    return g.edges(batch, t.figure, t.panel, "figure_id", "panel_id").select("source", "target", "rel_type")


@query("SELECT collection_name, list_sort(list(doi)) AS dois FROM collection JOIN article USING (collection_id) GROUP BY collection_name")
def collection_dois(t):
    return g.dois_of_collections(t.collection, t.article)


@query("""SELECT collection_name, doi, title, journal_name, pub_date, pmid, pmcid, import_id, pub_year, CAST(coalesce(n, 0) AS BIGINT) AS nb_figures FROM collection JOIN article USING (collection_id)
LEFT JOIN (SELECT article_id, count(*) AS n FROM figure GROUP BY article_id) USING (article_id)""")
def article_props(t):
    return g.article_properties(t.collection, t.article, t.figure)


@query("""SELECT doi, list_sort(list(DISTINCT fig_label)) AS fig_labels FROM article JOIN figure USING (article_id)
WHERE caption <> '' AND figure_id IN (SELECT figure_id FROM panel) GROUP BY doi""")
def figure_list(t):
    return g.figure_list(t.article, t.figure, t.panel)


@query("SELECT doi, fig_label, nullif(string_split(href, '=')[2], '') AS figure_key, caption FROM article JOIN figure USING (article_id)")
def figure_props(t):
    return g.figure_properties(t.article, t.figure)


@query("""SELECT fig_label, list(panel_label ORDER BY string_split(panel_label, '-')[3], panel_label) AS panels FROM figure JOIN panel USING (figure_id)
WHERE panel_id IN (SELECT panel_id FROM tag) GROUP BY fig_label""")
def panel_list(t):
    return g.panel_list(t.figure, t.panel, t.tag)


@query("SELECT doi AS paper_doi, fig_label AS figure_label, fig_label AS figure_id, panel_id, panel_label, split_part(panel_label, '-', 2) AS panel_number, panel.caption, formatted_caption, panel.href, coords FROM article JOIN figure USING (article_id) JOIN panel USING (figure_id)")
def panel_props(t):
    return g.panel_properties(t.article, t.figure, t.panel)


@query("SELECT panel_id, array_to_string(list(concat(tag_number, ' ', tag_id, ' ', text, ' ', entity_type, ' ', role) ORDER BY tag_number, tag_id, text, entity_type, role), '; ') AS tags FROM tag GROUP BY panel_id")
def tag_list(t):
    shown = F.transform("tags", lambda x: F.concat(x["tag_number"].cast("string"), F.lit(" "), x["tag_id"], F.lit(" "), x["text"], F.lit(" "), x["entity_type"], F.lit(" "), x["role"]))
    return g.tag_list(t.tag).select("panel_id", F.array_join(shown, "; ").alias("tags"))


@query("SELECT count(*) > 0 AS found FROM article WHERE doi = '10.0/ALGERIA'")
def node_exists(t):
    return t.article.where("doi = '10.0/ALGERIA'").agg((F.count("*") > 0).alias("found"))


@query("""SELECT doi, array_to_string(list(concat(fig_label, ':', coalesce(n, 0)) ORDER BY k), ' ') AS figures FROM
(SELECT doi, fig_label, n, concat(lower(regexp_extract(fig_label, '^[^0-9]*')), lpad(regexp_extract(fig_label, '[0-9]+'), 12, '0')) AS k FROM article JOIN figure USING (article_id)
 LEFT JOIN (SELECT figure_id, count(*) AS n FROM panel GROUP BY figure_id) USING (figure_id)) GROUP BY doi""")
def nested_tree(t):
    made = g.nested(t.collection, t.article, t.figure, t.panel).where("figures is not null")
    shown = F.transform("figures", lambda f: F.concat(f["fig_label"], F.lit(":"), F.size(f["panels"]).cast("string")))
    return made.select("doi", F.array_join(shown, " ").alias("figures"))


@query("SELECT entity_type, role, CAST(count(*) OVER (PARTITION BY entity_type, role) AS INTEGER) AS n, text, tag_id FROM tag")
def captions_by_text(t):
    return g.captions_by_text(t.tag, ["entity_type", "role"], "text", "tag_id")


@query("SELECT DISTINCT CASE WHEN o_orderkey % 3 = 0 THEN concat('sd', o_custkey) ELSE concat('10.1/', o_custkey) END AS paper FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 0", prelude=False)
def distinct_ids(t):
    """Papers of several lists, each once, some by another id than a doi."""
    key = F.regexp_extract("panel_label", "-([0-9]+)$", 1).cast("long")
    papers = t.panel.select(F.when((key % 5 != 0) & (key % 3 != 0), F.concat(F.lit("10.1/"), F.col("figure_id").cast("string"))).otherwise("").alias("doi"), F.when(key % 3 == 0, F.concat(F.lit("sd"), F.col("figure_id").cast("string"))).alias("id"))
    return g.distinct_ids(papers)
