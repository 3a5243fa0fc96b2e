"""Queries over a document tree: collections, articles, figures, panels and tags as tables with foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def articles(article: DataFrame) -> DataFrame:
    return article.select("article_id", "doi")


def figures_of_articles(article: DataFrame, figure: DataFrame) -> DataFrame:
    """Figures with their article's doi; order by fig_label when shown."""
    return article.select("article_id", "doi").join(figure, "article_id").select("doi", "figure_id", "fig_label", "href", "caption")


def panels_with_tags(figure: DataFrame, panel: DataFrame, tag: DataFrame) -> DataFrame:
    """Panels with the distinct texts of their tags in the caption; panels without such tags are left out."""
    tags = tag.where("in_caption").groupBy("panel_id").agg(F.array_sort(F.collect_set("text")).alias("tags"))
    return figure.select("figure_id", "fig_label").join(panel, "figure_id").join(tags, "panel_id").select("figure_id", "panel_id", "panel_label", "caption", "tags")


def loading_status(article: DataFrame) -> DataFrame:
    return article.select("doi", "status")


def set_status(article: DataFrame, status: str, doi) -> DataFrame:
    """Articles that satisfy a condition on doi with another status."""
    return article.withColumn("status", F.when(doi, status).otherwise(F.col("status")))


def collection_names(collection: DataFrame) -> DataFrame:
    return collection.select("collection_name").distinct()


def collection_by_name(collection: DataFrame, name: str) -> DataFrame:
    return collection.where(F.col("collection_name") == name).select("collection_name", "collection_id")


def full_paths(article: DataFrame, figure: DataFrame, panel: DataFrame, tag: DataFrame) -> DataFrame:
    """Articles below which a whole path down to a tag exists."""
    with_tag = panel.join(tag, "panel_id", "left_semi")
    with_panel = figure.join(with_tag, "figure_id", "left_semi")
    return article.join(with_panel, "article_id", "left_semi")


def delete_tree(article: DataFrame, figure: DataFrame, panel: DataFrame, tag: DataFrame, condition) -> tuple[DataFrame, DataFrame]:
    """Tags that survive deletion of the articles that satisfy the condition, and the number of articles deleted.

    Only articles with a whole path down to a tag are deleted; tags of others stay.
    """
    doomed = full_paths(article.where(condition), figure, panel, tag).select("article_id")
    doomed_panels = panel.join(figure.join(doomed, "article_id", "left_semi"), "figure_id", "left_semi").select("panel_id")
    return tag.join(doomed_panels, "panel_id", "left_anti"), doomed.agg(F.countDistinct("article_id").alias("deleted"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones whose key is not among them."""
    return new.unionByName(old.join(new.select(key), key, "left_anti").select(*new.columns))


def edges(batch: DataFrame, source: DataFrame, target: DataFrame, source_key: str, target_key: str) -> DataFrame:
    """Relationships of a batch whose two ends exist. batch: source, target, rel_type."""
    return batch.join(source.select(F.col(source_key).alias("source")), "source", "left_semi").join(target.select(F.col(target_key).alias("target")), "target", "left_semi")


def dois_of_collections(collection: DataFrame, article: DataFrame) -> DataFrame:
    return collection.join(article, "collection_id").groupBy("collection_name").agg(F.array_sort(F.collect_list("doi")).alias("dois"))


def distinct_ids(papers: DataFrame, doi: str = "doi", other: str = "id") -> DataFrame:
    """Each paper's identifier once: its doi, or its other id where that is missing or empty; papers with neither have none."""
    found = F.coalesce(F.when(F.col(doi) != "", F.col(doi)), F.when(F.col(other) != "", F.col(other)))
    return papers.select(found.alias("paper")).where("paper is not null").dropDuplicates()


def article_properties(collection: DataFrame, article: DataFrame, figure: DataFrame) -> DataFrame:
    """The properties of articles, with the number of their figures."""
    n = figure.groupBy("article_id").agg(F.count("*").alias("nb_figures"))
    return collection.join(article, "collection_id").join(n, "article_id", "left").select("collection_name", "doi", "title", "journal_name", "pub_date", "pmid", "pmcid", "import_id", "pub_year", F.coalesce("nb_figures", F.lit(0)).cast("long").alias("nb_figures"))


def figure_list(article: DataFrame, figure: DataFrame, panel: DataFrame) -> DataFrame:
    """Distinct labels of figures with a caption and a panel, by article."""
    with_panel = figure.where("caption <> ''").join(panel, "figure_id", "left_semi")
    return article.join(with_panel, "article_id").groupBy("doi").agg(F.array_sort(F.collect_set("fig_label")).alias("fig_labels"))


def figure_properties(article: DataFrame, figure: DataFrame) -> DataFrame:
    return article.select("article_id", "doi").join(figure, "article_id").select("doi", "fig_label", tx.part("href", "=", 1).alias("figure_key"), "caption")


def panel_list(figure: DataFrame, panel: DataFrame, tag: DataFrame) -> DataFrame:
    """Labels of panels that have a tag, in the order of their number as a string."""
    with_tag = panel.join(tag, "panel_id", "left_semi").withColumn("number", tx.part("panel_label", "-", 2))
    ordered = F.array_sort(F.collect_list(F.struct("number", "panel_label")))
    return figure.join(with_tag, "figure_id").groupBy("fig_label").agg(F.transform(ordered, lambda x: x["panel_label"]).alias("panels"))


def panel_properties(article: DataFrame, figure: DataFrame, panel: DataFrame) -> DataFrame:
    """The properties of panels; figure_id is the figure's label, as the graph gives it."""
    both = article.join(figure.drop("caption", "href"), "article_id").join(panel, "figure_id")
    return both.select(F.col("doi").alias("paper_doi"), F.col("fig_label").alias("figure_label"), F.col("fig_label").alias("figure_id"), "panel_id", "panel_label", tx.part("panel_label", "-", 1).alias("panel_number"), "caption", "formatted_caption", "href", "coords")


def captions_by_text(rows: DataFrame, by: list[str], caption: str, key: str) -> DataFrame:
    """Rows grouped by text and given back one by one: by, n (rows of the group), caption, key; repeated ones stay."""
    # Counted apart and joined back, so that a text that many rows have is never one row.
    counts = rows.groupBy(*by).agg(F.count("*").cast("int").alias("n")).withColumnsRenamed({c: f"_{c}" for c in by})
    same = reduce(lambda x, y: x & y, [rows[c].eqNullSafe(counts[f"_{c}"]) for c in by])
    return rows.join(counts, same).select(*by, "n", caption, key)


def tag_list(tag: DataFrame) -> DataFrame:
    """Tags of each panel as an array of structs, by tag number."""
    items = F.array_sort(F.collect_list(F.struct("tag_number", "tag_id", "text", "entity_type", "role")))
    return tag.groupBy("panel_id").agg(items.alias("tags"))


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def nested(collection: DataFrame, article: DataFrame, figure: DataFrame, panel: DataFrame) -> DataFrame:
    """Articles with their figures and panels as nested arrays in natural order."""
    panels = panel.groupBy("figure_id").agg(F.array_sort(F.collect_list(F.struct(tx.natural_key("panel_label").alias("pos"), "panel_id", "panel_label"))).alias("panels"))
    figures = figure.join(panels, "figure_id", "left").groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct(tx.natural_key("fig_label").alias("pos"), "figure_id", "fig_label", F.coalesce("panels", F.array()).alias("panels")))).alias("figures"))
    return collection.join(article, "collection_id").join(figures, "article_id", "left")


def causal_statements(panel: DataFrame, tag: DataFrame) -> DataFrame:
    """For each panel with measured, controlled and assay tags in its caption: their distinct texts, serialised.

    One grouping takes the place of three patterns on the same panel: what is asked
    for is the distinct sets of each kind, all three not empty.
    """
    kind = tx.geneprod("entity_type")
    tagged = lambda cond, name: F.collect_set(F.when(cond, F.concat(F.lit("<"), kind, F.lit("> "), F.col("text"), F.lit(" </"), kind, F.lit(">")))).alias(name)
    sets = tag.where("in_caption").groupBy("panel_id").agg(tagged(F.col("role") == "assayed", "observations"), tagged(F.col("role") == "intervention", "interventions"), F.collect_set(F.when(F.col("category") == "assay", F.col("text"))).alias("methods"))
    full = sets.where((F.size("observations") > 0) & (F.size("interventions") > 0) & (F.size("methods") > 0))
    phrase = F.concat(F.lit("Effect of "), F.array_join(F.array_sort("interventions"), " or "), F.lit(" on "), F.array_join(F.array_sort("observations"), " or "), F.lit(" by "), F.array_join(F.array_sort("methods"), ", "), F.lit("."))
    return full.join(panel, "panel_id").select("panel_id", "figure_id", tx.strip_html("caption").alias("caption"), phrase.alias("statement"))


def split_by_quota(keys: DataFrame, key: str, fractions: tuple[float, float], cap: int | None = None, names: tuple[str, str, str] = ("train", "validation", "test")) -> DataFrame:
    """Keys with a split: the first part of a pseudo-random order (by md5 of the key), the second, and the rest.

    Only the key column is ranked, in two steps: hash prefixes are counted, and ranks
    within a prefix are added to the number of keys before it, so that no single task
    orders all keys.
    """
    # The order is by md5 alone (as hexadecimal text), so that any engine can repeat it.
    hashed = keys.select(key, F.md5(F.col(key).cast("string")).alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    sizes = hashed.groupBy("bucket").agg(F.count("*").alias("n"))
    total = Window.orderBy("bucket")  # 4096 buckets at most
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(total.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(total.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key)) + F.col("before")
    first, second = (F.floor(F.col("all") * F.lit(float(f))) for f in fractions)
    if cap is not None:
        first, second = F.least(first, F.lit(cap)), F.least(second, F.lit(cap))
    place = hashed.join(F.broadcast(before), "bucket").withColumn("rank", rank)
    return place.select(key, F.when(F.col("rank") <= first, names[0]).when(F.col("rank") <= first + second, names[1]).otherwise(names[2]).alias("split"))


def causal_prompts(panel: DataFrame, tag: DataFrame) -> DataFrame:
    """Prompts from causal statements, by split of the panels."""
    splits = split_by_quota(panel.select("panel_id"), "panel_id", (0.8, 0.1))
    made = causal_statements(panel, tag).join(splits, "panel_id")
    return made.select(F.col("split").alias("subset"), tx.prompt(F.lit("Caption: "), "caption", F.lit(" ### "), "statement", F.lit(" [END]")).alias("text"))
