"""Readers: XML corpora, lines, JSON lines, CSV, REST answers as JSON."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from . import schemas


def xml_corpus(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """path, xml: one row for each .xml, .XML or .nxml file of a folder."""
    read = spark.read.option("pathGlobFilter", "*.{xml,XML,nxml}").option("recursiveFileLookup", str(recursive).lower())
    return read.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def split_corpus(spark: SparkSession, folder: str, splits=("train", "eval", "test")) -> DataFrame:
    """xml_corpus() of a subfolder for each split, with the split's name."""
    parts = [xml_corpus(spark, f"{folder}/{s}").withColumn("split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def split_files(spark: SparkSession, path: str) -> DataFrame:
    """split, name, xml: what writers.split_files() has written."""
    return spark.read.text(path, wholetext=True).select("split", "name", F.regexp_replace("value", r"\n\z", "").alias("xml"))


def lines(spark: SparkSession, path: str, skip_blank: bool = True) -> DataFrame:
    """value: stripped lines."""
    rows = spark.read.text(path).select(tx.stripped("value").alias("value"))
    return rows.where("value <> ''") if skip_blank else rows


def twins(rows: DataFrame, value: str = "value") -> DataFrame:
    """left, right: the two texts of twin lines."""
    parts = F.split(F.col(value), tx.DELIMITER)
    return rows.select(F.get(parts, 0).alias("left"), F.get(parts, 1).alias("right"))


def json_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Rows of JSON lines by a schema of schemas.BY_NAME, with an ordinal (its order, not without gaps)."""
    return spark.read.schema(schemas.BY_NAME[name]).json(path).withColumn("id", F.monotonically_increasing_id())


def seq2seq_csv(spark: SparkSession, path: str) -> DataFrame:
    """Full rows of a CSV file, with the split that subset names; rows of unknown subsets are left out."""
    rows = spark.read.schema(schemas.SEQ2SEQ).csv(path, header=True, multiLine=True, escape='"').na.drop()
    return rows.withColumn("split", tx.split_name("subset")).where("split is not null")


#: Bytes of a member that are read at once; a member beyond it comes in parts that end with lines.
MEMBER_PART = 16 << 20


def zipped(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = MEMBER_PART) -> DataFrame:
    """archive, name, part, value: the texts of the members of zip archives whose names fit a pattern (of *, ? and [...]).

    A task unpacks an archive at a time, and its members piece by piece: a large one comes as
    several rows, numbered by part, that end with lines. Bytes that are no UTF-8 become U+FFFD.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_buffer())) as held:
                    for name in sorted(held.namelist()):
                        if name.endswith("/") or not fnmatch.fnmatchcase(name, pattern):
                            continue
                        with held.open(name) as member:
                            for k, text in enumerate(_in_lines(member, part_bytes)):
                                yield pa.RecordBatch.from_arrays([pa.array([archive]), pa.array([name]), pa.array([k], pa.int32()), pa.array([text])], names=["archive", "name", "part", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(each, "archive string, name string, part int, value string")


def _in_lines(member, part_bytes: int) -> Iterator[str]:
    """A member's text in pieces of about part_bytes; one at least."""
    rest, given = b"", False
    while more := member.read(part_bytes):
        head, line, rest = (rest + more).rpartition(b"\n")
        if line:
            given = True
            yield (head + line).decode(errors="replace")
    if rest or not given:
        yield rest.decode(errors="replace")


def inline(spark: SparkSession, texts: list[str]) -> DataFrame:
    """doc_id, text: every text of a list."""
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rest_articles(answers: DataFrame, body: str = "body") -> DataFrame:
    """Article properties from REST answers as JSON; what is missing is empty."""
    a = answers.select(F.from_json(body, schemas.REST_ARTICLE).alias("a"))
    text = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(""))
    return a.select(text("doi").alias("doi"), text("title").alias("title"), text("journal").alias("journal_name"), text("pub_date").alias("pub_date"), text("pmid").alias("pmid"), text("pmcid").alias("pmcid"), F.lit("").alias("import_id"), text("year").alias("pub_year"), F.lit("").alias("abstract"), F.coalesce(F.col("a.nbFigures").try_cast("int"), F.lit(0)).alias("nb_figures"), F.lit("rest").alias("source"))


def figure_indices(articles: DataFrame) -> DataFrame:
    """doi, idx: the figures of each article by number from 1; none for articles without figures."""
    return articles.where("nb_figures > 0").select("doi", F.explode(F.sequence(F.lit(1), F.col("nb_figures"))).alias("idx"))


def rest_figures(answers: DataFrame, body: str = "body", doi: str = "doi") -> DataFrame:
    """Figure properties from REST answers as JSON, with the ids of their panels; the title is made from the caption where there is none."""
    f = answers.select(F.col(doi).alias("paper_doi"), F.from_json(body, schemas.REST_FIGURE).alias("f"))
    text = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    return f.select("paper_doi", text("label").alias("figure_label"), text("figure_id").alias("figure_id"), tx.figure_title(F.col("f.fig_title"), text("caption")).alias("figure_title"), text("caption").alias("caption"), text("href").alias("href"), F.coalesce("f.panels", F.array()).alias("panels"))


def rest_panels(answers: DataFrame, body: str = "body") -> DataFrame:
    """The current panel of each answer, found by id among its figure's panels, with its tags."""
    a = answers.select(F.from_json(body, schemas.REST_PANEL).alias("a"))
    p = a.select("a.*", F.get(F.filter("a.figure.panels", lambda x: x["panel_id"] == F.col("a.current_panel_id")), F.lit(0)).alias("p"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return p.where("p is not null").select(text("paper.doi").alias("paper_doi"), text("figure.label").alias("figure_label"), text("figure.figure_id").alias("figure_id"), text("p.panel_id").alias("panel_id"), text("p.label").alias("panel_label"), text("p.panel_number").alias("panel_number"), text("p.caption").alias("caption"), F.coalesce(tx.panel_caption("p.formatted_caption"), F.lit("")).alias("formatted_caption"), text("p.href").alias("href"), F.coalesce(tx.map_text("p.coords"), F.lit("")).alias("coords"), F.coalesce("p.tags", F.array()).alias("tags"))


def rest_tags(panels: DataFrame) -> DataFrame:
    """Tags of rest_panels(), one row each."""
    t = panels.select("panel_id", F.explode("tags").alias("t"))
    many = lambda c: F.coalesce(tx.joined(f"t.{c}"), F.lit(""))
    text = lambda c: F.coalesce(F.col(f"t.{c}"), F.lit(""))
    return t.select("panel_id", text("id").alias("tag_id"), text("category").alias("category"), text("type").alias("entity_type"), text("role").alias("role"), text("text").alias("text"), many("external_ids").alias("ext_ids"), text("normalized_text").alias("norm_text"), many("external_databases").alias("ext_dbs"), F.coalesce(F.col("t.in_caption").isin("Y", "true", "True"), F.lit(False)).alias("in_caption"), many("external_names").alias("ext_names"), many("external_tax_ids").alias("ext_tax_ids"), many("external_tax_names").alias("ext_tax_names"), many("external_urls").alias("ext_urls"))


def article_xml_of_answers(articles: DataFrame, figures: DataFrame, panels: DataFrame) -> DataFrame:
    """doi, xml: articles put together from answers for articles (body), figures (doi, body) and panels (figure_id, body); children in natural order of their labels."""
    from ..operators.xmlspans import escape

    p = rest_panels(panels).select("figure_id", "panel_label", "panel_id", "formatted_caption")
    inner = lambda rows, by, order: rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "xml"))), lambda x: x["xml"]), "").alias("inner"))
    p = p.select("figure_id", tx.natural_key("panel_label").alias("k"), "panel_id", F.col("formatted_caption").alias("xml"))
    f = rest_figures(figures).join(inner(p, "figure_id", ["k", "panel_id"]), "figure_id", "left")
    shown = F.concat(F.lit('<fig id="'), escape(F.col("figure_id")), F.lit('"><title>'), escape(F.col("figure_title")), F.lit("</title><label>"), escape(F.col("figure_label")), F.lit('</label><graphic href="'), escape(F.col("href")), F.lit('"/>'), F.coalesce("inner", F.lit("")), F.lit("</fig>"))
    f = f.select("paper_doi", tx.natural_key("figure_label").alias("k"), "figure_id", shown.alias("xml"))
    a = rest_articles(articles).join(inner(f, "paper_doi", ["k", "figure_id"]), F.col("doi") == F.col("paper_doi"), "left")
    return a.select("doi", F.concat(F.lit('<article doi="'), escape(F.col("doi")), F.lit('">'), F.coalesce("inner", F.lit("")), F.lit("</article>")).alias("xml"))


def with_abstracts(articles: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Articles with the abstract that another table has for their doi; empty if none. abstracts: doi, abstract."""
    one = abstracts.groupBy("doi").agg(F.max("abstract").alias("found"))
    return articles.join(one, "doi", "left").withColumn("abstract", F.coalesce("found", F.lit(""))).drop("found")


PROTEIN = "accession string, protein struct<recommendedName:struct<fullName:struct<value:string>,shortName:array<struct<value:string>>>,alternativeName:array<struct<fullName:struct<value:string>,shortName:array<struct<value:string>>>>>"


def protein_names(answers: DataFrame, body: str = "body") -> DataFrame:
    """accession, recommended_name, short_names from protein records as JSON."""
    a = answers.select(F.from_json(body, PROTEIN).alias("a"))
    values = lambda c: F.transform(F.coalesce(c, F.array()), lambda x: x["value"])
    others = F.flatten(F.transform(F.coalesce("a.protein.alternativeName", F.array()), lambda n: F.transform(F.coalesce(n["shortName"], F.array()), lambda x: x["value"])))
    return a.select("a.accession", F.col("a.protein.recommendedName.fullName.value").alias("recommended_name"), F.array_distinct(F.concat(values(F.col("a.protein.recommendedName.shortName")), others)).alias("short_names"))
