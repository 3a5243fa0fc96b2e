"""From scored tokens to panels, entities and roles: windows, aggregation, grouping, joining, JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import vectors as v
from .tokens import as_of, carried, cut_runs, islands, last_places, words_in_order

MASK = "[MASK]"


class Scorer(Protocol):
    """Scores batches of token rows; made once for each Python worker."""

    def __call__(self, rows: pd.DataFrame) -> pd.DataFrame: ...


def score(tokens: DataFrame, make: Callable[[], Scorer], schema: str) -> DataFrame:
    """tokens through a model; make() loads it in the worker."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for rows in batches:
            yield model(rows)

    return tokens.mapInPandas(each, schema)


def windows(lengths: DataFrame, key: str, n: str, size: int, stride: int) -> DataFrame:
    """Windows of size tokens that overlap by stride: key, chunk, first, last (not included). None for no tokens."""
    if not 0 <= stride < size:
        raise ValueError("stride must be less than the size of a window")
    step = size - stride
    more = F.when(F.col(n) <= size, F.lit(0)).otherwise(F.ceil((F.col(n) - size) / F.lit(step))).cast("int")
    rows = lengths.where(F.col(n) > 0).select(key, n, F.explode(F.sequence(F.lit(0), more)).alias("chunk"))
    return rows.select(key, "chunk", (F.col("chunk") * step).cast("long").alias("first"), F.least(F.col("chunk") * step + size, F.col(n)).cast("long").alias("last"))


def in_windows(chunks: DataFrame, key: str) -> DataFrame:
    """One row for each token place of each window."""
    return chunks.select(key, "chunk", F.explode(F.sequence("first", F.col("last") - 1)).alias("pos"))


def stitch(scored: DataFrame, key: str, *columns: str) -> DataFrame:
    """Of each token place, the row of the lowest window that has it."""
    best = F.min_by(F.struct("chunk", *columns), "chunk")
    return scored.groupBy(key, "pos").agg(best.alias("best")).select(key, "pos", "best.chunk", *[f"best.{c}" for c in columns])


def top_class(scores: Column) -> tuple[Column, Column]:
    """Class (from 0) and probability of a vector of logits."""
    p = v.softmax(scores)
    return v.argmax(scores), F.array_max(p)


def words_first(subs: DataFrame, key: list[str], pos: str, scores: str) -> DataFrame:
    """Each word's class by its first sub-word."""
    one = subs.groupBy(*key).agg(F.min_by(scores, pos).alias("_s"))
    return one.select(*key, v.argmax(F.col("_s")).alias("class"), F.array_max("_s").alias("score"))


def words_max(subs: DataFrame, key: list[str], pos: str, scores: str) -> DataFrame:
    """Each word's class by its most certain sub-word, the first of equals."""
    one = subs.groupBy(*key).agg(F.min_by(scores, F.struct(-F.array_max(scores), F.col(pos))).alias("_s"))
    return one.select(*key, v.argmax(F.col("_s")).alias("class"), F.array_max("_s").alias("score"))


def words_average(subs: DataFrame, key: list[str], pos: str, scores: str, classes: int) -> DataFrame:
    """Each word's class by the mean of its sub-words' scores."""
    one = subs.groupBy(*key).agg(F.array(*[F.avg(F.get(scores, F.lit(i))) for i in range(classes)]).alias("_s"))
    return one.select(*key, v.argmax(F.col("_s")).alias("class"), F.array_max("_s").alias("score"))


def group_entities(tokens: DataFrame, key: str, pos: str, tag: str, score: str | None = None, word: str | None = None) -> DataFrame:
    """Runs of one label, O included: key, entity_group, start, end, the mean score, and the words; a B- always begins one."""
    w = Window.partitionBy(key).orderBy(pos)
    rows = tokens.withColumn("entity_group", lb.bare(F.col(tag)))
    goes_on = (F.lag("entity_group").over(w) == F.col("entity_group")) & ~F.col(tag).startswith("B-")
    rows = islands(rows.withColumn("goes_on", F.coalesce(goes_on, F.lit(False))), key, pos, ~F.col("goes_on"))
    extra = ([F.avg(score).alias("score")] if score else []) + ([words_in_order(pos, word).alias("text")] if word else [])
    return rows.groupBy(key, "island", "entity_group").agg(F.min("start").alias("start"), F.max("end").alias("end"), *extra)


def group_lists(rows: DataFrame, tag: str, score: str | None = None, word: str | None = None, entities: bool = False, items: str = "tokens", name: str = "groups") -> DataFrame:
    """group_entities() within the lists of token_lists(): rows with a list of entity_group, start, end, (score, text) in the order of the tokens; entities: without O."""
    goes_on = lambda x, before: (lb.bare(before[tag]) == lb.bare(x[tag])) & ~x[tag].startswith("B-")
    rows = cut_runs(rows, items, lambda x, before: ~F.coalesce(goes_on(x, before), F.lit(False)), (lambda x: x[tag] != "O") if entities else None, "_runs")

    def one(r: Column) -> Column:
        extra = ([(F.aggregate(r[score], F.lit(0.0), lambda a, x: a + x) / F.size(r)).alias("score")] if score else []) + ([F.array_join(r[word], " ").alias("text")] if word else [])
        return F.struct(lb.bare(F.get(r, F.lit(0))[tag]).alias("entity_group"), F.get(r, F.lit(0))["start"].alias("start"), F.get(r, F.size(r) - 1)["end"].alias("end"), *extra)

    return rows.withColumn(name, F.transform("_runs", one)).drop("_runs")


def panel_lists(rows: DataFrame, groups: str = "groups", name: str = "panels") -> DataFrame:
    """panels() within lists: rows with a list of panel, start, end. groups: a list of group_lists(), where no two O groups stand side by side."""
    is_o = lambda x: x["entity_group"] == "O"
    closed = F.transform(groups, lambda x, i: F.when(is_o(x) | (i == F.size(groups) - 1), F.struct(F.when(is_o(x) & (i > 0), F.get(groups, i - 1)["start"]).otherwise(x["start"]).alias("start"), x["end"].alias("end"))))
    whole = F.filter(closed, lambda x: x.isNotNull())
    return rows.withColumn(name, F.transform(whole, lambda x, i: F.struct(i.cast("int").alias("panel"), x["start"].alias("start"), x["end"].alias("end"))))


def panels(groups: DataFrame, key: str) -> DataFrame:
    """Panels of PANEL_START and O groups in their order: key, panel, start, end.

    A start opens a panel and the next O group closes it; of starts in a row the last
    counts; an O group in front of all starts is a panel too; a start with nothing after
    it closes with itself.
    """
    w = Window.partitionBy(key).orderBy("start")
    rows = groups.withColumns({"opened": F.last(F.when(F.col("entity_group") == "PANEL_START", F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "nth": F.row_number().over(w), "next": F.lead("start").over(w)})
    closes = (F.col("entity_group") == "O") | F.col("next").isNull()
    kept = rows.where(closes & (F.col("opened").isNotNull() | (F.col("nth") == 1)))
    return kept.select(key, (F.row_number().over(w) - 1).cast("int").alias("panel"), F.coalesce("opened", "start").alias("start"), "end")


def entities_in_panels(entities: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Entities with the panel that holds them whole; panels of a document do not overlap."""
    found = as_of(entities, panel.select(key, "start", "panel", F.col("end").alias("panel_end")), key, "start", name="_panel")
    inside = (F.col("start") < F.col("_panel.panel_end")) & (F.col("end") <= F.col("_panel.panel_end"))
    return found.where(inside).select(*entities.columns, F.col("_panel.panel").alias("panel"), F.col("_panel.start").alias("panel_start"), F.col("_panel.panel_end").alias("panel_end"))


def inside_panels(rows: DataFrame, entities: str = "entities", panels: str = "panels") -> DataFrame:
    """entities_in_panels() within lists: rows whose entities are those that a panel holds whole, with panel, its number; both lists in order."""
    rows = last_places(rows, F.col(entities)["start"], F.col(panels)["start"], "_at")
    known = F.transform(entities, lambda x, i: x.withField("_panel", F.get(panels, F.get("_at", i))))
    within = F.filter(known, lambda x: (x["start"] < x["_panel"]["end"]) & (x["end"] <= x["_panel"]["end"]))
    return rows.withColumn(entities, F.transform(within, lambda x: x.dropFields("_panel").withField("panel", x["_panel"]["panel"]))).drop("_at")


def masked_sentences(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts with each span (which begins and ends with tokens; disjoint) as one [MASK]; an empty text stays, null becomes empty.

    Texts are cut at their spans and put together again, so the work follows the text
    and not its product with the number of spans.
    """
    spans = spans.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    return masked_lists(docs.select(key, text).join(spans, key, "left"), key, text, "_spans")


def masked_lists(rows: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """masked_sentences() where a list of the spans (start, end) in order goes with each text; key, masked."""
    given = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(spans)["start"].alias("starts"), F.col(spans)["end"].alias("ends"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, a, b in zip(*batch.columns[1:], strict=True):
                t, a, b = t.as_py(), a.as_py() or [], b.as_py() or []
                out.append(MASK.join(t[i:j] for i, j in zip([0, *b], [*a, len(t)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "masked"])

    return given.mapInArrow(each, f"{key} {dict(rows.dtypes)[key]}, masked string")


def one_per_mask(sentences: DataFrame, masked: str = "masked") -> DataFrame:
    """A row for each mask of a sentence, with its number from 0."""
    n = (F.length(masked) - F.length(F.replace(F.col(masked), F.lit(MASK), F.lit("")))) / len(MASK)
    return sentences.where(F.contains(F.col(masked), F.lit(MASK))).select("*", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("nth"))


def attach_roles(entities: DataFrame, roles: DataFrame, key: str, last: str) -> DataFrame:
    """Entities with the role found for the same span and type, the last by order if several; without one, null."""
    one = roles.groupBy(key, "start", "end", "type").agg(F.max_by("role", last).alias("role"))
    return entities.join(one, [key, "start", "end", "type"], "left")


def tagged_json(panel: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """One JSON array of panels with their entities for each document. entities: key, panel, text, type, start, end, role."""
    fields = ["start", "end", "text", "type", "role"]
    held = entities.groupBy(key, "panel").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("entities"))
    whole = panel.join(held, [key, "panel"], "left").withColumn("entities", F.coalesce("entities", F.array()))
    items = F.array_sort(F.collect_list(F.struct("panel", "start", "end", "entities")))
    return whole.groupBy(key).agg(F.to_json(items, {"ignoreNullFields": "false"}).alias("tagged"))


def panels_json(panel: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """As tagged_json() of entities_in_panels(), with panels and entities gone through once. panel: key, panel, start, end; entities: key, text, type, start, end, role.

    Panels travel with their entities in one order of a document, so nothing is joined
    and panels without entities stay.
    """
    fields = ["start", "end", "text", "type", "role"]
    rows = carried(entities.select(key, *fields), panel.select(key, "start", "panel", F.col("end").alias("panel_end")), key, "start", name="_panel").where(F.col("_panel").isNotNull())
    inside = (F.col("_point") == 1) & (F.col("start") < F.col("_panel.panel_end")) & (F.col("end") <= F.col("_panel.panel_end"))
    held = rows.groupBy(key, F.col("_panel.panel").alias("panel"), F.col("_panel.start").alias("first"), F.col("_panel.panel_end").alias("last")).agg(F.array_sort(F.collect_list(F.when(inside, F.struct(*fields)))).alias("entities"))
    items = F.array_sort(F.collect_list(F.struct("panel", F.col("first").alias("start"), F.col("last").alias("end"), "entities")))
    return held.groupBy(key).agg(F.to_json(items, {"ignoreNullFields": "false"}).alias("tagged"))


def json_lists(rows: DataFrame, key: str, entities: str = "entities", panels: str = "panels") -> DataFrame:
    """panels_json() within lists, both in order: key, tagged. entities: start, end, text, type, role; panels: panel, start, end."""
    rows = inside_panels(rows, entities, panels)
    # Entities of a panel stand side by side.
    rows = cut_runs(rows, entities, lambda x, before: before.isNull() | (x["panel"] != before["panel"]), name="_held")
    rows = rows.withColumn("_first", F.transform("_held", lambda r: F.get(r, F.lit(0))))
    rows = last_places(rows, F.col(panels)["panel"], F.col("_first")["panel"], "_at")
    plain = lambda held: F.transform(held, lambda e: e.dropFields("panel"))
    mine = lambda p, i: F.when(F.get("_first", F.get("_at", i))["panel"] == p["panel"], plain(F.get("_held", F.get("_at", i)))).otherwise(F.slice(plain(F.slice(entities, 1, 1)), 1, 0))
    whole = F.transform(panels, lambda p, i: F.struct(p["panel"].alias("panel"), p["start"].alias("start"), p["end"].alias("end"), mine(p, i).alias("entities")))
    return rows.select(key, F.to_json(whole, {"ignoreNullFields": "false"}).alias("tagged"))
