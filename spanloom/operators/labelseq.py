"""Label sequences: IOB2, alignment to sub-words, runs, masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from .tokens import as_of, cut_runs, islands, last_places, rows_of, with_field, words_in_order


def iob2(tokens: DataFrame, label: str, key: str = "doc_id", pos: str = "pos", name: str = "iob2") -> DataFrame:
    """O stays; a label that starts or changes gets B-, one that goes on I-. Labels alone are compared, so touching entities of one type merge."""
    return tokens.withColumn(name, _mark(F.col(label), F.lag(label).over(Window.partitionBy(key).orderBy(pos))))


def iob2_lists(rows: DataFrame, label: str, items: str = "tokens", name: str = "iob2") -> DataFrame:
    """iob2() of the tokens of token_lists(), within their lists."""
    return rows.withColumn(items, with_field(items, name, lambda x, i: _mark(x[label], F.get(items, i - 1)[label])))


def _mark(label: Column, before: Column) -> Column:
    return F.when(label == "O", "O").when(before.isNull() | (before != label), F.concat(F.lit("B-"), label)).otherwise(F.concat(F.lit("I-"), label))


def span_labels(tokens: DataFrame, spans: DataFrame, key: str = "doc_id", whole: bool = True, pos: str = "pos") -> DataFrame:
    """Tokens with the label of the span over their first character, or, for boundaries (not whole), of the first span that starts inside them; O elsewhere.

    spans: key, start, end, label; spans of a document do not overlap.
    """
    if whole:
        found = as_of(tokens, spans.select(key, "start", "end", "label"), key, "start", name="_span")
        return found.select(*tokens.columns, F.when(F.col("start") < F.col("_span.end"), F.col("_span.label")).otherwise("O").alias("label"))
    starts = as_of(spans.select(key, F.col("start").alias("_s"), "label"), tokens.select(key, "start", "end", pos), key, "_s", name="_token")
    inside = starts.where(F.col("_s") < F.col("_token.end")).groupBy(key, F.col(f"_token.{pos}").alias(pos)).agg(F.min_by("label", "_s").alias("label"))
    return tokens.join(inside, [key, pos], "left").select(*tokens.columns, F.coalesce("label", F.lit("O")).alias("label"))


def goes_on(tag: Column, before: Column) -> Column:
    """True where an I- follows a tag of its own label."""
    return F.coalesce(tag.startswith("I") & (before != "O") & (lb.bare(before) == lb.bare(tag)), F.lit(False))


def runs_of(tokens: DataFrame, tags: Sequence[str], key: str | list[str] = "doc_id", pos: str = "pos", strict: bool = False, word: str | None = None) -> DataFrame:
    """Entity spans of several IOB2 tags of the same tokens: key, nth (the tag's number), label, first, last (positions), and with word their text.

    All tags go along the tokens in one sort; what no tag marks goes before rows are
    told apart by tag, so that only entities' tokens are repeated and grouped.
    """
    keys = [key] if isinstance(key, str) else key
    along = Window.partitionBy(*keys).orderBy(pos)
    more = [word] if word else []
    rows = tokens.select(*keys, pos, *more, *[F.col(t).alias(f"_tag{i}") for i, t in enumerate(tags)], *[F.lag(t).over(along).alias(f"_before{i}") for i, t in enumerate(tags)])
    marked = F.lit(False)
    for i in range(len(tags)):
        marked |= F.coalesce(F.col(f"_tag{i}") != "O", F.lit(False))
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sides = [F.struct(F.lit(i).alias("nth"), F.col(f"_tag{i}").alias("tag"), F.sum((~goes_on(F.col(f"_tag{i}"), F.col(f"_before{i}"))).cast("int")).over(upto).alias("island")) for i in range(len(tags))]
    rows = rows.where(marked).select(*keys, pos, *more, F.array(*sides).alias("_sides")).select(*keys, pos, *more, F.explode("_sides").alias("_side"))
    rows = rows.select(*keys, pos, *more, "_side.*").where("tag <> 'O'")
    found = rows.groupBy(*keys, "nth", "island").agg(F.min_by("tag", pos).alias("head"), F.min(pos).alias("first"), F.max(pos).alias("last"), *([words_in_order(pos, word).alias("text")] if word else []))
    found = found.where(F.col("head").startswith("B")) if strict else found
    return found.select(*keys, "nth", lb.bare(F.col("head")).alias("label"), "first", "last", *(["text"] if word else []))


def runs(tokens: DataFrame, tag: str, key: str | list[str] = "doc_id", pos: str = "pos", strict: bool = False, word: str | None = None) -> DataFrame:
    """Entity spans of IOB2 tags: key, label, first, last (positions), and with word their text.

    Lenient: an I- without a run before it, or of another type, starts one. Strict: such an I- is no entity.
    """
    return runs_of(tokens, [tag], key, pos, strict, word).drop("nth")


def run_lists(rows: DataFrame, tags: Sequence[str], strict: bool = False, word: str | None = None, items: str = "tokens", name: str = "runs") -> DataFrame:
    """runs_of() within the lists of token_lists(): rows with a list of nth, label, first, last and, with word, text; of each tag in the order of its tokens."""
    for n, tag in enumerate(tags):
        rows = _with_runs(rows, tag, n, strict, word, items)
    names = [f"_runs{n}" for n in range(len(tags))]
    return rows.withColumn(name, F.concat(*names)).drop(*names)


def _with_runs(rows: DataFrame, tag: str, n: int, strict: bool, word: str | None, items: str) -> DataFrame:
    wanted = (lambda x: x[tag].startswith("B")) if strict else (lambda x: x[tag] != "O")
    rows = cut_runs(rows, items, lambda x, before: ~goes_on(x[tag], before[tag]), wanted, f"_runs{n}")

    def one(r: Column) -> Column:
        text = [F.array_join(r[word], " ").alias("text")] if word else []
        return F.struct(F.lit(n).alias("nth"), lb.bare(F.get(r, F.lit(0))[tag]).alias("label"), F.get(r, F.lit(0))["pos"].alias("first"), F.get(r, F.size(r) - 1)["pos"].alias("last"), *text)

    return rows.withColumn(f"_runs{n}", F.transform(f"_runs{n}", one))


def entity_texts(tokens: DataFrame, tag: str, word: str = "word", key: str = "doc_id", pos: str = "pos", separator: str = " ") -> DataFrame:
    """Entities of IOB2 tags as texts: key, label, first, text."""
    w = Window.partitionBy(key).orderBy(pos)
    label = F.when(F.col(tag) != "O", lb.bare(F.col(tag)))
    rows = tokens.withColumns({"label": label, "inside": F.col(tag).startswith("I-")}).withColumns({"prev": F.lag("label").over(w)})
    rows = islands(rows, key, pos, ~(F.col("inside") & F.coalesce(F.col("prev") == F.col("label"), F.lit(False)))).where("label is not null")
    return rows.groupBy(key, "island", "label").agg(F.min(pos).alias("first"), words_in_order(pos, word, separator).alias("text")).drop("island")


def align_subtokens(subtokens: DataFrame, words: DataFrame, key: str = "doc_id", word: str = "word_id", pos: str = "sub_pos", label: str = "label", first_only: bool = False) -> DataFrame:
    """Sub-words with their word's label id: the first as it is, the next shifted from B to I (or ignored); sub-words without a word are ignored."""
    joined = subtokens.join(words.select(key, word, label), [key, word], "left")
    nth = F.row_number().over(Window.partitionBy(key, word).orderBy(pos))
    later = F.lit(lb.IGNORE) if first_only else lb.shifted(F.col(label))
    return joined.withColumn(label, F.when(F.col(word).isNull() | F.col(label).isNull(), lb.IGNORE).when(nth == 1, F.col(label)).otherwise(later))


def boundary(start: Column, previous_end: Column) -> Column:
    """B- where a token starts a labelled stretch."""
    return F.when(previous_end.isNull() | (start > previous_end), "B-PANEL_START").otherwise("O")


def char_iob2(spans: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labels of single characters: key, i, iob2; one row for each character of each text."""
    chars = texts.where(F.length(text) > 0).select(key, F.explode(F.sequence(F.lit(0), F.length(text) - 1)).alias("i"))
    found = as_of(chars, spans.select(key, "start", "end", "label"), key, "i", name="_span")
    labelled = found.select(key, "i", F.when(F.col("i") < F.col("_span.end"), F.col("_span.label")).otherwise("O").alias("label"))
    return iob2(labelled, "label", key, "i").select(key, "i", "iob2")


def char_lists(rows: DataFrame, key: str = "doc_id", text: str = "text", spans: str = "spans") -> DataFrame:
    """char_iob2() where a list of the spans (start, end, label) in order, which do not overlap, goes with each text.

    A list has an item for each span, with the place where the one before ended, and one for what is after the last; characters
    are rows of plain sequences of an item's, so that nothing is worked out character by character but the row itself.
    """
    n, at = F.length(text), F.coalesce(F.size(spans), F.lit(0))
    end = lambda k: F.when(k > 0, F.get(spans, k - 1)["end"]).otherwise(0).cast("int")
    goes = lambda x, k: F.coalesce((end(k) == x["start"]) & (F.get(spans, k - 1)["label"] == x["label"]) & (k > 0), F.lit(False))
    items = F.transform(spans, lambda x, k: F.struct(end(k).alias("before"), x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["label"].alias("label"), F.when(goes(x, k), "I-").otherwise("B-").alias("first")))
    rest = F.struct(end(at).alias("before"), n.alias("start"), n.alias("end"), F.lit("O").alias("label"), F.lit("O").alias("first"))
    held = rows.where(n > 0).select(key, F.concat(F.coalesce(items, F.array().cast("array<struct<before:int,start:int,end:int,label:string,first:string>>")), F.array(rest)).alias("_items"))
    one = rows_of(held, "_items", key).where(F.col("before") < F.col("end"))
    chars = one.select(key, "start", F.concat("first", "label").alias("_b"), F.concat(F.lit("I-"), "label").alias("_i"), F.explode(F.sequence("before", F.col("end") - 1)).alias("i"))
    return chars.select(key, "i", F.when(F.col("i") < F.col("start"), "O").when(F.col("i") == F.col("start"), F.col("_b")).otherwise(F.col("_i")).alias("iob2"))


def histogram(labels: DataFrame, label: str = "label") -> DataFrame:
    """Exact counts; ignored ids (below 0) are left out where labels are ids."""
    rows = labels.where(F.col(label) >= 0) if dict(labels.dtypes)[label] in ("int", "bigint") else labels.where(F.col(label).isNotNull())
    return rows.groupBy(label).agg(F.count("*").alias("n"))


def class_weights(counts: DataFrame, label: str = "label", n: str = "n", low: float = 0.2, high: float = 0.9) -> DataFrame:
    """The largest count over each count, scaled to [low, high]."""
    everything = Window.partitionBy()  # one row for each class
    ratio = counts.withColumn("ratio", F.max(n).over(everything) / F.col(n))
    least, most = F.min("ratio").over(everything), F.max("ratio").over(everything)
    scaled = F.when(most == least, F.lit(low)).otherwise((F.col("ratio") - least) / (most - least) * (high - low) + low)
    return ratio.select(label, n, scaled.alias("weight"))
