"""Sentence boundaries from the corpus itself: which words are abbreviations, and which begin sentences.

Nothing is known of the language. Statistics of all words that stand before a dot are counted
in Spark, and words are told by log-likelihood ratios (Kiss and Strunk's unsupervised method):

* an abbreviation is a word that keeps its dot far more often than chance has it, is short,
  and may have dots inside;
* a sentence starter is a word that follows sentence ends more often than its frequency says;
* a collocation is a pair of words around a dot that stand together more often than alone.

Then each dot is looked at with the words around it. All of that depends on a token and the
next one alone, so it is done once for each different pair of them and not for each place; of the
places only those with a mark that may end a sentence are joined to what was decided.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written

# The method's thresholds.
ABBREVIATION, STARTER, COLLOCATION = 0.3, 30.0, 7.88
#: A token: a run of what is no white space, less marks at its ends, with the dots that follow it.
TOKEN = r"\S+"
NUMBER = r"^[-+]?[0-9.,]*[0-9][0-9.,]*\.?$"
#: What a token has that may end a sentence before the text's end.
MARKS = "[.!?…]"
#: TOKEN and white space as Java has them, for Python.
_TOKEN, _MARK, _SPACE = re.compile(r"[^ \t\n\x0b\f\r]+"), re.compile(MARKS), " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Statistics:
    """abbreviations, starters (word) and collocations (word, next)."""

    abbreviations: DataFrame
    starters: DataFrame
    collocations: DataFrame


def _log(x: Column) -> Column:
    return F.ln(F.greatest(x, F.lit(1e-300)))


def dunning(count_a: Column, count_b: Column, count_ab: Column, n: Column) -> Column:
    """The log-likelihood ratio of b after a as often as anywhere (share count_b / n) against 0.99."""
    p1, p2 = count_b / n, F.lit(0.99)
    null = count_ab * _log(p1) + (count_a - count_ab) * _log(1 - p1)
    other = count_ab * _log(p2) + (count_a - count_ab) * _log(1 - p2)
    return -2 * (null - other)


def collocation(count_a: Column, count_b: Column, count_ab: Column, n: Column) -> Column:
    """The log-likelihood ratio of a and b together against apart."""
    p, p1, p2 = count_b / n, count_ab / count_a, (count_b - count_ab) / F.greatest(n - count_a, F.lit(1))
    term = lambda k, m, q: k * _log(q) + (m - k) * _log(1 - q)
    whole = term(count_ab, count_a, p) + term(count_b - count_ab, n - count_a, p)
    first = F.when(count_a == count_ab, F.lit(0.0)).otherwise(term(count_ab, count_a, p1))
    second = F.when(count_b == count_ab, F.lit(0.0)).otherwise(term(count_b - count_ab, n - count_a, p2))
    return -2 * (whole - first - second)


def words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, i, start, token, word, dot, after: each token with its place, its type (lower-cased, numbers as one, without marks around and the last dot), whether a dot ends it, and the next token."""
    pieces = docs.select(key, F.col(text).alias("_t")).where("_t is not null").repartition(key)
    found = pieces.select(key, F.posexplode(F.regexp_extract_all("_t", F.lit(r"\s*\S+"), F.lit(0))).alias("i", "piece"))
    along = Window.partitionBy(key).orderBy("i")
    bare = F.regexp_replace("piece", r"^\s+", "")
    placed = found.withColumns({"token": bare, "start": F.sum(F.length("piece")).over(along) - F.length(bare)})
    return placed.select(key, "i", "start", "token", word_type("token").alias("word"), ends_in_dot("token").alias("dot"), F.lead("token").over(along).alias("after"))


def _core(token: Column | str) -> Column:
    """Without brackets and quotes around it, and marks at its end but a dot."""
    inner = F.regexp_replace(token, r"^[\p{Ps}\p{Pi}\"'`*_\-–—]+", "")
    return F.regexp_replace(inner, r"[\p{Pe}\p{Pf}\"'`*_,;:!?]+$", "")


def word_type(token: Column | str) -> Column:
    core = _core(token)
    return F.when(core.rlike(NUMBER), "##number##").otherwise(F.regexp_replace(F.lower(core), r"\.$", ""))


def ends_in_dot(token: Column | str) -> Column:
    return _core(token).endswith(".") & ~_core(token).endswith("..")


def dotted(tokens: DataFrame) -> DataFrame:
    """word, n, dots: how often each word stands, and with a dot."""
    return tokens.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), F.sum(F.col("dot").cast("long")).alias("dots"))


def statistics(tokens: DataFrame, abbreviation: float = ABBREVIATION, starter: float = STARTER, pair: float = COLLOCATION) -> Statistics:
    """What words() tells of its words. Counts are summed on the map side; totals are one row."""
    pairs = tokens.where(F.col("token").rlike(MARKS) & F.col("after").isNotNull()).groupBy("token", "after").agg(F.count("*").alias("times"))
    return statistics_of_counts(tokens.groupBy("token").agg(F.count("*").alias("times")), pairs, abbreviation, starter, pair)


def statistics_of_counts(types: DataFrame, pairs: DataFrame, abbreviation: float = ABBREVIATION, starter: float = STARTER, pair: float = COLLOCATION) -> Statistics:
    """statistics() of how often each token (token, times) and each pair with a mark in its first (token, after, times) stands."""
    letters = F.col("word").rlike(r"\p{L}")
    named = types.select(word_type("token").alias("word"), ends_in_dot("token").alias("dot"), "times").where("word <> ''")
    counts = named.groupBy("word").agg(F.sum("times").alias("n"), F.sum(F.when(F.col("dot"), F.col("times")).otherwise(0)).alias("dots"))
    counts = written(counts)
    totals = counts.agg(F.sum("n").alias("all_n"), F.sum("dots").alias("all_dots"))
    inner = F.length(F.regexp_replace("word", r"[^.]", "")) + 1
    length = F.length(F.regexp_replace("word", r"\.", ""))
    undotted = F.col("n") - F.col("dots")
    score = dunning(F.col("n"), F.col("all_dots"), F.col("dots"), F.col("all_n")) * F.exp(-length.cast("double")) * inner * F.pow(length.cast("double"), -undotted.cast("double"))
    abbreviations = counts.where((F.col("dots") > 0) & letters).crossJoin(F.broadcast(totals)).where(score >= abbreviation).select("word")
    abbreviations = written(abbreviations)
    dotted_pairs = pairs.where(ends_in_dot("token")).select(word_type("token").alias("word"), initial("token").alias("initial"), word_type("after").alias("next"), "times").where(F.col("next").rlike(r"\p{L}"))
    plain = dotted_pairs.where((F.col("word") != "##number##") & ~F.col("initial"))
    following = plain.join(abbreviations, "word", "left_anti").groupBy("next").agg(F.sum("times").alias("k"))
    whole = following.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("sentences"))
    ratio = collocation(F.col("sentences"), F.col("n"), F.col("k"), F.col("all_n"))
    more = F.col("all_n") / F.col("sentences") > F.col("n") / F.col("k")
    starters = following.join(counts.withColumnRenamed("word", "next"), "next").crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(totals)).where((ratio >= starter) & more).select(F.col("next").alias("word"))
    loose = dotted_pairs.where((F.col("word") == "##number##") | F.col("initial"))
    bound = loose.groupBy("word", "next").agg(F.sum("times").alias("k")).where("k > 1").join(counts.select("word", F.col("n").alias("n_a")), "word").join(counts.select(F.col("word").alias("next"), F.col("n").alias("n_b")), "next")
    together = collocation(F.col("n_a"), F.col("n_b"), F.col("k"), F.col("all_n"))
    bound = bound.crossJoin(F.broadcast(totals)).where((F.col("k") < F.least("n_a", "n_b") + 1) & (together >= pair) & (F.col("all_n") / F.col("n_a") > F.col("n_b") / F.col("k"))).select("word", "next")
    return Statistics(abbreviations, starters, bound)


def initial(token: Column | str) -> Column:
    """A single letter and a dot."""
    return _core(token).rlike(r"^\p{L}\.$")


def boundaries(tokens: DataFrame, stats: Statistics, key: str = "doc_id") -> DataFrame:
    """tokens with ends: whether a sentence ends with the token.

    '!' and '?' end one, and so does a dot, but for: dots of abbreviations, initials and numbers
    before a word in small letters or a number, or before one that is no known starter after an
    initial or a number (ordinals, decimals, names), or one that goes with it as a collocation.
    After an abbreviation a sentence ends only before a known starter in capitals.
    """
    marked = tokens.withColumn("next", word_type("after"))
    marked = marked.join(stats.abbreviations.withColumn("short", F.lit(True)), "word", "left").join(stats.starters.select(F.col("word").alias("next"), F.lit(True).alias("starts")), "next", "left").join(stats.collocations.withColumn("bound", F.lit(True)), ["word", "next"], "left")
    upper, yes = _core("after").rlike(r"^\p{Lu}"), lambda c: F.coalesce(F.col(c), F.lit(False))
    small = _core("after").rlike(r"^[\p{Ll}\p{N}]")
    loose = yes("short") | initial("token") | (F.col("word") == "##number##")
    hard = F.col("token").rlike(r"[!?…][\p{Pe}\p{Pf}\"'`]*$") | F.col("token").rlike(r"\.\.+[\p{Pe}\p{Pf}\"'`]*$") & upper
    bound = yes("bound") | F.when(yes("short"), ~(yes("starts") & upper)).when(loose, small | ~(yes("starts") & upper)).otherwise(small & ~F.col("after").rlike(r"^\p{N}"))
    ends = F.when(F.col("after").isNull(), True).when(hard, True).when(F.col("dot"), ~bound).otherwise(False)
    return marked.withColumn("ends", ends).select(*tokens.columns, "ends")


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of key, doc and text: key, doc, token, after and end of each token with a mark that another follows."""
    for batch in batches:
        row, tokens, afters, ends = [], [], [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            last = None
            for found in _TOKEN.finditer(text):
                token = found.group()
                if last is not None:
                    row.append(k)
                    tokens.append(last[0])
                    afters.append(token)
                    ends.append(last[1])
                last = (token, found.end()) if _MARK.search(token) else None
        at = pa.array(row, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(tokens, pa.string()), pa.array(afters, pa.string()), pa.array(ends, pa.int64())], names=["key", "doc", "token", "after", "end"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of key, text and the ends of sentences: key, number, start, end and sentence of each, text by text."""
    for batch in batches:
        row, numbers, starts, ends, found = [], [], [], [], []
        for k, (text, cuts) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            at = 0
            for number, end in enumerate([*sorted(set(cuts or ())), len(text.rstrip(_SPACE))]):
                sentence = text[at:end].lstrip(_SPACE)
                if sentence:
                    row.append(k)
                    numbers.append(number)
                    starts.append(end - len(sentence))
                    ends.append(end)
                    found.append(sentence)
                at = end
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int32())), pa.array(numbers, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(found, pa.string())], names=["key", "number", "start", "end", "sentence"])


def sentences(docs: DataFrame, stats: Statistics | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, number (from 0), start, end, sentence: texts cut at their boundaries; stats: of the documents themselves unless given.

    Null texts and those of white space have no sentences, nor have rows without a key.
    """
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("doc"), F.col(text).alias("text")).where("text is not null").repartition("key", "doc")
    places = rows.mapInArrow(_marked, f"key {kind}, doc long, token string, after string, end long")
    pairs = written(places.groupBy("token", "after").agg(F.count("*").alias("times")))
    if stats is None:
        types = rows.select(F.explode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
        stats = statistics_of_counts(types, pairs)
    ends = boundaries(pairs.select("token", "after", word_type("token").alias("word"), ends_in_dot("token").alias("dot")), stats).where("ends").select("token", "after")
    cuts = places.join(ends, ["token", "after"]).groupBy("key", "doc").agg(F.collect_list("end").alias("cuts"))
    whole = rows.where("key is not null").join(cuts, ["key", "doc"], "left").select("key", "text", "cuts")
    return whole.mapInArrow(_cut, f"key {kind}, number long, start long, end long, sentence string").withColumnRenamed("key", key)
