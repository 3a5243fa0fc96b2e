"""Sequence-to-sequence rows from labelled tokens and pairs of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels as lb
from ..functions import text as tx


def entity_lists(entities: DataFrame, docs: DataFrame, labels: Sequence[str], key: str = "doc_id", end: str = "[END]") -> DataFrame:
    """For each document 'LABEL: first, second' lines of its distinct entities, in the order first seen. entities: key, label, first, text."""
    once = entities.where(F.col("label").isin(*labels)).groupBy(key, "label", "text").agg(F.min("first").alias("first"))
    listed = once.groupBy(key).pivot("label", list(labels)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"]), ", "))
    line = lambda label: F.concat(F.lit(f"{label}: "), F.coalesce(F.col(label), F.lit("")), F.lit(" \n"))
    return docs.select(key).join(listed, key, "left").select(key, F.concat(*[line(x) for x in labels], F.lit(f" {end}")).alias("output_text"))


def copy_and_tag(tokens: DataFrame, labels: Sequence[str], tag: str = "iob2", word: str = "word", key: str = "doc_id", pos: str = "pos", close_last: bool = True, docs: DataFrame | None = None) -> DataFrame:
    """Texts with <LABEL> and </LABEL> around runs of the labels wanted; the run at the end is closed unless close_last is off. With docs, documents without tokens are empty texts."""
    w = Window.partitionBy(key).orderBy(pos)
    bare = lb.bare(F.col(tag))
    wanted = F.when((F.col(tag) != "O") & bare.isin(*labels), bare)
    rows = tokens.withColumn("inside", wanted).withColumns({"before": F.lag("inside").over(w), "last": F.lead(word).over(w).isNull()})
    starts = ~F.col(tag).startswith("I-")
    close = F.when(F.col("before").isNotNull() & starts, F.concat(F.lit("</"), "before", F.lit("> "))).otherwise("")
    open_ = F.when(F.col("inside").isNotNull() & F.col(tag).startswith("B-"), F.concat(F.lit("<"), "inside", F.lit("> "))).otherwise("")
    end = F.when(F.col("last") & F.col("inside").isNotNull(), F.concat(F.lit("</"), "inside", F.lit("> "))).otherwise("") if close_last else F.lit("")
    shown = rows.withColumn("shown", F.concat(close, open_, F.col(word), F.lit(" "), end))
    parts = F.array_sort(F.collect_list(F.struct(pos, "shown")))
    out = shown.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["shown"]), "").alias("tagged"))
    return out if docs is None else docs.select(key).join(out, key, "left").withColumn("tagged", F.coalesce("tagged", F.lit("")))


def listed(rows: DataFrame, labels: Sequence[str], key: str = "doc_id", runs: str = "runs", end: str = "[END]") -> DataFrame:
    """entity_lists() of documents with a list of their entities (label, text) in order."""
    texts = lambda label: F.array_join(F.array_distinct(F.transform(F.filter(runs, lambda r: r["label"] == label), lambda r: r["text"])), ", ")
    line = lambda label: F.concat(F.lit(f"{label}: "), F.coalesce(texts(label), F.lit("")), F.lit(" \n"))
    return rows.select(key, F.concat(*[line(x) for x in labels], F.lit(f" {end}")).alias("output_text"))


def copy_lists(rows: DataFrame, labels: Sequence[str], tag: str = "iob2", word: str = "word", key: str = "doc_id", items: str = "tokens", close_last: bool = True) -> DataFrame:
    """copy_and_tag() of documents with a list of their tokens; without tokens they are empty texts."""
    wanted = lambda x: F.when((x[tag] != "O") & lb.bare(x[tag]).isin(*labels), lb.bare(x[tag]))
    mark = lambda open_, label: F.concat(F.lit(open_), label, F.lit("> "))

    def shown(x: Column, i: Column) -> Column:
        inside, before = F.get("_inside", i), F.get("_inside", i - 1)
        close = F.when(before.isNotNull() & ~x[tag].startswith("I-"), mark("</", before)).otherwise("")
        opened = F.when(inside.isNotNull() & x[tag].startswith("B-"), mark("<", inside)).otherwise("")
        end = F.when((i == F.size(items) - 1) & inside.isNotNull(), mark("</", inside)).otherwise("") if close_last else F.lit("")
        return F.concat(close, opened, x[word], F.lit(" "), end)

    rows = rows.withColumn("_inside", F.transform(items, wanted))
    return rows.select(key, F.coalesce(F.array_join(F.transform(items, shown), ""), F.lit("")).alias("tagged"))


def next_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", asks: str = "user", answers: str = "assistant") -> DataFrame:
    """A question and the answer that follows it: conv, turn, question, answer."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.select("*", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where((F.col("role") == asks) & (F.col("next_role") == answers)).select(conv, turn, F.col("text").alias("question"), "answer")


def prompt_completion(pairs: DataFrame, stop: str = " [END]", separator: str = "\n\n###\n\n") -> DataFrame:
    return pairs.select("conv_id", "turn", tx.prompt("question", F.lit(separator)).alias("prompt"), tx.prompt(F.lit(" "), "answer", F.lit(stop)).alias("completion"))


def pair_rows(pairs: DataFrame, left: Column, right: Column, mode: str, coin: Column | None = None) -> DataFrame:
    """input_ids and labels by mode: QandA, AandQ, NEXT (both as one), MULTITASK (a coin decides which comes first)."""
    keys = [c for c in ("conv_id", "turn") if c in pairs.columns]
    if mode == "QandA":
        a, b = left, right
    elif mode == "AandQ":
        a, b = right, left
    elif mode == "NEXT":
        a = b = F.concat(left, right)
    elif mode == "MULTITASK":
        a, b = F.when(coin, left).otherwise(right), F.when(coin, right).otherwise(left)
    else:
        raise ValueError(f"unknown mode {mode}")
    return pairs.select(*keys, a.alias("input_ids"), b.alias("labels"))
