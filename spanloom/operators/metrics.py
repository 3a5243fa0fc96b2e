"""Scores of predicted labels: tokens, entity spans, boundaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels as lb
from .labelseq import run_lists, runs_of
from .tokens import rows_of


def token_accuracy(tokens: DataFrame, truth: str, predicted: str) -> DataFrame:
    rows = tokens.where((F.col(truth) != lb.IGNORE) & (F.col(predicted) != lb.IGNORE)) if dict(tokens.dtypes)[truth] in ("int", "bigint") else tokens
    return rows.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.count("*").alias("n"))


def masked_recall(tokens: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Share of positions that are not ignored where the prediction is right."""
    return tokens.where(F.col(truth) != lb.IGNORE).agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("recall"), F.count("*").alias("n"))


def match(truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """Spans of either side with flags of where they are; equal on all keys."""
    a = truth.select(*keys, *[c for c in truth.columns if c not in keys]).withColumn("in_truth", F.lit(True))
    b = predicted.select(*keys, *[F.col(c).alias(f"{c}_predicted") for c in predicted.columns if c not in keys]).withColumn("in_predicted", F.lit(True))
    return a.join(b, list(keys), "full").fillna(False, ["in_truth", "in_predicted"])


def match_tags(tokens: DataFrame, truth: str, predicted: str, key: str = "doc_id", pos: str = "pos", word: str | None = None, strict: bool = False) -> DataFrame:
    """As match() of the spans of two IOB2 tags of the same tokens: key, label, first, last, (text,) in_truth, in_predicted.

    Both tags go through one pass over the tokens, and equal spans meet in a grouping
    within their document, so that nothing is joined.
    """
    spans = runs_of(tokens, [truth, predicted], key, pos, strict, word)
    return spans.groupBy(key, "label", "first", "last").agg(*([F.max("text").alias("text")] if word else []), F.bool_or(F.col("nth") == 0).alias("in_truth"), F.bool_or(F.col("nth") == 1).alias("in_predicted"))


def match_lists(rows: DataFrame, truth: str, predicted: str, key: str = "doc_id", word: str | None = None, strict: bool = False, keep: Sequence[str] = (), on: Sequence[str] = ("label", "first", "last")) -> DataFrame:
    """match_tags() of documents with a list of their tokens; keep: columns of the document; on: what equal spans have in common."""
    spans = rows_of(run_lists(rows, [truth, predicted], strict, word), "runs", key, *keep)
    more = (["text"] if word else []) + list(keep)
    return spans.groupBy(key, *on).agg(*[F.max(c).alias(c) for c in more], F.bool_or(F.col("nth") == 0).alias("in_truth"), F.bool_or(F.col("nth") == 1).alias("in_predicted"))


def counts() -> list[Column]:
    t, p = F.col("in_truth"), F.col("in_predicted")
    return [F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"), F.sum((t & ~p).cast("long")).alias("fn")]


def rates(rows: DataFrame, digits: int = 9) -> DataFrame:
    """precision, recall, f1 and support from tp, fp, fn; 0 where undefined."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.round(a / b, digits))
    return rows.select("*", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def prf(matched: DataFrame) -> DataFrame:
    """Micro scores over all spans."""
    return rates(matched.agg(*counts()))


def class_report(matched: DataFrame, label: str = "label", digits: int = 9) -> DataFrame:
    """Scores by class, and micro, macro and weighted ones, from one pass over the spans; without spans there are no rows.

    A class's scores count for the class, with weight 1 for the macro mean, and with its
    support for the weighted one (null if no class has support), so the means come from
    the few rows of classes and the spans are not gone through again for them.
    """
    both = rates(matched.cube(label).agg(*counts(), F.grouping(label).alias("whole")), 15)
    one = F.lit(1.0)
    line = lambda name, weight: F.struct(name.alias("label"), weight.alias("weight"))
    means = F.array(line(F.col(label), one), line(F.lit("macro avg"), one), line(F.lit("weighted avg"), F.col("support").cast("double")))
    lines = both.withColumn("_line", F.explode(F.when(F.col("whole") == 1, F.array(line(F.lit("micro avg"), one))).otherwise(means)))
    share = lambda c: F.round(F.sum(F.col(c) * F.col("_line.weight")) / F.nullif(F.sum("_line.weight"), F.lit(0.0)), digits)
    out = lines.groupBy(F.col("_line.label").alias("label")).agg(*[share(c).alias(c) for c in ("precision", "recall", "f1")], F.sum("support").alias("support"))
    return out.select("label", "precision", "recall", "f1", "support")


def memorisation(matched: DataFrame, split: DataFrame, key: str = "doc_id") -> DataFrame:
    """Scores of the test documents' entities by class, apart for those whose text training documents have too. matched: match_tags() with text; split: key, split.

    One grouping by class and text tells which entities training has and counts those of
    the test documents, summed on the map side, so a frequent entity is no hot key.
    """
    sides = split.groupBy(key).agg(F.bool_or(F.col("split") == "train").alias("_train"), F.bool_or(F.col("split") == "test").alias("_test"))
    rows = matched.join(sides, key).where("_train or _test")
    t, p = (F.col(c) & F.col("_test") for c in ("in_truth", "in_predicted"))
    tested = [F.sum((t & p).cast("long")).alias("tp"), F.sum((~t & p).cast("long")).alias("fp"), F.sum((t & ~p).cast("long")).alias("fn")]
    by_text = rows.groupBy("label", "text").agg(F.bool_or(F.col("in_truth") & F.col("_train")).alias("in_training"), F.bool_or("_test").alias("tested"), *tested)
    return rates(by_text.where("tested").groupBy("in_training", "label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))


def boundaries(truth: DataFrame, predicted: DataFrame, *keys: str) -> DataFrame:
    """Each boundary as TP, FN or FP."""
    return outcomes(match(truth, predicted, *keys), *keys)


def outcomes(m: DataFrame, *keys: str) -> DataFrame:
    """Matched boundaries as TP, FN or FP."""
    kind = F.when(F.col("in_truth") & F.col("in_predicted"), "TP").when(F.col("in_truth"), "FN").otherwise("FP")
    return m.select(*keys, kind.alias("outcome"))


def evaluate(tokens: DataFrame, truth: str, predicted: str, hooks: Sequence[Callable[[str, DataFrame], None]] = (), name: str = "eval", **columns: str) -> DataFrame:
    """The class report of two tags of the same tokens; every hook is called with the name and the report before it is returned."""
    report = class_report(match_tags(tokens, truth, predicted, **columns))
    for hook in hooks:
        hook(name, report)
    return report
