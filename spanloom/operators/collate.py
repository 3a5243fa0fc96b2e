"""Batches for training: padding, masking, replacing. Draws are from hashes of places, so they can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as v
from ..functions.labels import IGNORE


def _digits(key: Column, i: Column, salt: str) -> Column:
    return F.substring(F.md5(F.concat(key.cast("string"), F.lit("/"), i.cast("string"), F.lit("/" + salt))), 1, 8)


def draw(key: Column, i: Column, salt: str) -> Column:
    """A number in [0, 2**32) for a key and a place."""
    return F.conv(_digits(key, i, salt), 16, 10).cast("long")


def below(key: Column, i: Column, salt: str, p: float) -> Column:
    """Whether the draw is below a share p of its range; digits of one length are in the order of their numbers."""
    bound = int(p * (1 << 32))
    return F.lit(True) if bound >= 1 << 32 else _digits(key, i, salt) < F.lit(f"{max(bound, 0):08x}")


def pad_batches(rows: DataFrame, batch: str, ids: str, labels: str, multiple: int = 8, pad_id: int = 0, left: bool = False) -> DataFrame:
    """ids and labels of a batch padded to its longest row, rounded up; an attention mask is added."""
    longest = rows.groupBy(batch).agg(F.max(F.size(ids)).alias("longest")).withColumn("length", v.round_up(F.col("longest"), multiple))
    joined = rows.join(longest.select(batch, "length"), batch)
    ones = F.transform(F.col(ids), lambda _: F.lit(1))
    return joined.withColumns({"attention_mask": v.pad(ones, F.col("length"), 0, left), ids: v.pad(F.col(ids), F.col("length"), pad_id, left), labels: v.pad(F.col(labels), F.col("length"), IGNORE, left)}).drop("length")


def mask_targets(rows: DataFrame, key: str, ids: str, tag_mask: str, p: float, mask_id: int) -> DataFrame:
    """Masks a share p of the places with tag_mask; labels are the ids there, ignored elsewhere."""
    chosen = F.transform(F.col(tag_mask), lambda m, i: (m > 0) & below(F.col(key), i, "mask", p))
    with_choice = rows.withColumn("chosen", chosen)
    masked = F.zip_with(F.col(ids), F.col("chosen"), lambda x, c: F.when(c, mask_id).otherwise(x))
    labels = F.zip_with(F.col(ids), F.col("chosen"), lambda x, c: F.when(c, x).otherwise(IGNORE))
    return with_choice.withColumns({"labels": labels, "masked_ids": masked}).drop("chosen")


def mask_or_replace(rows: DataFrame, key: str, ids: str, labels: str, tag_mask: str, p: float, p_replace: float, mask_id: int, vocabulary: int, select_labels: bool = False) -> DataFrame:
    """Of places with tag_mask a share p is masked, of the others there a share p_replace gets a random id; with select_labels, labels elsewhere are ignored."""
    k = F.col(key)
    new = F.transform(
        F.arrays_zip(F.col(ids).alias("x"), F.col(tag_mask).alias("m")),
        lambda z, i: F.when((z["m"] > 0) & below(k, i, "mask", p), mask_id).when((z["m"] > 0) & below(k, i, "replace", p_replace), (draw(k, i, "random") % vocabulary).cast("int")).otherwise(z["x"]),
    )
    out = rows.withColumn("masked_ids", new)
    if select_labels:
        out = out.withColumn(labels, F.zip_with(F.col(labels), F.col(tag_mask), lambda y, m: F.when(m > 0, y).otherwise(IGNORE)))
    return out


def pad_twins(rows: DataFrame, twins: str, length: int, pad_id: int = 0) -> DataFrame:
    """Each of the nested arrays of a twin padded to one length."""
    return rows.withColumn(twins, F.transform(F.col(twins), lambda x: v.pad(F.slice(x, 1, length), length, pad_id)))


def weighted_cross_entropy(rows: DataFrame, probability: Column, weight: Column) -> DataFrame:
    """The weighted mean of -log p of the true class."""
    return rows.agg((F.sum(-weight * F.log(probability)) / F.sum(weight)).alias("loss"))


def min_max(rows: DataFrame, value: str, by: list[str], invert: bool = True) -> DataFrame:
    """Values scaled to [0, 1] within a group, then inverted."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    scaled = F.when(high == low, F.lit(0.0)).otherwise((F.col(value) - low) / (high - low))
    return rows.withColumn("scaled", 1 - scaled if invert else scaled)


def prefixed_means(rows: DataFrame, values: list[str], prefix: str) -> DataFrame:
    """Means of columns under names with a prefix."""
    return rows.agg(*[F.avg(c).alias(f"{prefix}_{c}") for c in values])
