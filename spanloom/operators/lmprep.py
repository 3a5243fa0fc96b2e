"""Examples for language models: ids, parts of speech and special tokens; their projections and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..functions import labels as lb
from ..functions import text as tx
from .tokens import as_of, collected, cut_runs, islands, last_places, tokens

#: Ids at the ends of an example, and the part of speech of what is no word.
BOS, EOS, NO_TAG = 0, 2, "X"
#: Texts whose tokens are Python objects at the same time.
TEXTS = 100


class Tokenizer(Protocol):
    """Texts to ids and their places; made once for each Python worker."""

    def __call__(self, texts: list[str]) -> list[tuple[list[int], list[int], list[int]]]: ...


def file_tokenizer(path: str, most: int | None = None) -> Callable[[], Tokenizer]:
    """Makes a tokenizer of a tokenizers JSON file, without special tokens; places are in characters. most: how many of a text's first tokens are given, of a text that is tokenised whole."""

    def make() -> Tokenizer:
        from tokenizers import Tokenizer as File

        own = File.from_file(path)

        def encode(texts: list[str]) -> list[tuple[list[int], list[int], list[int]]]:
            found = own.encode_batch(texts, add_special_tokens=False)
            for e in found if most is not None else ():
                e.truncate(most)
            return [(e.ids, [a for a, _ in at], [b for _, b in at]) for e in found for at in (e.offsets,)]

        return encode

    return make


def subtokens(docs: DataFrame, make: Callable[[], Tokenizer], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, id, start, end: a row for each token that a tokenizer finds; null is an empty text."""
    kind = dict(docs.dtypes)[key]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for rows in batches:
            found = encode(rows["text"].tolist())
            yield pd.DataFrame({"key": rows["key"], "ids": [x[0] for x in found], "starts": [x[1] for x in found], "ends": [x[2] for x in found]})

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("key")
    arrays = rows.mapInPandas(each, f"key {kind}, ids array<int>, starts array<int>, ends array<int>").repartition("key")
    items = arrays.select("key", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("starts").alias("start"), F.col("ends").alias("end"))).alias("pos", "t"))
    return items.select(F.col("key").alias(key), "pos", "t.id", F.col("t.start").cast("long").alias("start"), F.col("t.end").cast("long").alias("end"))


def subtoken_lists(rows: DataFrame, make: Callable[[], Tokenizer], most: int, text: str = "text", name: str = "subs") -> DataFrame:
    """rows with a list of the first tokens (id, start, end), most of them, that a tokenizer finds in a text; null is an empty text. A few texts at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make()
        for whole in batches:
            for i in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(i, TEXTS)
                found = encode([x or "" for x in batch.column(text).to_pylist()])
                at = np.concatenate([[0], np.cumsum([min(len(x[0]), most) for x in found])])
                fields = [pa.array([v for x in found for v in x[k][:most]], kind) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                items = pa.StructArray.from_arrays(fields, names=["id", "start", "end"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)], names=[*whole.schema.names, name])

    kind = ArrayType(StructType([StructField("id", IntegerType()), StructField("start", LongType()), StructField("end", LongType())]))
    return rows.mapInArrow(each, StructType([*rows.schema.fields, StructField(name, kind)]))


def aligned_lists(rows: DataFrame, words: str = "tokens", tags: str = "tags", subs: str = "subs") -> DataFrame:
    """aligned() within rows: subs become id and tag; words (start, end) and their tags are lists of the same length, or there are no tags."""
    rows = last_places(rows, F.col(subs)["start"], F.coalesce(F.col(words)["start"], F.array().cast("array<bigint>")), "_at")
    over = lambda i, items: F.get(items, F.get("_at", i))
    mine = lambda x, i: F.when(x["start"] == x["end"], NO_TAG).when(x["start"] < over(i, words)["end"], F.coalesce(over(i, tags), F.lit(""))).otherwise("")
    return rows.withColumn(subs, F.transform(subs, lambda x, i: F.struct(x["id"].alias("id"), mine(x, i).alias("tag")))).drop("_at")


def aligned(subs: DataFrame, words: DataFrame, key: str = "doc_id", tag: str = "tag") -> DataFrame:
    """Tokens with the tag of the word over their first character; NO_TAG for an empty token, empty between words. words: key, start, end, tag."""
    found = as_of(subs, words.select(key, "start", "end", tag), key, "start", name="_word")
    mine = F.when(F.col("start") == F.col("end"), NO_TAG).when(F.col("start") < F.col("_word.end"), F.col(f"_word.{tag}")).otherwise("")
    return found.select(*subs.columns, mine.alias(tag))


def examples(tagged: DataFrame, max_length: int, key: str = "doc_id", bos: int = BOS, eos: int = EOS) -> DataFrame:
    """key, max_length, input_ids, label_ids, special_tokens_mask: the first tokens of each document, max_length with both ends. tagged: key, pos, id, tag."""
    held = collected(tagged.where(F.col("pos") < max_length - 2), key, "pos", "id", "tag")
    around = lambda a, x, b: F.concat(F.array(F.lit(a)), x, F.array(F.lit(b)))
    zeros = F.transform("id", lambda _: F.lit(0))
    return held.select(key, F.array(F.lit(max_length)).alias("max_length"), around(bos, F.col("id"), eos).alias("input_ids"), around(NO_TAG, F.col("tag"), NO_TAG).alias("label_ids"), around(1, zeros, 1).alias("special_tokens_mask"))


def example_lists(rows: DataFrame, max_length: int, key: str = "doc_id", items: str = "subs", first: int = 0, bos: int = BOS, eos: int = EOS, name: str = "example") -> DataFrame:
    """examples() of documents with a list of their tagged tokens (id, tag): rows with a struct of max_length, input_ids, label_ids, special_tokens_mask of the tokens from first on; null if there is none."""
    rows = rows.withColumn("_held", F.slice(items, first + 1, max_length - 2))
    around = lambda a, x, b: F.concat(F.array(F.lit(a)), x, F.array(F.lit(b)))
    whole = F.struct(F.array(F.lit(max_length)).alias("max_length"), around(bos, F.col("_held")["id"], eos).alias("input_ids"), around(NO_TAG, F.col("_held")["tag"], NO_TAG).alias("label_ids"), around(1, F.transform("_held", lambda _: F.lit(0)), 1).alias("special_tokens_mask"))
    return rows.withColumn(name, F.when(F.size("_held") > 0, whole)).drop("_held")


def twin_lists(rows: DataFrame, left: str, right: str, name: str = "twin") -> DataFrame:
    """twin_examples() of two structs of example_lists() of the same row; null unless there are both."""
    columns = ("input_ids", "label_ids", "special_tokens_mask")
    both = F.struct(F.concat(F.col(left)["max_length"], F.col(right)["max_length"]).alias("max_length"), *[F.array(F.col(left)[c], F.col(right)[c]).alias(c) for c in columns])
    return rows.withColumn(name, F.when(F.col(left).isNotNull() & F.col(right).isNotNull(), both))


def twin_examples(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Examples of two texts side by side, as nested arrays."""
    columns = ("input_ids", "label_ids", "special_tokens_mask")
    other = right.select(key, F.col("max_length").alias("_m"), *[F.col(c).alias(f"_{c}") for c in columns])
    return left.join(other, key).select(key, F.concat("max_length", "_m").alias("max_length"), *[F.array(c, f"_{c}").alias(c) for c in columns])


def examples_of_lines(rows: DataFrame, make: Callable[[], Tokenizer], lengths: Sequence[int], key: str = "doc_id", value: str = "value", tag: Callable[[Column], Column] | None = None) -> DataFrame:
    """Examples of lines, or of twin lines where there are two lengths; tag: from an array of words to their parts of speech."""
    tag = tag or (lambda words: F.transform(words, lambda _: F.lit("NOUN")))

    def one(text: Column, length: int) -> DataFrame:
        docs = rows.select(key, text.alias("text"))
        words = tokens(docs, key)
        named = words.select(key, "start", "end", F.get(tag(F.array("word")), F.lit(0)).alias("tag"))
        return examples(aligned(subtokens(docs, make, key), named, key), length, key)

    parts = F.split(F.col(value), tx.DELIMITER)
    out = one(F.get(parts, F.lit(0)), lengths[0])
    return out if len(lengths) == 1 else twin_examples(out, one(F.get(parts, F.lit(1)), lengths[1]), key)


def special_mask(ids: Column | str, special: Sequence[int]) -> Column:
    """1 for special tokens, else 0."""
    return lb.mask(ids, special)


def twin_lengths(value: Column | str, lengths: Sequence[int]) -> Column:
    """The texts of a twin with the lengths they may have, which are gone through again and again."""
    table = F.array(*[F.lit(n) for n in lengths])
    return F.transform(F.split(tx.col(value), tx.DELIMITER), lambda t, i: F.struct(t.alias("text"), F.get(table, i % len(lengths)).alias("max_length")))


def projection(rows: DataFrame, name: str, key: str = "doc_id") -> DataFrame:
    """What a task reads of examples (nested ones of twins too): MLM, SEQ2SEQ, NOLM, or a mask of parts of speech."""
    if name == "MLM":
        return rows.select(key, "input_ids", "special_tokens_mask")
    if name == "SEQ2SEQ":
        return rows.select(key, "input_ids", F.col("input_ids").alias("labels"))
    if name == "NOLM":
        return rows.select(key, "input_ids")
    if name not in lb.POS_MASKS:
        raise ValueError(f"unknown projection {name}")
    nested = dict(rows.dtypes)["label_ids"].startswith("array<array")
    wanted = lb.POS_MASKS[name]
    mask = F.transform("label_ids", lambda x: lb.mask(x, wanted)) if nested else lb.mask("label_ids", wanted)
    return rows.select(key, "input_ids", mask.alias("tag_mask"))


def violations(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Examples that are too long for their max_length, or whose arrays differ in length: key, problem."""
    n = F.size("input_ids")
    problem = F.when(n > F.get("max_length", F.lit(0)) + 2, "too long").when(n != F.size("label_ids"), "labels differ").when(n != F.size("special_tokens_mask"), "special tokens differ")
    return rows.select(key, problem.alias("problem")).where("problem is not null")


def label_ids(label: Column | str, names: Sequence[str]) -> Column:
    """The class of a label, its place in names; null for others."""
    table = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return table[tx.col(label)]


def label_names(class_: Column | str, names: Sequence[str]) -> Column:
    """The label of a class; null for others."""
    return F.get(F.array(*[F.lit(n) for n in names]), tx.col(class_))


def zip_positions(left: DataFrame, right: DataFrame, key: str, pos: str) -> DataFrame:
    """Rows of both sides by their place among those of their key; a place that one side lacks fails."""
    keyed = lambda df, w: df.withColumn("nth", F.row_number().over(w))
    w = Window.partitionBy(key).orderBy(pos)
    a, b = keyed(left, w), keyed(right, w).drop(pos)
    joined = a.withColumn("_l", F.lit(1)).join(b.withColumn("_r", F.lit(1)), [key, "nth"], "full")
    whole = F.when(F.col("_l").isNull() | F.col("_r").isNull(), F.raise_error(F.lit("both sides must have as many rows"))).otherwise(F.col("nth"))
    return joined.withColumn("nth", whole.cast("int") - 1).drop("_l", "_r")


def word_groups(subs: DataFrame, is_subword: str, key: str = "doc_id", pos: str = "pos", name: str = "word_id") -> DataFrame:
    """Tokens with the number from 0 of their word: a token that is no sub-word begins one, as does the first."""
    return islands(subs, key, pos, ~F.col(is_subword) | (F.lag(pos).over(Window.partitionBy(key).orderBy(pos)).isNull()), name).withColumn(name, F.col(name) - 1)


def word_lists(rows: DataFrame, is_subword: str, items: str, name: str = "words") -> DataFrame:
    """word_groups() within lists: rows with a list of pos and word_id of each token."""
    runs = cut_runs(rows, items, lambda x, before: before.isNull() | ~x[is_subword], name="_runs")
    return runs.withColumn(name, F.flatten(F.transform("_runs", lambda r, k: F.transform(r, lambda x: F.struct(x["pos"].alias("pos"), k.cast("long").alias("word_id")))))).drop("_runs")


def stitch_trimmed(chunks: DataFrame, key: str, values: str, stride: int, chunk: str = "chunk") -> DataFrame:
    """key, values: the values (an array of one for each token, special ones included) of overlapping windows end to end.

    The first window loses its end token; later ones their start token and the stride
    tokens that the window before has, and all but the last their end token.
    """
    last = F.max(chunk).over(Window.partitionBy(key))
    first = F.col(chunk) == 0
    n = F.size(values)
    drop = F.when(first, 0).otherwise(stride + 1)
    keep = F.when(first | (F.col(chunk) < F.col("_last")), n - 1).otherwise(n) - drop
    cut = chunks.withColumn("_last", last).withColumn("_cut", F.slice(values, drop + 1, F.greatest(keep, F.lit(0))))
    return cut.groupBy(key).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(chunk, "_cut"))), lambda x: x["_cut"])).alias(values))


def smoothed_loss(log_p: Column, label: Column, epsilon: float) -> Column:
    """Cross entropy with smoothed labels, of an array of log probabilities and the true class."""
    total = F.aggregate(log_p, F.lit(0.0), lambda a, x: a + x)
    return -(1 - epsilon) * F.get(log_p, label) - epsilon * total / F.size(log_p)


def pad_twin_batches(rows: DataFrame, batch: str, columns: dict[str, int], multiple: int = 8) -> DataFrame:
    """Nested arrays of twins padded, twin by twin, to the longest of the batch rounded up; columns: name and what it is padded with."""
    first = next(iter(columns))
    sizes = rows.select(batch, F.posexplode(F.transform(first, lambda x: F.size(x))).alias("twin", "n")).groupBy(batch, "twin").agg((F.ceil(F.max("n") / multiple) * multiple).cast("int").alias("n"))
    lengths = sizes.groupBy(batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("twin", "n"))), lambda x: x["n"]).alias("_lengths"))
    fill = lambda x, n, value: F.concat(x, F.array_repeat(F.lit(value), F.greatest(n - F.size(x), F.lit(0))))
    joined = rows.join(lengths, batch)
    mask = F.transform(first, lambda x, i: fill(F.transform(x, lambda _: F.lit(1)), F.get("_lengths", i), 0))
    filled = lambda c, value: F.transform(c, lambda x, i: fill(x, F.get("_lengths", i), value))
    padded = {c: filled(c, v) for c, v in columns.items()}
    return joined.withColumns({"attention_mask": mask, **padded}).drop("_lengths")


def pick(rows: DataFrame, key: str, salt: str, n: int = 1) -> DataFrame:
    """n rows at random, the same ones for the same salt: those with the least hashes."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{salt}"))), key).limit(n)


def metrics_table(rows: DataFrame, step: str, values: Sequence[str]) -> DataFrame:
    """step, main_tag, scalar_tag, value: a row for each logged value."""
    long = rows.select(step, F.explode(F.map_from_arrays(F.array(*[F.lit(v) for v in values]), F.array(*[F.col(v).cast("double") for v in values]))).alias("key", "value"))
    main, scalar = tx.log_route("key")
    return long.select(step, main.alias("main_tag"), scalar.alias("scalar_tag"), "value").where("value is not null")


def progress(done: Column | str, total: Column | str, width: int = 20) -> Column:
    """A bar of how much is done."""
    share = F.least(F.greatest(tx.col(done) / tx.col(total), F.lit(0.0)), F.lit(1.0))
    full = F.floor(share * width).cast("int")
    return F.concat(F.repeat(F.lit("="), full), F.repeat(F.lit(" "), F.lit(width) - full), F.lit(" "), F.floor(share * 100).cast("string"), F.lit("%"))
