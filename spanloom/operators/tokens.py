"""Documents to tokens and back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .lineage import written

#: Words whose values are sent to all tasks, and the column of a document's further ones.
HELD, FURTHER = 1 << 18, "_further"
PIECE = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


@F.arrow_udf(returnType=ArrayType(StructType([StructField("pos", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), StructField("word", StringType())])))
def _placed(pieces: pa.Array) -> pa.Array:
    """Of lists of pieces of texts, spaces included, those that are no space, with their places."""
    at = np.asarray(pieces.offsets, dtype=np.int64)
    at, words = at - at[0], pieces.flatten()
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.utf8_length(words), dtype=np.int64))])
    kept = np.asarray(pc.not_equal(words, " "), dtype=bool)
    before = np.concatenate([[0], np.cumsum(kept)])[at]
    text = np.repeat(np.arange(len(pieces)), np.diff(at))[kept]
    starts, ends = ends[:-1][kept] - ends[at[text]], ends[1:][kept] - ends[at[text]]
    pos = np.arange(len(text)) - before[text]
    items = pa.StructArray.from_arrays([pa.array(pos, pa.int32()), pa.array(starts), pa.array(ends), words.filter(pa.array(kept))], names=["pos", "start", "end", "word"])
    none = pieces.is_null()
    return pa.ListArray.from_arrays(pa.array(before, pa.int32()), items, mask=none if pieces.null_count else None)


def token_lists(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_trailing_word: bool = False, keep: Sequence[str] = (), dealt: bool = False) -> DataFrame:
    """key, tokens (array of pos, start, end, word; null for a null text) and what to keep: one row for each document, offsets in characters from 0.

    A token is a run of letters and digits or any other character but the space.
    Documents are dealt out by key and stay one row each: whatever follows along a document
    (labels, runs, panels) is done in its array, so that tokens are neither shuffled nor
    sorted and a task holds one batch of documents, however many it goes through. dealt: they are dealt out already.
    """
    rows = docs.select(key, text, *keep)
    rows = (rows if dealt else rows.repartition(key)).select(key, *keep, F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)).alias("_pieces"))
    if drop_trailing_word:
        # A word that runs to the end of the text is never followed by what would end it.
        n = F.size("_pieces")
        rows = rows.withColumn("_pieces", F.when(F.get("_pieces", n - 1).rlike(r"^[\p{L}\p{N}]"), F.slice("_pieces", 1, F.greatest(n - 1, F.lit(0)))).otherwise(F.col("_pieces")))
    return rows.select(key, *keep, _placed("_pieces").alias("tokens"))


def tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_trailing_word: bool = False) -> DataFrame:
    """key, pos, start, end, word: token_lists() as one row for each token."""
    return rows_of(token_lists(docs, key, text, drop_trailing_word), "tokens", key)


def rows_of(rows: DataFrame, items: str, *keys: str) -> DataFrame:
    """keys and the fields of each struct of a list, a row for each.

    Of a plain inline Spark has it that the list is not empty, and pushes that below what
    makes the list, lambdas in lambdas, which then costs the square of its length. An outer one
    is left alone.
    """
    return rows.select(*keys, F.posexplode_outer(items).alias("_i", "_x")).where("_i is not null").select(*keys, "_x.*")


def with_word_values(docs: DataFrame, words: Column, values: Callable[[DataFrame], DataFrame], key: str = "doc_id", most: int = HELD) -> tuple[DataFrame, pa.Table]:
    """docs, dealt out by key, with the word and value of those words of theirs that are not in the table, and the table: word, value.

    words: a document's list of words (null is taken for an empty one); values: from rows of a word, all different, to word and value (a list).
    The table has the words that are in most documents, so many at most. Only further words are shuffled, to the
    documents that have them, which is done before lists of tokens are made, since texts take less room.
    """
    types = docs.where(F.col(key).isNotNull()).select(key, F.explode(F.array_distinct(words)).alias("word")).select(key, F.coalesce("word", F.lit("")).alias("word"))
    seen = written(types.groupBy("word").agg(F.count("*").alias("n")))
    found = written(values(seen.select("word")).join(seen, "word").select("word", "value", "n"))
    top = found.orderBy(F.desc("n"), "word").limit(most).toArrow()
    none = F.array().cast(f"array<struct<word:string,value:{dict(found.dtypes)['value']}>>")
    if top.num_rows < most:
        return docs.repartition(key).withColumn(FURTHER, none), top
    n, w = (top.column(c)[-1].as_py() for c in ("n", "word"))
    common = (F.col("n") > n) | ((F.col("n") == n) & (F.col("word") <= w))
    rest = types.join(F.broadcast(found.where(common).select("word")), "word", "left_anti")
    known = rest.join(found.where(~common).select("word", "value"), "word").groupBy(key).agg(F.collect_list(F.struct("word", "value")).alias(FURTHER))
    # Hashed, since a sort would hold all texts.
    return docs.join(known.hint("shuffle_hash"), key, "left").withColumn(FURTHER, F.coalesce(FURTHER, none)), top


def word_places(words: pa.Array, common: pa.Array, further: pa.Array) -> np.ndarray:
    """Where words are in common, or else in what comes after it."""
    place = pc.index_in(words, common)
    if place.null_count:
        place = pc.coalesce(place, pc.add(pc.index_in(words, further), pa.scalar(len(common), pa.int32())))
    if place.null_count:
        raise ValueError("a word of a document has no value")
    return np.asarray(place, dtype=np.int64)


def with_field(items: str, name: str, value: Callable[[Column, Column], Column]) -> Column:
    """A list of structs with one more field, from an item and its place."""
    return F.transform(items, lambda x, i: x.withField(name, value(x, i)))


def cut_runs(rows: DataFrame, items: str, begins: Callable[[Column, Column], Column], wanted: Callable[[Column], Column] | None = None, name: str = "runs") -> DataFrame:
    """rows with a list of the runs of a list: an item for which begins(item, the one before, null at first) holds begins one; wanted: of a run's first item."""
    at = F.filter(F.transform(items, lambda x, i: F.when(begins(x, F.get(items, i - 1)), i)), lambda i: i.isNotNull())
    runs = F.transform("_at", lambda i, k: F.struct(i.alias("a"), F.coalesce(F.get("_at", k + 1), F.size(items)).alias("b")))
    if wanted is not None:
        runs = F.filter(runs, lambda r: wanted(F.get(items, r["a"])))
    return rows.withColumn("_at", at).withColumn(name, F.transform(runs, lambda r: F.slice(items, r["a"] + 1, r["b"] - r["a"]))).drop("_at")


def last_places(rows: DataFrame, points: Column, starts: Column, name: str) -> DataFrame:
    """rows with, for each of a list of points, the place in starts (a list, ascending) of the last one at or before it; null if none is. As as_of(), within rows.

    In a step of its own and not a function of columns, since Spark would write the lists out in
    full, lambdas in lambdas, wherever they go into a Python function.
    """
    given = rows.select("*", points.cast("array<bigint>").alias("_points"), starts.cast("array<bigint>").alias("_starts"))
    schema = StructType([*rows.schema.fields, StructField(name, ArrayType(IntegerType()))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _last_places(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], found], names=[*batch.schema.names[:-2], name])

    return given.mapInArrow(each, schema)


def _last_places(points: pa.Array, starts: pa.Array) -> pa.Array:
    lists = [(np.asarray(x.offsets, dtype=np.int64), np.asarray(x.flatten(), dtype=np.int64)) for x in (points, starts)]
    (p_at, p), (s_at, s) = [(at - at[0], x) for at, x in lists]
    # Rows are set apart by more than any value, so that one search does for all.
    far = int(max(p.max(initial=0), s.max(initial=0))) + 1
    row = lambda at: np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = np.searchsorted(s + row(s_at) * far, p + row(p_at) * far, side="right") - 1 - s_at[row(p_at)]
    return pa.ListArray.from_arrays(pa.array(p_at, pa.int32()), pa.array(found, pa.int32(), mask=found < 0), mask=points.is_null() if points.null_count else None)


def collected(rows: DataFrame, key: str, pos: str, *columns: str) -> DataFrame:
    """Rows of each key as arrays in the order of pos."""
    items = F.array_sort(F.collect_list(F.struct(pos, *columns)))
    out = rows.groupBy(key).agg(items.alias("items"))
    return out.select(key, *[F.col("items").getField(c).alias(c) for c in columns])


def words_in_order(pos: str, word: str, separator: str = " ") -> Column:
    """Aggregate: the words of a group in the order of pos, as one text."""
    return F.array_join(F.array_sort(F.collect_list(F.struct(pos, word))).getField(word), separator)


def islands(rows: DataFrame, key: str | list[str], order: str, starts: Column, name: str = "island") -> DataFrame:
    """Rows with the number (from 1) of the island they are in; a row for which starts holds begins one."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def carried(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str = "start", name: str = "found") -> DataFrame:
    """as_of(), with the intervals' own rows too: _point is 0 for them and 1 for points, and an interval's row has itself under name.

    Points and intervals are sorted together within a key and the last interval is
    carried along, so the work follows their number and not its product, as it would
    in a join with a range condition.
    """
    # Spark 4.1 takes the union of two inputs that are dealt out alike for dealt out itself, but
    # concatenates them where both read one reused exchange. A computed key keeps it from that.
    own = F.array_max(F.array(key, key)).alias(key)
    held = intervals.select(own, F.col(start).alias("_at"), F.lit(0).alias("_point"), F.struct(*[c for c in intervals.columns if c != key]).alias(name))
    both = points.withColumns({"_at": F.col(at).cast(dict(held.dtypes)["_at"]), "_point": F.lit(1)}).unionByName(held, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_at", "_point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(name, F.last(name, ignorenulls=True).over(w)).drop("_at")


def as_of(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str = "start", name: str = "found") -> DataFrame:
    """Points with the interval (a struct under name) of their key that starts last at or before them; null if none does."""
    return carried(points, intervals, key, at, start, name).where("_point = 1").drop("_point")


def exact_dedupe(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The first row of each key and text, by order."""
    w = Window.partitionBy(key, text).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def length_report(rows: DataFrame, length: str, name: str) -> DataFrame:
    """Rounded mean, least and largest length, and the names of the shortest and longest rows (the smallest name of equals)."""
    return rows.agg(F.round(F.avg(length), 2).alias("mean_length"), F.min(length).alias("min_length"), F.max(length).alias("max_length"), F.min_by(name, F.struct(F.col(length), F.col(name))).alias("shortest"), F.min_by(name, F.struct(-F.col(length), F.col(name))).alias("longest"))
