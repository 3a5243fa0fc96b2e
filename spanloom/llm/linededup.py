"""Deletion of repeated line runs, by a suffix array over sequences of line IDs.

Documents are sequences of line IDs (128-bit hashes of whole lines; blank lines are
left out). Prefix doubling ranks the suffixes: rank 0 orders them by their first line,
rank k by their first 2**k lines, from pairs of ranks k - 1 that stand 2**(k - 1) lines
apart; distinct lines and pairs are range-sorted and numbered in Spark, and what is seen
once is dropped, since no repeated run goes through it.

A suffix's key run is the least number of lines with min_words words; two overlapping
ranks tell its order, so doubling goes on while a key run is longer than what is ranked.
Lines after the key run are looked at while they have less than min_words words together;
what repeats beyond that lies in the maximal run of a later start, so nothing is left out.
Suffixes are range-sorted by these ranks (length of the key run, its two ranks, the lines
after it, then document order): the suffix array to that depth. Each task goes once along
its part of the array, takes the longest common prefix with the suffix before, and tells
for each depth where the interval that a suffix lies in starts; an interval that comes from
an earlier part takes its start from a table of the parts' first and last suffixes, a few rows
for each part. An interval is named by the place of its first suffix, so neither runs nor ranks
are needed any more. In each interval all but the first suffix in document order are later
copies, and a later copy's whole maximal run is deleted: from its start to the depth of the
deepest interval in which another suffix comes before it.

Hot lines are pre-aggregated wherever they are counted or ranked; what is joined
back to places is joined by rows, so a hot line's places can be split.

Defined results: null and empty texts have no lines and stay as they are (null
becomes empty); blank lines stay; within a document the first copy stays; rows with
equal id and text are one document and get equal answers; documents with a null id
come first; a text with all lines deleted is empty; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import Workspace, partitions

MIN_WORDS = 10
_LINES = "doc_id long, doc long, seq int, line int, id long, id2 long, words int"
_PLACES = "doc_id long, doc long, seq int, line int, r0 long, n int, tail array<long>"
_ARRAY = "doc_id long, doc long, seq int, n int, row long, starts array<long>, edge int, first long, last long, tail array<long>"
_ARRAY_NAMES = [x.split()[0] for x in _ARRAY.split(", ")]
_ARRAY_KINDS = [{"long": pa.int64(), "int": pa.int32(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in _ARRAY.split(", ")]


def line_table(data: np.ndarray, offsets: np.ndarray, named: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each line that is not blank: its text, its number there, its two hashes (zeros unless named), its words. Last, the number of all lines of each text."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(breaks, offsets)) + 1)
    order = np.searchsorted(breaks, offsets[:-1]) + np.arange(len(offsets) - 1)  # of each text's first line
    ends = np.where(np.append(owner[1:], -1) == owner, np.append(starts[1:], 0) - 1, offsets[owner + 1])
    word, _, _ = tb.word_spans(data, offsets, tb.NONSPACE)
    words = np.searchsorted(word, ends) - np.searchsorted(word, starts)
    full = words > 0
    hashes = np.stack(tb.piece_hashes(data, starts[full], ends[full]), axis=1) if named else np.zeros((int(full.sum()), 2), np.uint64)
    number = np.arange(len(starts)) - order[owner]
    return owner[full], number[full], hashes, words[full], np.bincount(owner, minlength=len(offsets) - 1)


def line_table_in_parts(data: np.ndarray, offsets: np.ndarray, named: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """line_table(), for a very long text in parts that end with lines."""
    if len(data) <= tb.LONG or len(offsets) > 2:
        return line_table(data, offsets, named)
    parts, at, before = [], 0, 0
    while at < len(data):
        rest = np.flatnonzero(data[at + tb.LONG :] == 10)[:1] if at + tb.LONG < len(data) else np.zeros(0, np.int64)
        to = at + tb.LONG + int(rest[0]) + 1 if len(rest) else len(data)
        _, number, hashes, words, _ = line_table(data[at:to], np.array([0, to - at]), named)
        parts.append((number + before, hashes, words))
        before += int((data[at:to] == 10).sum())
        at = to
    number, hashes, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.zeros(len(number), np.int64), number, hashes, words, np.array([before + 1])


def _lines(batches):
    for batch in batches:
        data, offsets = tb.column_bytes(batch.column(2))
        ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        for i, j in tb.chunks(offsets):
            owner, number, hashes, words, _ = line_table_in_parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            seq = np.arange(len(owner)) - np.searchsorted(owner, owner)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner + i)), pa.array(keys[owner + i]), pa.array(seq.astype(np.int32)), pa.array(number.astype(np.int32)), *[pa.array(np.ascontiguousarray(h).view(np.int64)) for h in hashes.T], pa.array(words.astype(np.int32))], names=["doc_id", "doc", "seq", "line", "id", "id2", "words"])


def _runs(min_words: int):
    """From documents with their repeated lines (number among lines that are not blank, rank, words) to suffixes with the length of their key runs and the ranks of the few lines after them."""

    def each(batches):
        for batch in batches:
            out = []
            for doc_id, doc, lines in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                lines = sorted({(x["seq"], x["line"], x["r0"], x["words"]) for x in lines})
                seq, ranks = np.array([x[0] for x in lines]), [x[2] for x in lines]
                total = np.concatenate(([0], np.cumsum([x[3] for x in lines])))
                end = np.searchsorted(total, total[:-1] + min_words)
                last = np.append(np.flatnonzero(np.diff(seq) != 1), len(seq) - 1)  # of a stretch without gaps
                stretch = last[np.searchsorted(last, np.arange(len(seq)))] + 1
                upto = np.minimum(np.searchsorted(total, total[np.minimum(end, len(seq))] + min_words) - 1, stretch)
                for k, (s, line, rank, _) in enumerate(lines):
                    whole = end[k] <= stretch[k]
                    out.append((doc_id, doc, s, line, rank, int(end[k] - k) if whole else 0, ranks[end[k] : upto[k]] if whole else []))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "doc", "seq", "line", "r0", "n", "tail"])

    return each


def _numbered(distinct: DataFrame, *by: str, name: str) -> DataFrame:
    """Rows in order, with their number in that order (with gaps between partitions)."""
    return distinct.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(name, F.monotonically_increasing_id())


def _along(deepest: int):
    """From sorted suffixes (doc_id, doc, seq, n, first, last, tail, row) to rows as in _ARRAY, and two more for the part's first and last suffix."""

    def edge(which: int, key: tuple, row: int, starts: list[int]) -> pa.RecordBatch:
        values = [None, None, None, key[0], row, starts, which, key[1], key[2], key[3]]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _ARRAY_KINDS, strict=True)], names=_ARRAY_NAMES)

    def each(batches):
        now, key, row = np.full(deepest + 1, -1), None, 0  # starts of the intervals of the last suffix, that suffix
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4, 5)], axis=1)
            rows = batch.column(7).to_numpy()
            tails = batch.column(6)
            lengths = tails.value_lengths().to_numpy(zero_copy_only=False)
            table = np.full((size, deepest), -1)
            table[np.arange(deepest) < lengths[:, None]] = tails.flatten().to_numpy()
            if key is None:
                yield edge(0, (*keys[0].tolist(), table[0, : lengths[0]].tolist()), int(rows[0]), [])
                before, before_table = keys[:1], table[:1]
            else:
                before, before_table = np.array([key[:3]]), np.array([key[3] + [-1] * (deepest - len(key[3]))], dtype=np.int64).reshape(1, deepest)
            same = (keys == np.concatenate((before, keys[:-1]))).all(axis=1)
            alike = (table == np.concatenate((before_table, table[:-1]))) & (table >= 0)
            common = np.where(same, np.logical_and.accumulate(alike, axis=1).sum(axis=1), -1)  # lines after the key run
            if key is None:
                common[0] = deepest + 1  # not known here: no interval starts
            fresh = np.where(common[:, None] < np.arange(deepest + 1), rows[:, None], -1)
            starts = np.maximum(np.maximum.accumulate(fresh, axis=0), now)
            now, row, key = starts[-1], int(rows[-1]), (*keys[-1].tolist(), table[-1, : lengths[-1]].tolist())
            within = np.arange(deepest + 1) <= lengths[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths + 1))), pa.int32()), pa.array(starts[within]))
            none = [pa.nulls(size, t) for t in _ARRAY_KINDS[6:]]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), batch.column(7), lists, *none], names=_ARRAY_NAMES)
        if key is not None:
            yield edge(1, key, row, now.tolist())

    return each


def lcp_intervals(suffixes: DataFrame, work: Workspace, deepest: int) -> DataFrame:
    """doc_id, doc, seq, n, more, start: for each suffix and each number of lines after its key run, the interval of the suffix array that shares them, by the place of its first suffix.

    suffixes: a kept table of doc_id, doc, seq, n, first, last, tail (of deepest lines at most).
    """
    order = ["n", "first", "last", "tail", "doc_id", "doc", "seq"]
    placed = suffixes.repartitionByRange(partitions(work.spark, work.size(suffixes)), *order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    array = work.keep(placed.select("doc_id", "doc", "seq", "n", "first", "last", "tail", "row").mapInArrow(_along(deepest), _ARRAY)).withColumn("part", F.shiftright("row", 33))
    # Two rows for each part of the array, so these windows are over as many rows as there are tasks.
    run = F.struct("n", "first", "last")
    edges = array.where("edge is not null").groupBy("part").agg(F.max(F.when(F.col("edge") == 0, F.struct("row", run.alias("run"), "tail"))).alias("head"), F.max(F.when(F.col("edge") == 1, F.struct("row", run.alias("run"), "tail", "starts"))).alias("end"))
    edges = edges.withColumn("before", F.lag("end").over(Window.orderBy("part")))
    shared = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size("head.tail"), F.size("before.tail"))), lambda m: F.slice("head.tail", F.lit(1), m) == F.slice("before.tail", F.lit(1), m)))
    edges = edges.withColumn("common", F.when(F.col("before").isNotNull() & (F.col("head.run") == F.col("before.run")), shared).otherwise(-1))
    depths = edges.select("part", "common", F.col("head.row").alias("row"), F.posexplode("end.starts").alias("more", "own"))
    fresh = F.when(F.col("common") < F.col("more"), F.col("row"))
    parts = Window.partitionBy("more").orderBy("part")
    depths = depths.withColumn("upto", F.last(F.coalesce(F.when(F.col("own") >= 0, F.col("own")), fresh), ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    leading = depths.select("part", "more", F.coalesce(fresh, F.lag("upto").over(parts)).alias("leading"))
    rows = array.where("edge is null").select("doc_id", "doc", "seq", "n", "part", F.posexplode("starts").alias("more", "own"))
    # Of parts times depths, MOST_PARTS times deepest + 1 at most.
    found = rows.join(F.broadcast(leading), ["part", "more"], "left")
    return found.select("doc_id", "doc", "seq", "n", "more", F.when(F.col("own") >= 0, F.col("own")).otherwise(F.col("leading")).alias("start"))


def later_copies(docs: DataFrame, work: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, doc, seq, n: maximal runs of n lines from the seq-th line that is not blank, of which an earlier copy exists. docs: doc_id, doc, text."""
    lines = work.keep(docs.mapInArrow(_lines, _LINES))
    # Kept as a table: a join of plain tables is one that Spark can split where a line is in very many places.
    often = work.keep(_numbered(lines.groupBy("id", "id2").agg(F.count("*").alias("c")).where("c > 1").select("id", "id2"), "id", "id2", name="r0"))
    repeated = lines.join(often, ["id", "id2"])
    by_doc = repeated.groupBy("doc_id", "doc").agg(F.collect_list(F.struct("seq", "line", "r0", "words")).alias("lines"))
    places = work.keep(by_doc.mapInArrow(_runs(min_words), _PLACES))
    longest = places.agg(F.max("n")).first()[0] or 0
    level = 0
    while 2 << level <= longest:
        here, step = F.col(f"r{level}"), 1 << level
        ahead = Window.partitionBy("doc_id", "doc").orderBy("seq")
        paired = places.withColumn("s", F.when(F.lead("seq", step).over(ahead) == F.col("seq") + step, F.lead(here, step).over(ahead)))
        pairs = paired.where(here.isNotNull() & F.col("s").isNotNull()).groupBy(here.alias("a"), F.col("s").alias("b")).agg(F.count("*").alias("c")).where("c > 1")
        ranked = work.keep(_numbered(pairs.select("a", "b"), "a", "b", name=f"r{level + 1}"))
        doubled = work.keep(paired.join(ranked, (here == F.col("a")) & (F.col("s") == F.col("b")), "left").drop("a", "b", "s"))
        work.drop(places, ranked)
        places, level = doubled, level + 1
    # A key run of n lines is told by the ranks of its first and its last 2**k lines, 2**k being at most n.
    power = F.expr("CASE " + " ".join(f"WHEN n >= {1 << k} THEN {k}" for k in range(level, 0, -1)) + " ELSE 0 END") if level else F.lit(0)
    rank = "CASE k " + " ".join(f"WHEN {k} THEN r{k}" for k in range(level + 1)) + " END"
    starts = places.where("n > 0").withColumn("k", power).withColumn("first", F.expr(rank)).withColumn("at", F.expr("seq + n - shiftleft(1, k)"))
    tails = places.select(F.col("doc_id").alias("i"), F.col("doc").alias("d"), F.col("seq").alias("at"), *[F.col(f"r{k}").alias(f"t{k}") for k in range(level + 1)])
    suffixes = starts.join(tails, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("doc") == F.col("d")) & (starts["at"] == tails["at"])).withColumn("last", F.expr(rank.replace("THEN r", "THEN t"))).where("first is not null and last is not null")
    kept = work.keep(suffixes.select("doc_id", "doc", "seq", "n", "first", "last", "tail"))
    work.drop(places)
    # One row for each interval of the suffix array that a suffix is in.
    intervals = work.keep(lcp_intervals(kept, work, min_words - 1))
    earliest = work.keep(intervals.groupBy("more", "start").agg(F.min(F.struct("doc_id", "doc", "seq")).alias("earliest"), F.count("*").alias("c")).where("c > 1").drop("c"))
    later = intervals.join(earliest, ["more", "start"]).where("not (doc_id <=> earliest.doc_id and doc = earliest.doc and seq = earliest.seq)")
    return later.groupBy("doc_id", "doc", "seq").agg(F.max(F.col("n") + F.col("more")).alias("n"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """i, d, gone: for each document the runs of lines that go, overlapping and touching ones as one, in order."""
    along = Window.partitionBy("doc_id", "doc").orderBy("seq")
    before = F.max(F.col("seq") + F.col("n")).over(along.rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.withColumn("fresh", F.coalesce(F.col("seq") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    whole = starts.groupBy("doc_id", "doc", "run").agg(F.min("seq").alias("seq"), (F.max(F.col("seq") + F.col("n")) - F.min("seq")).cast("int").alias("n"))
    return whole.groupBy(F.col("doc_id").alias("i"), F.col("doc").alias("d")).agg(F.array_sort(F.collect_list(F.struct("seq", "n"))).alias("gone"))


def without_lines(raw: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A text without the lines of these numbers; the line breaks of lines that stay are between them."""
    if not len(lines):
        return raw
    ends = np.append(np.flatnonzero(raw == 10), len(raw))
    turn = np.zeros(len(raw) + 2, np.int8)
    turn[np.append(0, ends[:-1] + 1)[lines]] += 1
    turn[ends[lines] + 1] -= 1  # a line goes with its break
    return np.append(raw, np.uint8(10))[np.cumsum(turn[:-1], dtype=np.int8) == 0][:-1]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, removed (line numbers from 0), text without them, and the columns to carry, each as carried_ and its name."""
    work = Workspace(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    own = own.withColumn("doc", F.xxhash64("doc_id", "text"))
    gone = work.keep(merged_runs(later_copies(own.select("doc_id", "doc", "text"), work, min_words)))

    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for i, j in tb.chunks(offsets):
                n_lines, removed, texts = [], [], []
                for d, runs in enumerate(batch.column(2).slice(i, j - i).to_pylist(), i):
                    raw = data[offsets[d] : offsets[d + 1]]
                    _, number, _, _, _ = line_table_in_parts(raw, np.array([0, len(raw)]), named=False)
                    out = np.concatenate([number[r["seq"] : r["seq"] + r["n"]] for r in runs]) if runs else number[:0]
                    n_lines.append(len(number))
                    removed.append(out)
                    texts.append(without_lines(raw, out).tobytes())
                rest = [batch.column(k).slice(i, j - i) for k in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n_lines, pa.int64()), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(texts, pa.string()), *rest], names=["doc_id", "n_lines", "n_removed", "removed", "text", *batch.schema.names[3:]])

    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("doc") == F.col("d")), "left").select("doc_id", "text", "gone", *[f"carry_{i}" for i in range(len(carry))])
    kinds = "".join(f", `carry_{i}` {joined.schema[f'carry_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    result = joined.mapInArrow(each, "doc_id long, n_lines long, n_removed long, removed array<int>, text string" + kinds)
    return result.select("doc_id", "n_lines", "n_removed", "removed", "text", *[F.col(f"carry_{i}").alias(f"carried_{c}") for i, c in enumerate(carry)])
