"""Benchmark decontamination by winnowing.

A window is SPAN consecutive words of a benchmark item; an item with fewer words
(but not none) is one window of its own length. Document and item words are
hashed, K words in a row give a fingerprint, and of every SPAN - K + 1
fingerprints in a row the smallest is kept on both sides. Two equal windows keep
the same fingerprint, so every window that occurs in a document shows up in the
join of kept fingerprints. Each hit is then extended: the up to SPAN - K + 1
windows around it are looked up whole. Windows shorter than SPAN are looked up
at every position (winnowing with a window of one).

A benchmark of BLOCK_CHARS at most is an index that is broadcast, so documents are not
shuffled. Of a larger one only the items that documents touch are: the kept fingerprints
of the documents, each once a task, meet those of the items in a shuffle join (the side of
the documents has a row for each fingerprint, so a hot one is split on the other side), and
the items that are left are looked up in blocks of BLOCK_CHARS, one pass over the documents
for each. Passes follow what is contaminated, not the size of the benchmark.
key tells documents of equal id apart: a hash of the text.

Defined results: a null or empty text has no words and is clean; an item that is
null or has no words never occurs; items with equal ids count once in n_items,
so do those with a null id, which item_ids leaves out;
repeated documents are treated alike, row by row; an empty table gives no rows
(documents) or only clean documents (benchmark). Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import Workspace, bounded_batches

SPAN = 10
K = 6
BLOCK_CHARS = 16_000_000
RESULT = "doc_id long, key long, n_words long, n_hit long, n_items long, item_ids array<string>, items_sha256 string, contaminated boolean"
_PARTIAL = "doc_id long, key long, n_words long, hit_starts binary, hit_ends binary, item_ids array<string>"


class Index:
    """The windows of some benchmark items: kept fingerprints, whole windows, and the items of each window."""

    def __init__(self, rows: list[tuple[str | None, str | None]], span: int = SPAN, k: int = K):
        self.span, self.k = span, min(k, span)
        self.names = sorted({name for name, _ in rows}, key=lambda name: (name is None, name or ""))
        code = {name: i for i, name in enumerate(self.names)}
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        kept = []
        for name, text in rows:
            if not text:
                continue
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            hashes, _ = tb.words(data, np.array([0, len(data)]), tb.ALNUM)
            if not len(hashes):
                continue
            n = min(len(hashes), span)
            found = np.unique(tb.grams(hashes, n))
            windows.setdefault(n, []).append((found, np.full(len(found), code[name])))
            if n == span:
                prints = tb.grams(hashes, self.k)
                kept.append(tb.sliding_min(prints, span - self.k + 1))
        self.prints = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.windows = {}
        for n, parts in windows.items():
            keys, items = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((items, keys))
            keys, items = keys[order], items[order]
            distinct, at = np.unique(keys, return_index=True)
            self.windows[n] = (distinct, np.append(at, len(keys)), items)

    def look_up(self, n: int, values: np.ndarray) -> np.ndarray:
        """The number of each value among the windows of n words, or -1."""
        return _find(self.windows[n][0], values)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each window length: the length, the starts of occurrences, the numbers of their windows."""
        for n in self.windows:
            if n < self.span:
                starts = tb.within(first, len(hashes), n)
                number = self.look_up(n, tb.grams_at(hashes, starts, n))
            else:
                starts = self._extended(hashes, first)
                number = self.look_up(n, tb.grams_at(hashes, starts, n))
            yield n, starts[number >= 0], number[number >= 0]

    def _extended(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Starts of windows around the document's kept fingerprints that the benchmark keeps too."""
        prints = tb.grams(hashes, self.k)
        width = self.span - self.k + 1
        if len(prints) < width or not len(self.prints):
            return np.zeros(0, np.int64)
        low = tb.sliding_min(prints, width)
        chosen = np.zeros(len(prints), dtype=bool)
        for j in range(width):
            chosen[j : j + len(low)] |= prints[j : j + len(low)] == low
        at = np.flatnonzero(chosen)
        at = at[_find(self.prints, prints[at]) >= 0]
        around = np.unique((at[:, None] - np.arange(width)[None, :]).ravel())
        owner = np.searchsorted(first, around, side="right") - 1
        fits = (around >= 0) & (owner < len(first) - 1)
        around, owner = around[fits], owner[fits]
        return around[around + self.span <= first[owner + 1]]


def _find(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def scan(index: Index, batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each document: its words, the merged spans of words hit, and the items that occur."""
    data, offsets = tb.column_bytes(batch.column("text"))
    n_words, spans_from, spans_to, names = [], [], [], []
    for i, j in tb.chunks(offsets):
        base = offsets[i]
        hashes, first = tb.words(data[base : offsets[j]], offsets[i : j + 1] - base, tb.ALNUM)
        cover = np.zeros(len(hashes) + 1, dtype=np.int32)
        pairs = []
        for n, starts, number in index.hits(hashes, first):
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + n, -1)
            if len(starts):
                _, at, items = index.windows[n]
                seen = np.unique(np.stack([np.searchsorted(first, starts, side="right") - 1, number]), axis=1)
                counts = at[seen[1] + 1] - at[seen[1]]
                take = np.repeat(at[seen[1]] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
                pairs.append(np.stack([np.repeat(seen[0], counts), items[take]]))
        hit = np.cumsum(cover[:-1]) > 0
        edge = np.zeros(len(hit) + 1, dtype=bool)  # spans also end where a text ends
        edge[first] = True
        before = np.concatenate(([False], hit[:-1]))
        begin = np.flatnonzero(hit & (~before | edge[:-1]))
        after = np.concatenate((hit[1:], [False]))
        end = np.flatnonzero(hit & (~after | edge[1:])) + 1
        cut = np.searchsorted(begin, first)
        found: dict[int, list[str]] = {}
        if pairs:
            for doc, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist():
                found.setdefault(doc, []).append(index.names[item])
        for d in range(j - i):
            n_words.append(int(first[d + 1] - first[d]))
            spans_from.append((begin[cut[d] : cut[d + 1]] - first[d]).astype("<i8").tobytes())
            spans_to.append((end[cut[d] : cut[d + 1]] - first[d]).astype("<i8").tobytes())
            names.append(found.get(d, []))
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), batch.column("key"), pa.array(n_words, pa.int64()), pa.array(spans_from, pa.binary()), pa.array(spans_to, pa.binary()), pa.array(names, pa.list_(pa.string()))],
        names=["doc_id", "key", "n_words", "hit_starts", "hit_ends", "item_ids"],
    )


def _digest(n_words: int, starts: list[bytes], ends: list[bytes], names: list[list[str | None]]) -> tuple:
    begin = np.concatenate([np.frombuffer(x, "<i8") for x in starts])
    end = np.concatenate([np.frombuffer(x, "<i8") for x in ends])
    found = set().union(*names)
    items = sorted(x for x in found if x is not None)
    n_hit = 0
    if len(begin):
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], np.maximum.accumulate(end[order])
        reach = np.concatenate(([0], end[:-1]))
        n_hit = int(np.maximum(0, end - np.maximum(begin, reach)).sum())
    return n_words, n_hit, len(found), items, hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0


def _finish(rows: list[tuple], ids: list, keys: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "key", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"])


def _kept_prints(data: np.ndarray, offsets: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints that winnowing keeps of some texts, the text of each, and the number of words of every text."""
    hashes, first = tb.words(data, offsets, tb.ALNUM)
    width = span - k + 1
    prints = tb.grams(hashes, k)
    starts = tb.within(first, len(hashes), span)
    low = tb.sliding_min(prints, width)[starts] if len(starts) else np.zeros(0, np.uint64)
    return low, np.searchsorted(first, starts, side="right") - 1, np.diff(first)


def _fingerprints(span: int, k: int, of_items: bool):
    """Distinct kept fingerprints: of the documents of a chunk, or with the item's key for each item; an item of fewer words than span, but not none, has a null one."""

    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(0))
            for i, j in tb.chunks(offsets):
                prints, owner, words = _kept_prints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], span, k)
                if not of_items:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(prints).view(np.int64))], names=["print"])
                    continue
                pairs = np.unique(np.stack([owner.astype(np.uint64), prints]), axis=1) if len(prints) else np.zeros((2, 0), np.uint64)
                short = np.flatnonzero((words > 0) & (words < span))
                keys = batch.column(1).slice(i, j - i)
                at = pa.array(np.concatenate([pairs[0].astype(np.int64), short]))
                mask = np.concatenate([np.zeros(pairs.shape[1], bool), np.ones(len(short), bool)])
                value = np.concatenate([pairs[1], np.zeros(len(short), np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([keys.take(at), pa.array(value, mask=mask)], names=["key", "print"])

    return each


def touched(docs: DataFrame, items: DataFrame, span: int, k: int, work: Workspace) -> DataFrame:
    """Items (item, text) that share a kept fingerprint with some document, and those of fewer words than span."""
    keyed = items.withColumn("key", F.xxhash64("item", "text"))
    prints = work.keep(keyed.select("text", "key").mapInArrow(_fingerprints(span, k, True), "key long, print long"))
    seen = docs.select("text").mapInArrow(_fingerprints(span, k, False), "print long").distinct()
    keys = prints.where("print is null").select("key").unionAll(prints.join(seen, "print", "left_semi").select("key")).distinct()
    return work.keep(keyed.join(work.keep(keys), "key", "left_semi").select("item", "text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = K, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document, as in RESULT: words, words hit, and the items whose windows occur."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("key"))
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    count = lambda rows: max(1, -(-int(rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // block_chars))
    blocks, parts, work = count(items), [], None
    if blocks > 1:
        work = Workspace(spark)
        items = touched(docs, items, span, min(k, span), work)
        blocks = count(items)
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()]
        index = spark.sparkContext.broadcast(Index(rows, span, k))

        def each(batches, index=index, last=blocks == 1):
            for batch in batches:
                part = scan(index.value, batch)
                if last:
                    c = [part.column(i).to_pylist() for i in range(6)]
                    yield _finish([_digest(n, [s], [e], [x]) for n, s, e, x in zip(*c[2:], strict=True)], c[0], c[1])
                else:
                    yield part

        if blocks == 1:
            return docs.mapInArrow(each, RESULT)
        parts.append(work.keep(docs.mapInArrow(each, _PARTIAL)))
        index.destroy()
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)

    def merge(batches):
        for batch in batches:
            c = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            out, ids, keys = [], [], []
            for doc, key, n, starts, ends, names, copies in zip(*c, strict=True):
                for _ in range(copies):
                    out.append(_digest(n, starts, ends, names))
                    ids.append(doc)
                    keys.append(key)
            yield _finish(out, ids, keys)

    # Rows of equal id and text come from each block once for each copy of the document.
    return (
        whole.groupBy("doc_id", "key", "n_words")
        .agg(F.collect_list("hit_starts").alias("s"), F.collect_list("hit_ends").alias("e"), F.collect_list("item_ids").alias("x"), (F.count("*") / blocks).cast("int").alias("copies"))
        .mapInArrow(merge, RESULT)
    )
