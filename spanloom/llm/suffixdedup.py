"""Removal of repeated byte strings by two-stage suffix sorting.

A byte goes when a string of span bytes that covers it also starts earlier (in a
document of smaller id, or earlier in its own). Texts are UTF-8 bytes; strings do not
cross documents and are judged on the input.

1. Anchors. Each window of span bytes has one K-byte gram as its anchor: the one of
   least hash, the last of equals. Equal windows have equal anchors at equal places, so
   equal windows meet where anchors meet. Neighbouring windows share anchors; an
   anchor's context is the bytes of all windows that it anchors.
2. Equal contexts. Anchors and context hashes are dealt out by anchor, packed in
   buckets of arrays. Within a map task, later places of an equal context are settled
   before the shuffle. The first place of a context stands for all of it: every other
   place is a later copy from its first byte to its last.
3. Suffix sorting. Where one anchor has several contexts, one place of each is cut from
   its text, and each task sorts the suffixes of the contexts it got in two stages: only
   suffixes smaller than their successors are sorted directly, the others are induced
   from them, bucket by bucket. Common prefixes of adjacent suffixes tell which windows
   are equal; all but the earliest are later copies.
   An anchor with more than HOT contexts (the edge of a very common passage) is not
   sorted: its windows go, by their 128-bit hashes, through partial aggregation. One that
   has a fourth of HOT within MAP_ENTRIES of a map task is told from then on: its contexts
   go that way at once, without meeting, and a mark in its bucket sends those of other map
   tasks after them. So no task gathers the contexts of an anchor that a large share of
   all documents has.
4. The spans of later copies are joined back to the texts.

Where hashes stand for bytes (equal contexts, windows of hot anchors) they have 128 bits.

Defined results: null and empty texts keep nothing and have no spans; rows of equal id
and text are one document and get equal answers; rows of equal id and other text are
ordered by a hash; a null id comes before all; very long texts are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import Workspace

SPAN = 100
K = 32
HOT = 2000
MAP_ENTRIES = 400_000
BUCKET_BYTES = 12_000_000
MOST_PARTS = 20_000
SORT_BYTES = 1_500_000
NO_ID = -(1 << 63)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, span_starts array<long>, span_ends array<long>, kept_sha256 string"


def anchors(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, k: int = K):
    """For each anchor: its text, the first window it anchors, how many, the hash of its gram, and 128 bits of its context's."""
    width = span - k + 1
    n = len(data) - span + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty.view(np.uint64)
    at = np.arange(len(data) - k + 1)
    gram = tb.window_hash(data, k)
    low = np.uint64((1 << 28) - 1)
    order = (gram & ~low) | (low - at.astype(np.uint64))
    least = tb.sliding_min(order, width)
    where = (low - (least & low)).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    valid = np.arange(n) + span <= offsets[owner + 1]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    fresh[1:] = (where[1:] != where[:-1]) | ~valid[:-1] | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(fresh & valid)
    stops = np.flatnonzero(valid & np.append(fresh[1:] | ~valid[1:], True)) + 1
    ends = stops + span - 1
    # Two independent hashes of the context, from hashes of pieces that cover it: of pairs of grams, and of others.
    two = 2 * k <= span
    context = _cover(tb.absorb(gram[:-k], gram[k:]) if two else gram, 2 * k if two else k, starts, ends)
    other = 1 << (span.bit_length() - 2)
    twice = _cover(tb.window_hash(data, other, 2), other, starts, ends)
    own = owner[starts]
    return own, starts - offsets[own], stops - starts, gram[where[starts]], context, twice


def _cover(hashes: np.ndarray, size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces [start, end) of size bytes at least, from the hashes of size bytes in a row."""
    out = tb.mix((ends - starts).astype(np.uint64))
    for j in range(int(-(-(ends - starts).max(initial=0) // size))):
        out = tb.absorb(out, hashes[np.minimum(starts + j * size, ends - size)])
    return tb.mix(out)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of text in order, by their first depth bytes at least.

    A suffix smaller than the next one is sorted directly; every other has a first byte
    not less than the next suffix's, and its place follows from that one's place.
    """
    n = len(text)
    padded = np.concatenate((text, np.full(depth + 8, 255, np.uint8)))
    change = np.flatnonzero(padded[:n] != padded[1 : n + 1])
    after = np.searchsorted(change, np.arange(n))
    known = after < len(change)
    at = change[np.minimum(after, max(len(change) - 1, 0))] if len(change) else np.zeros(n, np.int64)
    small = np.where(known, padded[at] < padded[at + 1], True)
    direct = np.flatnonzero(small)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    direct = _sorted_directly(words, direct, depth)
    rank = np.full(n + 1, -1, dtype=np.int64)
    rank[n] = n  # beyond the end, after all
    heads = np.bincount(text, minlength=256)
    first = np.concatenate(([0], np.cumsum(heads)))
    by_byte = np.searchsorted(text[direct], np.arange(257))
    order = np.empty(n, dtype=np.int64)
    rest = np.flatnonzero(~small)
    rest = rest[np.argsort(text[rest], kind="stable")]
    cut = np.searchsorted(text[rest], np.arange(257))
    for c in range(256):
        own = direct[by_byte[c] : by_byte[c + 1]]
        order[first[c + 1] - len(own) : first[c + 1]] = own
        rank[own] = np.arange(first[c + 1] - len(own), first[c + 1])
    for c in range(256):
        todo, to = rest[cut[c] : cut[c + 1]], first[c]
        while len(todo):  # once more for each further step of a run of equal bytes
            ready = rank[todo + 1] >= 0
            now = todo[ready]
            now = now[np.argsort(rank[now + 1], kind="stable")]
            order[to : to + len(now)] = now
            rank[now] = np.arange(to, to + len(now))
            to += len(now)
            todo = todo[~ready]
    return order


def _sorted_directly(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first depth bytes, eight at a time; later bytes are looked at among ties alone."""

    def key(some: np.ndarray, d: int) -> np.ndarray:
        return np.ascontiguousarray(words[some + d]).view(">u8").ravel().astype(np.uint64)

    if not len(at):
        return at
    first = key(at, 0)
    order = np.argsort(first, kind="stable")
    out, first = at[order], first[order]
    head = np.concatenate(([True], first[1:] != first[:-1]))  # starts of ties
    for d in range(8, depth, 8):
        lone = head & np.append(head[1:], True)
        tied = np.flatnonzero(~lone)
        if not len(tied):
            break
        group = np.cumsum(head[tied])
        some = out[tied]
        value = key(some, d)
        order = np.argsort(value, kind="stable")
        order = order[np.argsort(group[order], kind="stable")]
        out[tied], value = some[order], value[order]
        head[tied[1:]] |= value[1:] != value[:-1]
    return out


def equal_windows(contexts: list[bytes], counts: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Windows (context, offset) with the number of the set of equal windows each is in; lone windows are left out.

    Returns positions in the joined contexts (each followed by a byte that UTF-8 never has) and their sets.
    """
    text = np.frombuffer(b"\xff".join(contexts) + b"\xff", dtype=np.uint8)
    lengths = np.array([len(c) for c in contexts]) + 1
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    window = np.zeros(len(text) + 1, dtype=np.int32)
    np.add.at(window, starts, 1)
    np.add.at(window, starts + counts, -1)
    window = np.cumsum(window[:-1]) > 0
    order = suffix_order(text, span)
    order = order[window[order]]
    padded = np.concatenate((text, np.full(8, 255, np.uint8)))
    same = np.ones(max(len(order) - 1, 0), dtype=bool)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for d in [*range(0, span - 7, 8), span - 8]:
        todo = np.flatnonzero(same)
        left = np.ascontiguousarray(words[order[todo] + d]).view(np.uint64).ravel()
        right = np.ascontiguousarray(words[order[todo + 1] + d]).view(np.uint64).ravel()
        same[todo] = left == right
    sets = np.concatenate(([0], np.cumsum(~same))) if len(order) else np.zeros(0, np.int64)
    many = np.bincount(sets)[sets] > 1 if len(sets) else np.zeros(0, bool)
    return order[many], sets[many]


_ENTRY = [("hash", "<u8"), ("c1", "<u8"), ("c2", "<u8"), ("id", "<i8"), ("doc", "<i8"), ("start", "<i8"), ("n", "<i4")]
_BLOBS = ", ".join(f"{name} binary" for name, _ in _ENTRY)


def _settle(e: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Of entries: the first place of each context, and the later copies. Repeated entries count once."""
    order = np.lexsort((e["start"], e["doc"], e["id"], e["c2"], e["c1"], e["hash"]))
    e = {k: v[order] for k, v in e.items()}
    new = np.ones(len(order), dtype=bool)
    new[1:] = (e["hash"][1:] != e["hash"][:-1]) | (e["c1"][1:] != e["c1"][:-1]) | (e["c2"][1:] != e["c2"][:-1])
    again = np.zeros(len(order), dtype=bool)
    again[1:] = ~new[1:] & (e["start"][1:] == e["start"][:-1]) & (e["doc"][1:] == e["doc"][:-1]) & (e["id"][1:] == e["id"][:-1])
    later = ~new & ~again
    # copies of the very first place stand at the front of its context
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
    later &= ~((e["start"] == e["start"][first]) & (e["doc"] == e["doc"][first]) & (e["id"] == e["id"][first]))
    return {k: v[new] for k, v in e.items()}, {k: v[later] for k, v in e.items()}


def _in_parts(data: np.ndarray, offsets: np.ndarray, span: int, k: int):
    """anchors(), for a very long text part by part: each window is in one part."""
    if len(data) <= tb.LONG or len(offsets) > 2:
        yield anchors(data, offsets, span, k)
        return
    for at in range(0, len(data) - span + 1, tb.LONG):
        part = data[at : at + tb.LONG + span - 1]
        own, start, *rest = anchors(part, np.array([0, len(part)]), span, k)
        yield own, start + at, *rest


def _map(span: int, k: int, buckets: int, hot: int = HOT):
    def frequent(firsts: dict[str, np.ndarray]) -> np.ndarray:
        """Contexts, in the order of their anchors' hashes, of anchors that have many here."""
        h = firsts["hash"]
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(cut, len(h)))
        return np.repeat(sizes > max(hot // 4, 1), sizes)

    def each(batches):
        held: list[dict] = []
        size = 0
        for batch in [*_iterate(batches), None]:
            if batch is not None:
                data, offsets = tb.column_bytes(batch.column(2))
                ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                docs = batch.column(1).to_numpy(zero_copy_only=False)
                for i, j in tb.chunks(offsets):
                    for own, start, n, gram, c1, c2 in _in_parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], span, k):
                        held.append({"hash": gram, "c1": c1, "c2": c2, "id": ids[own + i], "doc": docs[own + i], "start": start, "n": n.astype(np.int32)})
                        size += len(own)
            if held and (batch is None or size > MAP_ENTRIES):
                e = {f: np.concatenate([x[f] for x in held]) for f, _ in _ENTRY}
                held, size = [], 0
                firsts, later = _settle(e)
                many = frequent(firsts)
                straight = {f: v[many] for f, v in firsts.items()}
                marks = {f: np.zeros(len(np.unique(straight["hash"])), t) for f, t in _ENTRY} | {"hash": np.unique(straight["hash"])}
                firsts = {f: np.concatenate((v[~many], marks[f].astype(v.dtype))) for f, v in firsts.items()}
                bucket = tb.mix(firsts["hash"]) % np.uint64(buckets)
                order = np.lexsort((firsts["start"], firsts["doc"], firsts["id"], bucket))
                firsts, bucket = {f: v[order] for f, v in firsts.items()}, bucket[order]
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
                to = np.append(cut[1:], len(bucket))
                rows = [bucket[cut].astype(np.int64)] + [[v[a:b].astype(t).tobytes() for a, b in zip(cut, to, strict=True)] for (f, t) in _ENTRY for v in (firsts[f],)]
                yield _bucket_rows(rows)
                for odd, settled in ((1, later), (2, straight)):
                    if len(settled["doc"]):
                        yield _bucket_rows([np.array([-2 * int(settled["doc"][0] % buckets) - odd])] + [[settled[f].astype(t).tobytes()] for f, t in _ENTRY])

    return each


def _iterate(batches):
    yield from batches


def _bucket_rows(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", *[f for f, _ in _ENTRY]])


#: what: 0 a span of a later copy; 1 a context to sort; 2 a context of a hot anchor. Arrays of one document.
_FOUND = "id long, doc long, what int, hash binary, start binary, n binary"


def _by_doc(e: dict[str, np.ndarray], what: int) -> list[tuple]:
    if not len(e["doc"]):
        return []
    order = np.lexsort((e["start"], e["doc"], e["id"]))
    e = {f: v[order] for f, v in e.items()}
    cut = np.append(np.flatnonzero(np.concatenate(([True], (e["doc"][1:] != e["doc"][:-1]) | (e["id"][1:] != e["id"][:-1])))), len(order))
    if what == 0:  # windows run together
        out = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            s, t = e["start"][a:b], np.maximum.accumulate(e["start"][a:b] + e["n"][a:b])
            gap = np.flatnonzero(s[1:] > t[:-1])
            s, t = s[np.append(0, gap + 1)], t[np.append(gap, len(t) - 1)]
            out.append((int(e["id"][a]), int(e["doc"][a]), what, b"", s.astype("<i8").tobytes(), (t - s).astype("<i8").tobytes()))
        return out
    return [(int(e["id"][a]), int(e["doc"][a]), what, e["hash"][a:b].astype("<u8").tobytes(), e["start"][a:b].astype("<i8").tobytes(), e["n"][a:b].astype("<i8").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _found_rows(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["id", "doc", "what", "hash", "start", "n"])


def _reduce(hot: int):
    """Buckets, whole and in order, to spans and to contexts that must be compared."""

    def finish(parts: list[dict]):
        e = {f: np.concatenate([p[f] for p in parts]) for f, _ in _ENTRY}
        mark = e["n"] == 0
        told = np.unique(e["hash"][mark])
        firsts, later = _settle({f: v[~mark] for f, v in e.items()})
        new = np.concatenate(([True], firsts["hash"][1:] != firsts["hash"][:-1])) if len(firsts["hash"]) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        kinds = np.bincount(group)[group] if len(group) else group
        many = (kinds > hot) | np.isin(firsts["hash"], told)
        several = (kinds > 1) & ~many
        return _found_rows(_by_doc(later, 0) + _by_doc({f: v[several] for f, v in firsts.items()}, 1) + _by_doc({f: v[many] for f, v in firsts.items()}, 2))

    def each(batches):
        bucket, parts = None, []
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns)), strict=True):
                b = row[0].as_py()
                e = {f: np.frombuffer(row[i + 1].as_py(), dtype=t) for i, (f, t) in enumerate(_ENTRY)}
                if b < 0:
                    yield _found_rows(_by_doc(e, 0 if b % 2 else 2))
                    continue
                if parts and b != bucket:
                    yield finish(parts)
                    parts = []
                bucket = b
                parts.append(e)
        if parts:
            yield finish(parts)

    return each


def _cut(span: int):
    """Texts with their contexts to the contexts' bytes, or for hot anchors to the windows' hashes."""

    def rows(out: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*out, strict=True)) or [[]] * 7
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["hash", "c1", "id", "doc", "start", "n", "bytes"])

    def each(batches):
        out, size = [], 0
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(2))
            for d, (id_, doc, wanted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[d] : offsets[d + 1]].tobytes()
                for w in wanted:
                    places = zip(*(np.frombuffer(w[f], "<i8").tolist() for f in ("hash", "start", "n")), strict=True)
                    if w["what"] == 1:
                        out += [(h, None, id_, doc, s, n, raw[s : s + n + span - 1]) for h, s, n in places]
                    else:
                        for _, s, n in places:
                            for p in range(s, s + n):
                                x = hashlib.blake2b(raw[p : p + span], digest_size=16).digest()
                                out.append((int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True), id_, doc, p, 1, None))
                    if len(out) > 20_000:
                        yield rows(out)
                        out = []
        yield rows(out)

    return each


def _sort(span: int):
    """Contexts, whole anchors together, to spans of later copies."""

    def finish(rows: list[tuple]):
        ids, docs, starts, counts, contexts = (list(c) for c in zip(*rows, strict=True))
        counts = np.array(counts)
        at, sets = equal_windows(contexts, counts, span)
        begin = np.concatenate(([0], np.cumsum([len(c) + 1 for c in contexts])))
        which = np.searchsorted(begin, at, side="right") - 1
        e_id, e_doc = np.array([NO_ID if i is None else i for i in ids])[which], np.array(docs)[which]
        e_start = np.array(starts)[which] + at - begin[which]
        order = np.lexsort((e_start, e_doc, e_id, sets))
        later = np.concatenate(([False], sets[order][1:] == sets[order][:-1])) if len(order) else np.zeros(0, bool)
        pick = order[later]
        return _found_rows(_by_doc({"id": e_id[pick], "doc": e_doc[pick], "start": e_start[pick], "n": np.ones(len(pick), np.int64)}, 0))

    def each(batches):
        rows, size, anchor = [], 0, None
        for batch in batches:
            for h, i, d, s, n, b in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if h != anchor and size > SORT_BYTES:
                    yield finish(rows)
                    rows, size = [], 0
                anchor = h
                rows.append((i, d, s, n, b))
                size += len(b)
        if rows:
            yield finish(rows)

    return each


def repeated_spans(docs: DataFrame, work: Workspace, span: int = SPAN, k: int = K, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, DataFrame]:
    """Windows of span bytes that also start earlier: doc, start, n (n windows from start on, as arrays), and doc, s (single ones), each with id. docs: id, doc, text."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # Some buckets to a partition even out what hashing deals to each; a task holds one bucket at a time.
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, -(-int(size) // bucket_bytes)))
    buckets = max(8 * parts, -(-int(size) // bucket_bytes))
    placed = docs.select("id", "doc", "text").mapInArrow(_map(span, k, buckets, hot), f"bucket long, {_BLOBS}")
    found = work.keep(placed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_reduce(hot), _FOUND), batch_rows=16)
    wanted = found.where("what > 0").groupBy("id", "doc").agg(F.collect_list(F.struct("what", "hash", "start", "n")).alias("wanted"))
    contexts = work.keep(docs.dropDuplicates(["id", "doc"]).join(wanted, ["id", "doc"]).select("id", "doc", "text", "wanted").mapInArrow(_cut(span), "hash long, c1 long, id long, doc long, start long, n int, bytes binary"))
    to_sort = contexts.where("c1 is null").select("hash", "id", "doc", "start", "n", "bytes")
    by_sorting = to_sort.repartition("hash").sortWithinPartitions("hash").mapInArrow(_sort(span), _FOUND)
    windows = contexts.where("c1 is not null").select("hash", "c1", F.struct("id", "doc", "start").alias("place"))
    # Kept as a table, so that the join is one that Spark can split where one window has very many places.
    earliest = work.keep(windows.groupBy("hash", "c1").agg(F.min("place").alias("earliest"), F.count("*").alias("c")).where("c > 1"))
    by_hash = windows.join(earliest, ["hash", "c1"]).where("place.id <> earliest.id or place.doc <> earliest.doc or place.start <> earliest.start").select(F.col("place.id").alias("id"), F.col("place.doc").alias("doc"), F.col("place.start").alias("s"))
    settled = found.where("what = 0").unionByName(by_sorting).select("id", "doc", "start", "n")
    return settled, by_hash


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, k: int = K, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, keep_text: bool = False) -> DataFrame:
    """One row for each document, as in RESULT; with keep_text also kept, the bytes that are left."""
    work = Workspace(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = own.withColumns({"doc": F.xxhash64("doc_id", "text"), "id": F.coalesce("doc_id", F.lit(NO_ID))})
    settled, by_hash = repeated_spans(own, work, span, k, hot, bucket_bytes)
    one = settled.groupBy("id", "doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    two = by_hash.groupBy("id", "doc").agg(F.collect_list("s").alias("singles"))
    gone = work.keep(one.join(two, ["id", "doc"], "full"))

    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            out = []
            for d, (spans, singles) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[d] : offsets[d + 1]]
                cover = np.zeros(len(raw) + 1, dtype=np.int32)
                for x in spans or ():
                    s, n = np.frombuffer(x["start"], "<i8"), np.frombuffer(x["n"], "<i8")
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + n + span - 1, -1)
                if singles:
                    s = np.array(singles)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + span, -1)
                gone = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
                turn = np.flatnonzero(gone[1:] != gone[:-1])
                kept = raw[~gone[1:-1]].tobytes()
                out.append((len(raw), len(raw) - len(kept), len(turn) // 2, turn[::2].tolist(), turn[1::2].tolist(), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            c = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.string(), pa.binary()]
            columns = [batch.column(0), *[pa.array(x, t) for x, t in zip(c, kinds, strict=True)]]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "span_starts", "span_ends", "kept_sha256", "kept"]
            m = 8 if keep_text else 7
            yield pa.RecordBatch.from_arrays(columns[:m], names=names[:m])

    joined = own.join(gone, ["id", "doc"], "left").select("doc_id", "text", "spans", "singles")
    return joined.mapInArrow(each, RESULT + (", kept binary" if keep_text else ""))
