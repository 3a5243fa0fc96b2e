"""N-gram Jaccard join by vertical partitioning: documents that share most of their shingles.

A document's set is its distinct shingles, as 48-bit hashes. All n-grams have one global
order, rare ones first; sets are cut into fragments along it, partial overlaps are counted
fragment by fragment, and a pair's overlap is their sum. Steps:

1. Sets. One pass gives each document the size and a 128-bit hash of its set; documents of
   equal sets are one class, whatever their number. Copies go on once from each task.
2. Frequencies. A second pass deals the shingles out by ranges of their hashes, so that a
   task has all classes of its shingles and counts them. Shingles of one class alone can be
   shared with nobody: they are counted in the set's size and go no further, which is most of
   any text. Shingles of a HOT share of the classes, found by lossy counting in the first
   pass, are dealt out by class instead, and are last in the order without a count.
3. Candidates. Sets that overlap enough share one of the first, rarest shingles of both (the
   prefix), so the classes of each prefix shingle are a list; lists of the same members are
   one. In a list, pairs must agree in size, and a lower bound of their difference (parity
   bitmaps of about a bit a shingle, and what only one set has) must not be above what the
   threshold allows. Both filters are safe: no linked pair is lost.
4. Overlaps. A candidate pair meets fragment by fragment; partial overlaps are summed.

Links matter up to reachability, so a list doesn't give all its pairs: a round gives edges of
spanning forests over what is not yet joined (1, 8, 64, ... of them, the closest pairs first),
links merge, and rounds go on until no list has a pair left between components that was
not counted. So pairs grow with the members of lists, not with their squares. A list of more
than CELL classes is cut into cells; in the first round each class is in one, later those
outside the list's largest component meet all, and lists that are one component rest.

Defined results: null or empty texts and texts without words have empty sets, no links and
their own id as component; with fewer words than a shingle the whole sequence is one; rows of
equal texts or sets are one class, also rows of equal id; the least id is taken among those
that are not null, and is null where there is none; an empty table gives no rows. Other
columns of the table play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .neardup import shingles
from .workspace import Workspace, partitions

WORDS = 3
PERCENT = 90
#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: Hot shingles: of one in HOT_SHARE classes, of HOT_LEAST at least, and HOT_MOST shingles at most; those beyond are dealt out like others.
HOT_SHARE, HOT_LEAST, HOT_MOST = 128, 1000, 1 << 16
#: Classes of a list that meet in one task.
CELL = 1024
#: Bytes of shingles for each partition of the frequency count.
TASK_BYTES = 32 << 20
_PERIOD = 16
_LAST = 0x7FFF


def _sets_of(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text, the index of each text's first, and the 16 bytes of each set's hash."""
    values, first = shingles(data, offsets, words)
    n = np.diff(first)
    both = np.empty((len(n), 2), np.uint64)
    for seed in (0, 1):
        total = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(values + np.uint64(seed + 11)))))
        both[:, seed] = tb.mix((total[first[1:]] - total[first[:-1]]) + tb.mix(n.astype(np.uint64)))
    return values, first, both.view("V16").ravel()


def _unseen(ids: np.ndarray, n: np.ndarray, seen: set[bytes]) -> np.ndarray:
    """True for texts with shingles whose set this task has not had before."""
    fresh = np.zeros(len(ids), bool)
    for k in np.flatnonzero(n):
        key = ids[k].tobytes()
        if key not in seen:
            seen.add(key)
            fresh[k] = True
    return fresh


def _first_pass(words: int):
    """A row for each document; and, with gram set, shingles that many sets of a period of chunks have."""

    def hot(held: list[np.ndarray], docs: int) -> pa.RecordBatch:
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts >= max(4, docs / (2 * HOT_SHARE))
        grams, counts = grams[often], counts[often]
        none = pa.nulls(len(grams), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.nulls(len(grams), pa.binary()), pa.array(grams.view(np.int64)), pa.array(counts)], names=["doc_id", "n", "c", "gram", "seen"])

    def each(batches):
        seen: set[bytes] = set()
        held, docs = [], 0
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for i, j in tb.chunks(offsets):
                values, first, ids = _sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n = np.diff(first)
                keys = pa.array([x.tobytes() if k else None for x, k in zip(ids, n, strict=True)], pa.binary())
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), keys, none, none], names=["doc_id", "n", "c", "gram", "seen"])
                fresh = _unseen(ids, n, seen)
                held.append(values[np.repeat(fresh, n)])
                docs += int(fresh.sum())
                if len(held) == _PERIOD:
                    yield hot(held, docs)
                    held, docs = [], 0
        if held:
            yield hot(held, docs)

    return each


def _low40(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8", copy=False)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _wide(low: bytes) -> np.ndarray:
    out = np.zeros((len(low) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(low, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def _gaps(owner: np.ndarray) -> bytes:
    """Ascending numbers below 65536 as differences."""
    return np.diff(owner, prepend=0).astype("<u2").tobytes()


#: Rows that are dealt out: of a chunk of texts (uid) the shingles of one part, with their texts as gaps (COLD, HOT), or the sets' hashes and sizes of the whole chunk (NAMES).
COLD, HOT, NAMES = 0, 1, 2
_BLOB = "part int, kind int, uid long, gaps binary, grams binary, extra binary"


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], strict=True)], names=["part", "kind", "uid", "gaps", "grams", "extra"])


def _second_pass(words: int, parts: int, hot: np.ndarray):
    """Shingles by the part that they belong to: hot ones by their chunk, others by their hash. A chunk is some texts of one task, so copies come once from each task at most."""

    def each(batches):
        seen: set[bytes] = set()
        uid = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(0))
            for low, high in tb.chunks(offsets, min(16, max(4, parts >> 4)) * tb.CHUNK):
                for i in range(low, high, 1 << 16):
                    j = min(high, i + (1 << 16))
                    values, first, ids = _sets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                    n = np.diff(first)
                    owner = np.repeat(np.arange(len(n)), n)
                    mine = _unseen(ids, n, seen)[owner]
                    values, owner = values[mine], owner[mine]
                    if not len(values):
                        continue
                    uid += 1
                    is_hot = hot[np.minimum(np.searchsorted(hot, values), len(hot) - 1)] == values if len(hot) else np.zeros(len(values), bool)
                    part = (((values >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
                    part[is_hot] = parts
                    order = np.argsort(part, kind="stable")
                    values, owner, part = values[order], owner[order], part[order]
                    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
                    rows = [(uid % parts, NAMES, uid, b"", ids.tobytes(), n.astype("<u4").tobytes())]
                    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                        at = int(part[a])
                        rows.append((uid % parts if at == parts else at, HOT if at == parts else COLD, uid, _gaps(owner[a:b]), _low40(values[a:b]), b""))
                    yield _blobs(rows)

    return each


def _repeated(parts: int):
    """Of the shingles of a part those that several sets have, with their frequencies, by chunk; other rows as they are."""

    def each(batches):
        cold = []
        for batch in batches:
            other = []
            for part, kind, uid, gaps, grams, extra in zip(*[batch.column(k).to_pylist() for k in range(6)], strict=True):
                if kind == COLD:
                    cold.append((part, uid, gaps, grams))
                else:
                    extra = extra if kind == NAMES else np.full(len(grams) // 5, _LAST, "<u2").tobytes()
                    other.append((uid % parts, kind, uid, gaps, grams, extra))
            if other:
                yield _blobs(other)
        if not cold:
            return
        part, uids, gaps, grams = zip(*cold, strict=True)
        sizes = np.array([len(g) // 5 for g in grams])
        values = _wide(b"".join(grams)) | (np.repeat(np.array(part, np.uint64) & np.uint64(255), sizes) << np.uint64(40))
        order = np.argsort(values, kind="stable")
        ordered = values[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        times = np.diff(np.append(starts, len(ordered)))
        count = np.empty(len(values), np.int64)
        count[order] = np.repeat(times, times)
        count = np.minimum(count, _LAST - 1)
        rows, at = [], 0
        for k, size in enumerate(sizes.tolist()):
            times = count[at : at + size]
            more = times > 1
            if more.any():
                owner = np.cumsum(np.frombuffer(gaps[k], "<u2").astype(np.int64))
                rows.append((uids[k] % parts, part[k] & 255, uids[k], _gaps(owner[more]), _low40(values[at : at + size][more]), times[more].astype("<u2").tobytes()))
            at += size
        # The kind of what was cold is its part's low byte, above the others: it belongs to the shingle.
        for k in range(0, len(rows), 1000):
            yield _blobs([(dest, kind + NAMES + 1, *rest) for dest, kind, *rest in rows[k : k + 1000]])

    return each


def _whole(percent: int):
    """c, n and tokens (frequency above hash, ascending) of sets that share enough of their shingles to link with another."""

    def each(batches):
        named, blobs = {}, []
        for batch in batches:
            for kind, uid, gaps, grams, extra in zip(*[batch.column(k).to_pylist() for k in range(1, 6)], strict=True):
                if kind == NAMES:
                    named[uid] = (np.frombuffer(grams, "V16"), np.frombuffer(extra, "<u4").astype(np.int64))
                else:
                    blobs.append((uid, kind, gaps, grams, extra))
        blobs.sort(key=lambda x: x[0])
        i = 0
        while i < len(blobs):
            j = i
            while j < len(blobs) and blobs[j][0] == blobs[i][0]:
                j += 1
            ids, n = named[blobs[i][0]]
            owner = np.concatenate([np.cumsum(np.frombuffer(x[2], "<u2").astype(np.int64)) for x in blobs[i:j]])
            byte = np.concatenate([np.full(len(x[4]) // 2, 0 if x[1] == HOT else x[1] - NAMES - 1, np.uint64) for x in blobs[i:j]])
            times = np.frombuffer(b"".join(x[4] for x in blobs[i:j]), "<u2").astype(np.uint64)
            tokens = _wide(b"".join(x[3] for x in blobs[i:j])) | (byte << np.uint64(40)) | (times << np.uint64(48))
            held = np.bincount(owner, minlength=len(n))
            enough = (held > 0) & (held >= -(-percent * n // 100))
            kept = enough[owner]
            tokens, owner = tokens[kept].view(np.int64), owner[kept]
            order = np.lexsort((tokens, owner))
            tokens = tokens[order]
            who = np.flatnonzero(enough)
            ends = np.append(0, np.cumsum(held[who]))
            for k in range(0, len(who), 500):
                some = who[k : k + 500]
                cut = ends[k : k + len(some) + 1]
                lists = pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), pa.array(tokens[cut[0] : cut[-1]]))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids[some]], pa.binary()), pa.array(n[some]), lists], names=["c", "n", "tokens"])
            i = j

    return each


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def _described(percent: int):
    """Adds to each class the number of shingles that it alone has, its prefix and its parity bitmap."""

    def each(batches):
        for batch in batches:
            n, lists = batch.column(1).to_pylist(), batch.column(2)
            single, prefix, bits = [], [], []
            values, edges = lists.values.to_numpy(), lists.offsets.to_numpy()
            for k, size in enumerate(n):
                tokens = values[edges[k] : edges[k + 1]]
                single.append(size - len(tokens))
                prefix.append(tokens[: size - overlap_needed(size, percent) + 1 - single[-1]])
                width = 1 << max(6, int(size - 1).bit_length())
                bits.append(np.packbits((np.bincount(tokens & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(single, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary()), lists], names=["c", "n", "single", "prefix", "bits", "tokens"])

    return each


def near_pairs(n: np.ndarray, single: np.ndarray, bits: list[bytes], label: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of different labels that may link, by size and by the lower bound of their difference; and that bound's share of what is allowed. n ascends."""
    a, b, share = [], [], []
    width = np.array([len(x) for x in bits])
    edges = {int(w): (int(np.searchsorted(width, w)), int(np.searchsorted(width, w, side="right"))) for w in np.unique(width)}
    maps = {w: np.frombuffer(b"".join(bits[i:j]), np.uint8).reshape(j - i, w).view("<u8") for w, (i, j) in edges.items()}
    folds = {w: m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :] for w, m in maps.items() if m.shape[1] > 1}
    for i in range(len(n) - 1):
        own = maps[int(width[i])][i - edges[int(width[i])][0]]
        until = int(np.searchsorted(n, 100 * int(n[i]) // percent, side="right"))
        for w, held in ((int(width[i]), maps), (2 * int(width[i]), folds)):
            if w not in held:
                continue
            low, high = max(i + 1, edges[w][0]), min(until, edges[w][1])
            if low >= high:
                continue
            both = n[i] + n[low:high]
            allowed = both - 2 * -(-percent * both // (100 + percent))
            least = np.bitwise_count(held[w][low - edges[w][0] : high - edges[w][0]] ^ own).sum(axis=1, dtype=np.int64) + single[i] + single[low:high]
            good = np.flatnonzero((least <= allowed) & (label[low:high] != label[i]))
            a.append(np.full(len(good), i))
            b.append(good + low)
            share.append(least[good] / np.maximum(allowed[good], 1))
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(a), np.concatenate(b), np.concatenate(share)


def forests(label: np.ndarray, a: np.ndarray, b: np.ndarray, cost: np.ndarray, count: int) -> np.ndarray:
    """Indices of the pairs in count spanning forests over labels that share no pair, each of least cost among what the others leave."""
    _, code = np.unique(label, return_inverse=True)
    order = np.lexsort((b, a, cost))
    left, taken = order, []
    for _ in range(count):
        if not len(left):
            break
        top, chosen = np.arange(code.max() + 1), np.zeros(len(left), bool)
        while True:
            x, y = top[code[a[left]]], top[code[b[left]]]
            apart = np.flatnonzero(x != y)
            if not len(apart):
                break
            best = np.full(len(top), len(left))
            np.minimum.at(best, x[apart], apart)
            np.minimum.at(best, y[apart], apart)
            picked = np.unique(best[best < len(left)])
            chosen[picked] = True
            # Each component hooks to its pair's other side; of two that pick the same pair, the smaller stays.
            mine = np.flatnonzero(best < len(left))
            other = np.where(x[best[mine]] == mine, y[best[mine]], x[best[mine]])
            parent = np.arange(len(top))
            parent[mine] = other
            mutual = (parent[parent] == np.arange(len(top))) & (np.arange(len(top)) < parent)
            parent[mutual] = np.flatnonzero(mutual)
            while (parent[parent] != parent).any():
                parent = parent[parent]
            top = parent[top]
        taken.append(left[chosen])
        left = left[~chosen]
    return np.concatenate(taken) if taken else np.zeros(0, np.int64)


def _cells(percent: int, count: int):
    """Pairs of each cell for this round; a row of nulls for a cell that has more. Rows come sorted by (token, cell)."""

    def solve(rows: pa.Table):
        rows = rows.sort_by("n")
        n, single = rows["n"].to_numpy(), rows["single"].to_numpy()
        names, (_, label) = rows["c"].to_pylist(), np.unique(np.array(rows["label"].to_pylist(), dtype="S16"), return_inverse=True)
        a, b, share = near_pairs(n, single, rows["bits"].to_pylist(), label, percent)
        chosen = forests(label, a, b, share, count)
        found = [(*sorted(((names[x], int(n[x])), (names[y], int(n[y])))),) for x, y in zip(a[chosen].tolist(), b[chosen].tolist(), strict=True)]
        out = [(p, q, k, m) for (p, k), (q, m) in found]
        return out + [(None, None, None, None)] if len(chosen) < len(a) else out

    def each(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            token, cell = rows["token"].to_numpy(), np.array(rows["cell"].to_pylist(), dtype=str)
            edges = np.append(np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (cell[1:] != cell[:-1]))), len(token))
            out = []
            for i, j in zip(edges[:-2].tolist(), edges[1:-1].tolist(), strict=True):
                out += solve(rows.slice(i, j - i))
            held = rows.slice(int(edges[-2]))
            if out:
                yield _pair_rows(out)
        if held is not None and (out := solve(held)):
            yield _pair_rows(out)

    return each


def _pair_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.binary(), pa.binary(), pa.int64(), pa.int64()], strict=True)], names=["a", "b", "na", "nb"])


def _in_cells(members: DataFrame, labels: DataFrame | None, cell: int, work: Workspace) -> DataFrame:
    """members with label and cell: any two of a list whose labels differ share a cell, but in the first round (no labels) large lists have each class in one cell only."""
    parts = F.ceil(F.col("m") / cell).cast("int")
    if labels is None:
        alone = F.when(F.col("m") > cell, F.pmod(F.xxhash64("c"), parts).cast("string")).otherwise("")
        return members.withColumns({"label": F.col("c"), "cell": alone})
    marked = members.join(labels.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    marked = work.keep(marked)
    counts = marked.groupBy("token", "m", "label").agg(F.count("*").alias("k"))
    most = counts.groupBy("token", "m").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("k")).where("k < m")
    most = most.select("token", "main", F.ceil(F.col("k") / cell).cast("int").alias("ins"), F.ceil((F.col("m") - F.col("k")) / cell).cast("int").alias("outs"))
    every = lambda size: F.sequence(F.lit(0), size - 1)
    named = lambda kind, x, y: F.concat_ws(",", F.lit(kind), x.cast("string"), y.cast("string"))
    at = lambda size: F.pmod(F.xxhash64("c"), size)
    inside = F.transform(every(F.col("outs")), lambda y: named("in", at(F.col("ins")), y))
    across = F.transform(every(F.col("ins")), lambda x: named("in", x, at(F.col("outs"))))
    among = F.transform(every(F.col("outs")), lambda y: named("out", F.least(y, at(F.col("outs"))), F.greatest(y, at(F.col("outs")))))
    cells = F.when(F.col("m") <= cell, F.array(F.lit(""))).when(F.col("label") == F.col("main"), inside).otherwise(F.concat(across, among))
    return marked.join(most, "token").withColumn("cell", F.explode(cells)).select(*members.columns, "label", "cell")


def segments(classes: DataFrame, fragments: int, work: Workspace) -> DataFrame:
    """c, fragment, tokens: each class's tokens, cut at places of the global order that halve, quarter, ... all tokens."""
    shares = [k / fragments for k in range(1, fragments)]
    cuts = classes.select(F.explode("tokens").alias("t")).agg(F.percentile_approx("t", shares, 1000)).first()[0] or []
    edges = [-1, *sorted(set(cuts)), (1 << 63) - 1]
    between = lambda low, high: F.filter("tokens", lambda t: (t > low) & (t <= high))
    pieces = [F.struct(F.lit(k).alias("fragment"), between(low, high).alias("tokens")) for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    return work.keep(classes.select("c", F.inline(F.array(*pieces))).where("size(tokens) > 0"))


def overlaps(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """a, b, na, nb and their overlap: the sum of the fragments' partial overlaps."""
    left = cut.select(F.col("c").alias("a"), "fragment", F.col("tokens").alias("of_a"))
    right = cut.select(F.col("c").alias("b"), "fragment", F.col("tokens").alias("of_b"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("shared"))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("overlap"))


def similar_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS, cell: int = CELL, hot_least: int = HOT_LEAST) -> tuple[DataFrame, DataFrame, Workspace]:
    """Documents (doc_id, n, c: their class, null for an empty set), and the labels (node, label) of classes that have a link."""
    spark = docs.sparkSession
    work = Workspace(spark)
    docs = docs.select("doc_id", "text")
    keyed = work.keep(docs.mapInArrow(_first_pass(words), "doc_id long, n long, c binary, gram long, seen long"))
    rows = keyed.where("gram is null").select("doc_id", "n", "c")
    total, sizes = rows.agg(F.count("c"), F.sum("n")).first()
    often = keyed.where("gram is not null").groupBy("gram").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= max(hot_least, total / HOT_SHARE))
    hot = np.sort(np.array([r[0] for r in often.orderBy(F.desc("seen"), "gram").limit(HOT_MOST).select("gram").collect()], np.int64).view(np.uint64))
    parts = partitions(spark, 6 * (sizes or 0), TASK_BYTES)
    dealt = docs.select("text").mapInArrow(_second_pass(words, parts, hot), _BLOB)
    repeated = dealt.repartitionById(parts, "part").mapInArrow(_repeated(parts), _BLOB)
    whole = repeated.repartitionById(parts, "part").mapInArrow(_whole(percent), "c binary, n long, tokens array<long>").dropDuplicates(["c"])
    classes = work.keep(whole.mapInArrow(_described(percent), "c binary, n long, single long, prefix array<long>, bits binary, tokens array<long>"))
    postings = work.keep(classes.select("c", F.explode("prefix").alias("token")))
    lists = postings.groupBy("token").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("c")).alias("f1"), F.bit_xor(F.xxhash64("c", F.lit(1))).alias("f2")).where("m > 1")
    lists = lists.groupBy("m", "f1", "f2").agg(F.min("token").alias("token")).select("token", "m")
    # Bitmaps go to the members of lists that are left, and not along with each shingle of a prefix.
    members = postings.join(lists, "token").select("token", "m", "c").join(classes.select("c", "n", "single", "bits"), "c")
    members = work.keep(members.select("token", "m", "c", "n", "single", "bits"))
    cut = segments(classes, fragments, work)
    labels, links, tested, count = None, None, None, 1
    while True:
        placed = _in_cells(members, labels, cell, work)
        found = work.keep(placed.repartition("token", "cell").sortWithinPartitions("token", "cell").mapInArrow(_cells(percent, count), "a binary, b binary, na long, nb long"))
        split = labels is None and members.where(F.col("m") > cell).limit(1).count() > 0
        more = split or found.where("a is null").limit(1).count() > 0
        pairs = found.where("a is not null").distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        counted = work.keep(overlaps(pairs, cut).select("a", "b", (100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))).alias("linked")))
        tested = counted.select("a", "b") if tested is None else tested.unionByName(counted.select("a", "b"))
        new = counted.where("linked").select("a", "b")
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            labels = work.keep(components(links, work))
        if not more:
            break
        if labels is None:
            labels = spark.createDataFrame([], "node binary, label binary")
        count *= 8
    return rows, labels if labels is not None else spark.createDataFrame([], "node binary, label binary"), work


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, **settings) -> DataFrame:
    """doc_id, n_shingles, component_id of each document: the least doc_id that links reach. docs: doc_id, text."""
    rows, labels, work = similar_sets(docs, words, percent, **settings)
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"))
    named = work.keep(least.join(labels.withColumnRenamed("node", "c"), "c", "left").select("c", "least", F.coalesce("label", "c").alias("label")))
    top = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = work.keep(named.join(top, "label").select("c", "component_id"))
    return rows.join(of_class, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
