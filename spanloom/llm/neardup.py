"""MinHash near-dedup by an LSH forest.

A document's set is its distinct WORDS-word shingles. Documents of equal sets are one
class; a class has a signature of SLOTS MinHash values. Each of TREES trees is a sorted
order of the classes by their signature, read from another slot on. Classes with a common
prefix of DEPTH values or more in some order are one region of that tree; regions never
need to be sorted with one another, and each task sorts its own.

Pairs of one region whose signatures agree in enough slots are candidates. They are looked
at in two rounds, so that within a component confirmations follow the number of documents,
not the square of its size, while no candidate between different components is left out:

1. A spanning forest of the candidates, confirmed on the full sets; its components. A small
   region has all its pairs at hand. A large one (more than MATRIX classes) takes stars
   around the classes nearest to its modal signature, and for the classes that no star
   reached goes as deep into the sorted order as each needs: to the neighbour of longest
   common prefix that is a candidate. Regions beyond REGION classes are worked on in blocks,
   whose components then meet by their best linked classes.
2. All candidates that still join different components. Large regions are cut into cells,
   so that any two of their classes of different components share one. Signatures alone tell
   which classes of a region or cell have such a candidate; these meet there again with their
   full sets, and candidates are confirmed on the spot, best first, components merging as
   links are found. So what travels follows the classes, not the candidates.

Defined results: null or empty texts (and those without words) have the empty set, are
linked with nothing and are their own component; with fewer words than a shingle the whole
sequence is one; copies share a class, whatever their number, without being paired; a null
id is in its class but never names a component if another id can; ties go to the smallest
id; an empty table gives no rows. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .workspace import Workspace, partitions

WORDS = 3
PERCENT = 85
SLOTS = 128
TREES, DEPTH = 16, 5
REGION = 16_384
MATRIX = 512
HUBS, NEAR = 8, 8
PAIRS = 100_000
CELL_BYTES = 64 << 20
BITMAP_WORDS = 1 << 18
TASK_BYTES = 8 << 20
_ROW = "doc_id long, doc long, n_shingles long, h1 long, h2 long, sig binary"


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the index of each text's first."""
    hashes, first = tb.words(data, offsets, tb.NONSPACE)
    counts = np.diff(first)
    whole = tb.grams(hashes, words)
    starts = tb.within(first, len(hashes), words)
    owner = np.searchsorted(first, starts, side="right") - 1
    values = whole[starts] if len(starts) else np.zeros(0, np.uint64)
    for n in range(1, words):  # shorter sequences as wholes
        short = np.flatnonzero(counts == n)
        if len(short):
            owner = np.concatenate((owner, short))
            values = np.concatenate((values, tb.grams_at(hashes, first[short], n)))
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.searchsorted(owner[new], np.arange(len(offsets)))


_SEEDS = tb.mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Low 16 bits of the least value of each set under SLOTS multiplications; rows of empty sets are zero."""
    out = np.zeros((len(first) - 1, SLOTS), dtype="<u2")
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        starts = first[full]
        for s in range(SLOTS):
            x = values * _SEEDS[s]
            x ^= x >> np.uint64(32)
            out[full, s] = (tb.mix(np.minimum.reduceat(x, starts)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def _sets(words: int):
    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(2))
            for i, j in tb.chunks(offsets):
                values, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                n = np.diff(first)
                both = []
                for seed in (0, 1):  # of a whole set
                    total = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(values + np.uint64(seed)))))
                    both.append(tb.mix((total[first[1:]] - total[first[:-1]]) + tb.mix(n.astype(np.uint64))).view(np.int64))
                sig = signatures(values, first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), *map(pa.array, both), pa.array([s.tobytes() for s in sig], pa.binary())], names=["doc_id", "doc", "n_shingles", "h1", "h2", "sig"])

    return each


def _prefixes(trees: int):
    """For each class and tree: the tree, and a hash of the first DEPTH values of its order."""

    def each(batches):
        slots = (np.arange(trees)[:, None] * DEPTH + np.arange(DEPTH)[None, :]) % SLOTS
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SLOTS).astype(np.uint64)
            keys = np.empty((len(sig), trees), dtype=np.uint64)
            for t in range(trees):
                x = np.full(len(sig), t + 1, dtype=np.uint64)
                for s in slots[t]:
                    x = tb.mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, s])
                keys[:, t] = x
            at, of = np.repeat(np.arange(len(sig)), trees), np.tile(np.arange(trees), len(sig))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(of.astype(np.int32)), pa.array(keys[at, of].view(np.int64))], names=["cls", "tree", "region"])

    return each


def regions(classes: DataFrame, work: Workspace, trees: int = TREES) -> DataFrame:
    """region, cls, n, sig, tree, size: classes by the regions of the forest that hold two or more."""
    placed = work.keep(classes.select("cls", "sig").mapInArrow(_prefixes(trees), "cls long, tree int, region long"))
    sizes = work.keep(placed.groupBy("region").agg(F.count("*").alias("size")).where("size > 1"))
    whole = placed.join(sizes, "region")
    return work.keep(whole.join(classes.select("cls", "n", "sig").hint("merge"), "cls").select("region", "cls", "n", "sig", "tree", "size"))


def _part(of, salt: int = 0):
    return F.pmod(F.xxhash64("cls", "tree", F.lit(salt)), of).cast("int")


def _blocks(size: str, largest: int):
    return F.ceil(F.col(size) / largest).cast("int")


def in_blocks(grouped: DataFrame, largest: int) -> DataFrame:
    """region, cls, sig, tree: with each block of a region of more than largest classes as a region."""
    cut = F.when(F.col("size") > largest, F.xxhash64("region", _part(_blocks("size", largest)))).otherwise(F.col("region"))
    return grouped.select(cut.alias("region"), "cls", "sig", "tree")


def leaders(marked: DataFrame, links: DataFrame, largest: int) -> DataFrame:
    """region, cls, sig, tree: of each component in a region of more than largest classes, the class with most links; in blocks where they are many."""
    degrees = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").count()
    linked = marked.where(F.col("size") > largest).drop("size").join(degrees, "cls")
    first = linked.groupBy("region", "label").agg(F.max_by(F.struct("cls", "sig", "tree"), F.struct("count", "cls")).alias("first")).select("region", "first.*")
    sizes = first.groupBy("region").agg(F.count("*").alias("size")).where("size > 1")
    return in_blocks(first.join(sizes, "region"), largest)


def cells(wide: DataFrame, work: Workspace, largest: int, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """Large regions as cells, so that any two classes of different components share one.

    One of two such classes is outside the region's largest component, so blocks of those
    outside meet blocks of all. wide: region, cls, n, sig, tree, label; returns its rows of
    regions of several components, by cells (as region).
    """
    total = wide.groupBy("region", "label").agg(F.count("*").alias("count"), F.sum("n").alias("values"))
    most = total.groupBy("region").agg(F.max_by("label", F.struct("count", "label")).alias("most"), F.sum("count").alias("size"), F.max("count").alias("top"), F.sum("values").alias("values"), F.max_by("values", F.struct("count", "label")).alias("inner"))
    blocks = lambda rows, values: F.greatest(F.ceil(rows / largest), F.ceil(values * 6 / cell_bytes), F.lit(1)).cast("int")
    # A region that is one component has nothing to test.
    most = work.keep(most.where("size > top").select("region", "most", blocks(F.col("size"), F.col("values")).alias("parts"), blocks(F.col("size") - F.col("top"), F.col("values") - F.col("inner")).alias("outs")))
    wide = work.keep(wide.join(most, "region"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    everyone = wide.select("*", _part(F.col("parts")).alias("j")).select("*", every("outs").alias("o"))
    outside = wide.where("label <> most").select("*", every("parts").alias("j")).withColumn("o", _part(F.col("outs"), 1))
    return everyone.unionByName(outside).select(F.xxhash64("region", "o", "j").alias("region"), "cls", "sig", "tree", "label")


def forest(sig: np.ndarray, least: int, matrix: int = MATRIX, tree: int = 0) -> list[tuple[int, int]]:
    """Pairs of rows that agree in least slots or more: a spanning forest, best pairs first; stars and neighbours in the sorted order where rows are many."""
    n = len(sig)
    if n <= matrix:
        agree = np.zeros((n, n), dtype=np.int16)
        for s in range(sig.shape[1]):
            agree += sig[:, s][:, None] == sig[:, s][None, :]
        a, b = np.nonzero(np.triu(agree >= least, 1))
        order = np.argsort(-agree[a, b], kind="stable")
        top, out = list(range(n)), []

        def find(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for i, j in zip(a[order].tolist(), b[order].tolist(), strict=True):
            x, y = find(i), find(j)
            if x != y:
                top[max(x, y)] = min(x, y)
                out.append((i, j))
        return out
    out = []
    left = np.arange(n)
    for _ in range(HUBS):
        if len(left) < 2:
            break
        own = sig[left]
        hub = left[int(_to_mode(own).argmax())]
        near = ((own == sig[hub]).sum(axis=1) >= least) & (left != hub)
        out += [(int(hub), int(x)) for x in left[near]]
        left = left[~near & (left != hub)]
    return out + prefix_neighbours(sig, left, least, tree)


def prefix_neighbours(sig: np.ndarray, wanted: np.ndarray, least: int, tree: int = 0) -> list[tuple[int, int]]:
    """For each wanted row its neighbour of longest common prefix that agrees with it in least slots or more, of the NEAR on either side in the tree's order."""
    turned = np.roll(sig, -tree * DEPTH, axis=1)
    order = np.array(sorted(range(len(sig)), key=lambda i: turned[i].astype(">u2").tobytes()), dtype=np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    found: list[tuple[int, int]] = []
    if not len(wanted):
        return found
    best, depth = np.full(len(wanted), -1, np.int64), np.full(len(wanted), -1, np.int64)
    for step in [s * k for k in range(1, NEAR + 1) for s in (-1, 1)]:
        at = place[wanted] + step
        ok = np.flatnonzero((at >= 0) & (at < len(order)))
        other = order[at[ok]]
        same = turned[wanted[ok]] == turned[other]
        common = np.cumprod(same, axis=1).sum(axis=1)
        better = (same.sum(axis=1) >= least) & (common > depth[ok])
        best[ok[better]], depth[ok[better]] = other[better], common[better]
    return [(int(a), int(b)) for a, b in zip(wanted, best, strict=True) if b >= 0]


def _to_mode(sig: np.ndarray) -> np.ndarray:
    """For each row, the slots in which it has the most frequent value."""
    return (sig == np.array([_mode(sig[:, s]) for s in range(sig.shape[1])], dtype=sig.dtype)).sum(axis=1)


def _mode(values: np.ndarray) -> int:
    found, counts = np.unique(values, return_counts=True)
    return found[counts.argmax()]


def _apart(sig: np.ndarray, v: int, other: np.ndarray, least: int, earlier: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows with other: those that agree with row v in least slots or more, and in how many.

    Pairs that share a region in one of the earlier trees are left to that tree.
    """
    same = sig == sig[v]
    agree = same.sum(axis=1)
    near = np.flatnonzero((agree >= least) & other)
    if earlier and len(near):
        near = near[~same[near, : earlier * DEPTH].reshape(len(near), earlier, DEPTH).all(axis=2).any(axis=1)]
    return near, agree[near]


def open_rows(sig: np.ndarray, comp: np.ndarray, least: int, earlier: int = 0) -> np.ndarray:
    """Rows that agree in least slots or more with a row of another component, but for pairs of earlier trees."""
    found, counts = np.unique(comp, return_counts=True)
    out = np.zeros(len(sig), dtype=bool)
    if len(found) > 1:
        for v in np.flatnonzero(comp != found[counts.argmax()]).tolist():
            near, _ = _apart(sig, v, comp != comp[v], least, earlier)
            out[near] = True
            out[v] |= len(near) > 0
    return np.flatnonzero(out)


def linked_across(sig: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], least: int, percent: int, earlier: int = 0) -> list[tuple[int, int]]:
    """Links between rows of different components, enough to join all components that have any."""
    comp = np.unique(comp, return_inverse=True)[1]
    top = np.bincount(comp).argmax()
    sizes = np.array([len(x) for x in sets])
    out = []
    for v in np.flatnonzero(comp != top).tolist():
        if comp[v] == top and (comp == top).all():
            break
        near, agree = _apart(sig, v, comp != comp[v], least, earlier)
        n, m = np.minimum(sizes[near], sizes[v]), np.maximum(sizes[near], sizes[v])
        near, agree = near[100 * n >= percent * m], agree[100 * n >= percent * m]
        near = near[np.argsort(-agree, kind="stable")]
        step = 16
        while len(near):
            now, near = near[:step], near[step:]
            step = max(16, min(8 * step, int(4_000_000 // max(1, sizes[v]))))
            both = _overlaps(sets[v], [sets[y] for y in now])
            for y in now[100 * both >= percent * (sizes[v] + sizes[now] - both)].tolist():
                if comp[y] != comp[v]:
                    out.append((v, y))
                    comp[comp == max(comp[v], comp[y])] = min(comp[v], comp[y])
                    top = np.bincount(comp).argmax()
            near = near[comp[near] != comp[v]]
    return out


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of one, sorted, each of the others has; none is empty."""
    values = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, values), len(one) - 1)
    starts = np.concatenate(([0], np.cumsum([len(x) for x in others])[:-1]))
    return np.add.reduceat((one[at] == values).astype(np.int64), starts)


def _by_region(work_on):
    """Regions, whole, to what work_on(signatures, rows) gives: pairs of rows, as pairs of classes."""

    def finish(rows: list[tuple]):
        cls = np.array([r[0] for r in rows])
        pairs = iter(work_on(_signatures(rows), rows))
        while part := list(itertools.islice(pairs, PAIRS)):
            of = cls[np.array(part)]
            yield pa.RecordBatch.from_arrays([pa.array(of.min(axis=1), pa.int64()), pa.array(of.max(axis=1), pa.int64())], names=["a", "b"])

    return lambda batches: (out for rows in _regions(batches) for out in finish(rows[1]))


def _signatures(rows: list[tuple]) -> np.ndarray:
    return np.frombuffer(b"".join(r[1] for r in rows), "<u2").reshape(-1, SLOTS)


def _regions(batches) -> Iterator[tuple[int, list[tuple]]]:
    """Each region that has two classes or more, with its rows in the order of classes, each once."""

    def whole(rows: list[tuple]) -> list[tuple]:
        return sorted({r[0]: r for r in rows}.values(), key=lambda r: r[0])

    rows, region = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(batch.num_columns)), strict=True):
            if row[0] != region and len(rows) > 1:
                yield region, whole(rows)
            if row[0] != region:
                rows = []
            region = row[0]
            rows.append(row[1:])
    if len(rows) > 1:
        yield region, whole(rows)


def _open(least: int):
    """Regions, whole, to their rows that open_rows() gives."""

    def each(batches):
        for region, rows in _regions(batches):
            picked = open_rows(_signatures(rows), np.array([r[3] for r in rows]), least, rows[0][2])
            if len(picked):
                columns = list(zip(*(rows[i] for i in picked.tolist()), strict=True))
                kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([region] * len(picked), pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["region", "cls", "sig", "tree", "label"])

    return each


def _confirm(percent: int):
    def each(batches):
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in range(2, 6)), strict=True):
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(_unpack(x), _unpack(y), assume_unique=True))
                keep.append(100 * both >= percent * (n + m - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return each


def _pack(values: np.ndarray) -> bytes:
    """Upper 48 bits of sorted hashes: two different shingles of a pair of sets collide in one of 10**8 pairs or fewer."""
    return (values >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _full_sets(words: int):
    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            for i, j in tb.chunks(offsets):
                values, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), pa.array([_pack(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["cls", "n", "set"])

    return each


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()


def _at(key: str, words: int):
    """The place of a hash in a bitmap of so many words (a power of two), and its bit."""
    return F.shiftright(key, 6).bitwiseAND(F.lit(words - 1)), F.col(key).bitwiseAND(F.lit(63)).cast("int")


def maybe_among(rows: DataFrame, key: str, wanted: DataFrame, of: str, most: int = BITMAP_WORDS) -> DataFrame:
    """Rows whose key, a hash, may be one of wanted's: all that are, and of the others a few in a hundred.

    It goes before a join that moves whole rows, so that those without a partner stay where they
    are. A bitmap of 16 bits for each wanted hash is broadcast; beyond most words of 64 bits it
    lets more of the others through.
    """
    words = 1 << max(0, min(most.bit_length() - 1, (wanted.count() // 4).bit_length()))
    word, bit = _at(of, words)
    bitmap = wanted.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.expr("1L"), bit)).alias("_bits"))
    word, bit = _at(key, words)
    return rows.withColumn("_word", word).join(F.broadcast(bitmap), "_word").where(F.getbit("_bits", bit) == 1).select(*rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, trees: int = TREES, region: int = REGION, matrix: int = MATRIX) -> DataFrame:
    """One row for each document: doc_id, n_shingles, cls (the number of its class), component_id, kept, doc (a hash of id and text), first.

    Of each component one document is first, whatever the ids: the smallest id's, of equal ids (and of none) that of least hash.

    region and matrix bound the work of a task; the result does not depend on them.
    """
    spark = docs.sparkSession
    work = Workspace(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("doc", F.xxhash64("doc_id", "text"))
    rows = work.keep(own.select("doc_id", "doc", "text").mapInArrow(_sets(words), _ROW))
    named = rows.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")).alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    classes = work.keep(named.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "first.doc_id", "first.doc", "n", "sig"))
    # Agreement of two signatures is binomial; three and a half deviations below the threshold lose one pair in thousands of those at it.
    share = percent / 100
    least = int(SLOTS * share - 3.5 * (SLOTS * share * (1 - share)) ** 0.5)
    grouped = regions(classes, work, trees)
    parts = partitions(spark, work.size(grouped), TASK_BYTES)

    def pairs_of(sharing: DataFrame, work_on) -> DataFrame:
        return sharing.repartition(parts, "region").sortWithinPartitions("region").mapInArrow(_by_region(work_on), "a long, b long").distinct()

    def marked(rows: DataFrame, comp: DataFrame) -> DataFrame:
        return rows.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))

    def sets_of(involved: DataFrame) -> DataFrame:
        # Both sides of these joins grow with the documents, so they are shuffled at any size.
        where = work.keep(classes.join(involved, "cls").select("cls", F.col("doc_id").alias("i"), F.col("doc").alias("d"))).hint("merge")
        # Most texts are involved in nothing, and would be most of what is shuffled.
        texts = maybe_among(own, "doc", where, "d").join(where, (F.col("doc") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i"))).select("cls", "text")
        return work.keep(texts.mapInArrow(_full_sets(words), "cls long, n long, set binary").dropDuplicates(["cls"]))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        one = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("set").alias("sa"))
        two = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("set").alias("sb"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "na", "nb", "sa", "sb")
        return work.keep(both.mapInArrow(_confirm(percent), "a long, b long"))

    def some(rows: DataFrame) -> bool:
        return rows.limit(1).count() > 0

    spanning = lambda sig, rows: forest(sig, least, matrix, rows[0][2])
    tested = work.keep(pairs_of(in_blocks(grouped, region), spanning))
    sets = sets_of(_ends(tested))
    links = confirmed(tested, sets)
    comp = components(links, work)

    large = F.col("size") > min(matrix, region)
    if some(grouped.where(F.col("size") > region)):
        more = work.keep(pairs_of(leaders(marked(grouped, comp), links, region), spanning).join(tested, ["a", "b"], "left_anti"))
        links = links.union(confirmed(more, sets))  # leaders have links, so their sets are there
        comp = components(links, work)
    columns = ["region", "cls", "sig", "tree", "label"]
    sharing = marked(grouped.where(~large), comp).select(*columns)
    if some(grouped.where(large)):
        sharing = sharing.union(cells(marked(grouped.where(large), comp).select("region", "cls", "n", "sig", "tree", "label"), work, region).select(*columns))
    several = sharing.select("region", "label").groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("region")
    unsettled = work.keep(sharing.join(work.keep(several), "region").repartition(parts, "region").sortWithinPartitions("region").mapInArrow(_open(least), "region long, cls long, sig binary, tree int, label long"))
    if some(unsettled):
        fresh = work.keep(unsettled.select("cls").distinct().join(sets.select("cls"), "cls", "left_anti"))
        if some(fresh):
            sets = sets.union(sets_of(fresh))
        held = unsettled.join(sets.select("cls", "set").hint("merge"), "cls").select(*columns, "set")
        inside = lambda sig, rows: linked_across(sig, np.array([r[3] for r in rows]), [_unpack(r[4]) for r in rows], least, percent, rows[0][2])
        found = work.keep(pairs_of(held, inside), batch_rows=200)
        if some(found):
            comp = components(links.union(found), work)
    labelled = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "h1", "h2", "doc_id", F.coalesce("label", "cls").alias("label"), "doc")
    names = work.keep(labelled.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc")).alias("least")))
    of_class = work.keep(labelled.drop("doc_id", "doc").join(names, "label").select("cls", "h1", "h2", F.col("least.doc_id").alias("component_id"), F.col("least.doc").alias("least")))
    result = rows.select("doc_id", "doc", "n_shingles", "h1", "h2").join(of_class, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return result.select("doc_id", "n_shingles", "cls", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "doc", ((F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(component) & (F.col("doc") == F.col("least")))).alias("first"))
