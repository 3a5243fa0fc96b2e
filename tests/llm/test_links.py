"""The n-gram join, the Merkle manifest and the prefix trie, against brute force on small tables with odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import convtrie, merkle, ngramjoin
from spanloom.llm.workspace import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset() if not w else frozenset({tuple(w)}) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_join(rows, n=3, percent=90):
    sets = [shingle_set(t, n) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def joined(spark, rows, **settings):
    docs = spark.createDataFrame([(d, t, "x", 1, 2) for d, t in rows], "doc_id long, text string, c string, n int, token int").repartition(3)
    return sorted((tuple(r) for r in ngramjoin.jaccard_components(docs, **settings).collect()), key=repr)


def family(r, base, size, share):
    return [" ".join(w if r.random() > share else f"x{r.randrange(9999)}" for w in base) for _ in range(size)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    word = lambda: f"w{r.randrange(3000)}"
    out = [None, "", "  \n ", "one", "ONE", "one two", "One  two", "é ß", "one two three"]
    base = [word() for _ in range(300)]
    out += [" ".join(base), " ".join(base).upper(), "\n".join(base)] + family(r, base, 60, 0.01) + family(r, base, 40, 0.03)
    other = [word() for _ in range(80)]
    out += family(r, other, 30, 0.012)
    shared = " ".join(word() for _ in range(60))
    out += [f"{' '.join(word() for _ in range(r.randrange(5, 90)))} {shared}" for _ in range(40)]
    out += [" ".join(word() for _ in range(k)) for k in range(1, 30)]
    return [(i, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("settings", [{}, {"cell": 7, "fragments": 3, "hot_least": 5}, {"cell": 2, "fragments": 1}, {"words": 1, "percent": 80, "hot_least": 10}])
def test_join_equals_brute_force(spark, texts, settings):
    assert joined(spark, texts, **settings) == brute_join(texts, settings.get("words", 3), settings.get("percent", 90))


def test_join_with_null_and_repeated_ids_and_long_texts(spark):
    r = random.Random(3)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(60_000))
    rows = [(5, long), (4, long + " end"), (5, "something else here"), (5, "something else here"), (None, "no id in this row"), (None, "no id in this row"), (9, "no id in this row"), (None, None), (None, "alone and without id"), (7, "x" * 400_000), (8, "x" * 400_000)]
    assert joined(spark, rows) == brute_join(rows)


def test_join_of_an_empty_table(spark):
    assert joined(spark, []) == []
    assert joined(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_forests_share_no_pair_and_span():
    r = np.random.default_rng(1)
    label = np.arange(40)
    a, b = np.triu_indices(40, 1)
    keep = r.random(len(a)) < 0.4
    a, b, cost = a[keep], b[keep], r.random(int(keep.sum()))
    one = ngramjoin.forests(label, a, b, cost, 1)
    assert len(one) == 39
    three = ngramjoin.forests(label, a, b, cost, 3)
    assert len(set(three.tolist())) == len(three) and set(one.tolist()) <= set(three.tolist()) and len(three) > 100
    assert set(ngramjoin.forests(label, a, b, cost, 64).tolist()) == set(range(len(a)))


def test_bitmaps_never_lose_a_link():
    r = random.Random(8)
    for _ in range(200):
        n = r.randrange(1, 400)
        base = {r.getrandbits(47) for _ in range(n)}
        other = {x for x in base if r.random() > 0.06} | {r.getrandbits(47) for _ in range(r.randrange(4))}
        pair = sorted([base, other or {1}], key=len)
        bits, sizes = [], np.array([len(s) for s in pair])
        for s in pair:
            width = 1 << max(6, (len(s) - 1).bit_length())
            bits.append(np.packbits((np.bincount(np.array(sorted(s)) & (width - 1), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes())
        found = len(ngramjoin.near_pairs(sizes, np.zeros(2, np.int64), bits, np.arange(2), 90)[0])
        if 100 * len(pair[0] & pair[1]) >= 90 * len(pair[0] | pair[1]):
            assert found == 1


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    code = lambda row: H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, code(row), row))

    def tree(level):
        out = [level]
        while len(level) > 1:
            level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
            out.append(level)
        return out

    def way(levels, at):
        for level in levels[:-1]:
            start = at - at % 3
            yield level[start:at], level[at + 1 : start + 3]
            at //= 3

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [*way(trees[g], i), *way(top, k)]
            spoilt = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None
            h = code((*row[:4], row[4].replace("\n", ""))) if spoilt else leaf
            for left, right in steps:
                h = H(*left, h, *right)
            out.append((row[0], leaf, trees[g][-1][0], top[-1][0], H(*[x for left, right in steps for x in left + right]), h, h == top[-1][0]))
    return sorted(out, key=repr)


def proved(spark, rows, few=merkle.FEW):
    docs = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at int, tree string").repartition(4)
    fields = {name: F.col(name) for name in merkle.FIELDS}
    other = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, merkle.leaf_hash(fields | {"text": F.regexp_replace("text", "\n", "")}))
    made = merkle.manifest(docs, carry={"other": other}, few=few)
    found = merkle.proofs(made)
    folded = merkle.folded(merkle.folded(F.coalesce("other", "leaf"), F.col("siblings"), F.col("depth")), F.col("above"), F.col("top_depth"))
    found = found.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), merkle.proof_hash(F.col("siblings"), F.col("above")).alias("p"), folded.alias("folded")).withColumn("ok", F.col("folded") == F.col("root"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.mark.parametrize("few", [merkle.FEW, 5, 0])
def test_manifest_equals_brute_force(spark, few):
    r = random.Random(2)
    rows = [(i, r.choice(["a", "a", "a", "b", "é", "z"]), r.choice([None, "en"]), r.choice([None, 3]), r.choice([None, "", "x\ny", "ß\n", f"text {i}"])) for i in range(150)]
    rows += [(None, "a", None, None, "t"), (3, "a", "en", 1, "again"), (3, "a", "en", 1, "again"), (7, None, None, None, None), (8, None, "fr", 2, "n\nn"), (9, "lone", "x", 1, "l" * 300_000), (None, None, None, None, None)]
    assert proved(spark, rows, few) == brute_manifest(rows)


@pytest.mark.parametrize("count", [0, 1, 2, 3, 4, 28])
def test_manifest_of_one_group(spark, count):
    rows = [(i, "s", "en", i, f"{i}\n") for i in range(count)]
    assert proved(spark, rows) == brute_manifest(rows)


def brute_trie(rows, share=20):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    paths = {}
    for c in turns:
        own, h = [(x[2], x[4]) for x in sorted(turns[c])], zlib.crc32(str(c).encode()) % 4
        given = [(x[2], x[4]) for x in sorted(turns.get(c - c % share, []))][:h]
        paths[c] = (*given, *own[h:])
    members = defaultdict(set)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].add(c)
    below = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    out = []
    for node, m in members.items():
        ends = sorted(c for c in m if len(paths[c]) == len(node))
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below[node] if x)
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], sum(not kids[x] for x in below[node]), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_of(spark, rows, block=convtrie.BLOCK):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, place int, k1 string").repartition(3)
    work, conv = Workspace(spark), F.col("conv_id")
    turns = convtrie.turns_in_order(table, work)
    lengths, built = convtrie.rebuilt(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4, 3, work)
    return sorted((tuple(r) for r in convtrie.trie(lengths, built, work, block).collect()), key=repr)


@pytest.mark.parametrize("block", [convtrie.BLOCK, 2])
def test_trie_equals_brute_force(spark, block):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice(["hello there", "yes", "no thanks\nbye", ""])) for c in range(1, 120) for t in range(r.randrange(0, 7)) if c % 20 or c != 40]
    rows += [(200, None, None, None), (200, None, "user", "a"), (200, 0, "user", "b"), (200, 0, "assistant", "b"), (200, 0, "user", "b"), (None, 1, "user", "lost"), (201, 5, "user", "x " * 50_000), (-7, 0, "user", "yes"), (-7, 1, None, "yes")]
    rows += [(300, t, "user", f"turn {t % 3}") for t in range(40)] + [(305, t, "user", f"turn {t % 3}") for t in range(41)]
    assert trie_of(spark, rows, block) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []


def test_streamed_hash_goes_over_batches(spark):
    ids = spark.range(5000).select(F.lit(1).cast("long").alias("depth"), F.lit(2).cast("long").alias("k1"), F.lit(3).cast("long").alias("k2"), F.col("id").alias("conv_id"))
    found = ids.coalesce(1).sortWithinPartitions("conv_id").mapInArrow(convtrie._streamed_hash, "depth long, k1 long, k2 long, ends_sha256 string").collect()
    assert [r.ends_sha256 for r in found] == [hashlib.sha256(",".join(map(str, range(5000))).encode()).hexdigest()]


def test_bitmaps_do_not_go_along_with_each_shingle(spark, monkeypatch):
    kept = []
    keep = Workspace.keep

    def noted(self, df, *more):
        found = keep(self, df, *more)
        kept.append((set(found.columns), found.count()))
        return found

    monkeypatch.setattr(Workspace, "keep", noted)
    rows = [(k, " ".join(f"w{k // 2}x{i}" for i in range(60)) + (" end" if k % 2 else "")) for k in range(20)]
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(k, k - k % 2) for k in range(20)]
    # A row for each list and member; a class's shingles of the prefix are many more.
    assert sum(n for columns, n in kept if {"token", "bits"} <= columns) <= 20
    assert any(n > 20 for columns, n in kept if columns == {"c", "token"})
