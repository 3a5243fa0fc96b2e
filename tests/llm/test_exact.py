"""Operators whose results are exact, against brute force on small tables with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import curveknn, decontaminate, langid, licences, linededup, neardup, suffixdedup
from spanloom.llm import textbytes as tb
from spanloom.llm.hilbert import hilbert_key
from spanloom.llm.workspace import Workspace

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(r, n, vocabulary=60):
    return " ".join(f"w{r.randrange(vocabulary)}{r.choice(['', 'é', '.', ','])}" for _ in range(n))


def corpus(spark, texts, **more):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    base = prose(r, 400)
    words = base.split(" ")
    out = [None, "", " ", "\n\n", "one", "One", "one two", base, base, base.upper(), " ".join(words[:390]), " ".join(words[5:]), " ".join(words[:200] + ["new"] + words[201:])]
    line = prose(r, 14)
    out += [f"{prose(r, 20)}\n{line}\n\n{prose(r, 5)}\n{line}", f"{line}\n{prose(r, 8)}", "\n".join([line] * 3), prose(r, 3000, 10), "x" * 5000, "é" * 300 + "ß" * 300]
    out += [" ".join(w if r.random() > 0.02 else "zz" for w in words) for _ in range(40)]
    out += [prose(r, r.randrange(1, 60)) for _ in range(30)] + [f"{prose(r, 30)} {base[100:400]} {prose(r, 30)}" for _ in range(10)]
    return out


def shingle_set(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset() if not w else frozenset({tuple(w)}) if len(w) < n else frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def brute_components(texts, n, percent):
    sets = [shingle_set(t, n) for t in texts]
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                top[y] = x
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("words", "percent", "trees"), [(3, 85, 16), (5, 80, 24)])
def test_near_duplicates(spark, texts, words, percent, trees):
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(corpus(spark, texts), words=words, percent=percent, trees=trees).collect())
    assert got == [(i, n, c, i == c) for i, n, c in brute_components(texts, words, percent)]


def test_near_duplicates_of_odd_tables(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (7, "a b c d"), (3, None), (None, "")], "doc_id long, text string")
    got = sorted(neardup.near_duplicates(rows).select("doc_id", "component_id", "kept").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(None, 7, False), (7, 7, True), (7, 7, True), (3, 3, True), (None, None, True)], key=lambda x: f"Row(doc_id={x[0]}, component_id={x[1]}, kept={x[2]})")


def test_large_regions_take_stars_and_split():
    r = np.random.default_rng(1)
    hub = r.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
    rows = np.array([np.where(r.random(neardup.SLOTS) < 0.1, r.integers(0, 1 << 16, neardup.SLOTS), hub) for _ in range(neardup.MATRIX + 50)], dtype=np.uint16)
    rows[17] = hub
    pairs = neardup.forest(rows, 94)
    assert len(pairs) == len(rows) - 1 and all(17 in p for p in pairs)
    comp = np.arange(len(rows))
    assert neardup.open_rows(rows[:60], comp[:60], 94).tolist() == list(range(60))


def test_rows_that_are_near_to_another_component():
    r = np.random.default_rng(4)
    hub = r.integers(0, 1 << 16, neardup.SLOTS).astype(np.uint16)
    n = neardup.MATRIX + 50
    rows = np.array([np.where(r.random(neardup.SLOTS) < 0.1, r.integers(0, 1 << 16, neardup.SLOTS), hub) for _ in range(n)], dtype=np.uint16)
    comp = np.arange(n) // (n // 2 + 20)
    agree = (rows[:, None, :] == rows[None, :, :]).sum(axis=2)
    near = (comp[:, None] != comp[None, :]) & (agree >= 94)
    assert neardup.open_rows(rows, comp, 94).tolist() == np.flatnonzero(near.any(axis=1)).tolist()
    first = (rows[:, None, :5] == rows[None, :, :5]).all(axis=2)
    assert neardup.open_rows(rows, comp, 94, 1).tolist() == np.flatnonzero((near & ~first).any(axis=1)).tolist()


def test_classes_far_from_hubs_take_the_neighbour_of_longest_prefix():
    r = np.random.default_rng(6)
    n = neardup.MATRIX + 100
    rows = r.integers(0, 1 << 16, (n, neardup.SLOTS)).astype(np.uint16)
    for k in range(1, n, 2):  # pairs that are near to one another alone
        rows[k] = rows[k - 1]
        rows[k, 100:110] = r.integers(0, 1 << 16, 10)
    for tree in (0, 3):
        found = {(min(p), max(p)) for p in neardup.forest(rows, 94, tree=tree)}
        assert {(k - 1, k) for k in range(1, n, 2)} <= found and len(found) <= n


def test_cells_find_links_between_all_components():
    r = np.random.default_rng(8)
    sets = [np.unique(r.integers(0, 200, 150)).astype(np.uint64) for _ in range(12)]
    sets += [np.unique(np.append(x[3:], r.integers(300, 400, 2))).astype(np.uint64) for x in sets]
    comp = np.arange(24)
    got = neardup.linked_across(np.zeros((24, neardup.SLOTS), np.uint16), comp.copy(), sets, 0, 85)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert all(near(sets[a], sets[b]) for a, b in got)
    want = neardup.linked_across(np.zeros((24, neardup.SLOTS), np.uint16), comp.copy(), sets, 0, 101)
    assert want == [] and len(got) == 12


def family(r, n):
    """Texts of one family: each a few changes away from an earlier one or from the first."""
    texts = [prose(r, 150, 5000).split(" ")]
    for _ in range(n - 1):
        own = list(texts[0] if r.random() < 0.5 else r.choice(texts[-60:]))
        for _ in range(r.randrange(1, 4)):
            own[r.randrange(len(own))] = prose(r, 1, 5000)
        if r.random() < 0.3:
            at = r.randrange(140)
            own[at : at + r.randrange(10)] = prose(r, 4, 5000).split(" ")
        texts.append(own)
    return [" ".join(x) for x in texts]


def components_by_product(texts, percent):
    """As brute_components(), by a product of matrices of three-word shingles that more than one text has."""
    words = [t.split(" ") for t in texts]
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in words]
    often = {}
    for s in sets:
        for g in s:
            often[g] = often.get(g, 0) + 1
    number = {g: i for i, g in enumerate(g for g, c in often.items() if c > 1)}
    has = np.zeros((len(texts), len(number)), np.float32)
    for i, s in enumerate(sets):
        has[i, [number[g] for g in s if g in number]] = 1
    both, sizes = has @ has.T, np.array([len(s) for s in sets])
    near = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(near, True)
    label = np.arange(len(texts))
    while True:
        low = np.where(near, label[None, :], len(texts)).min(axis=1)
        if (low == label).all():
            return [(i, int(n), int(c)) for i, (n, c) in enumerate(zip(sizes, label, strict=True))], int(near.sum() - len(texts)) // 2
        label = low


def test_texts_that_are_involved_in_nothing_stay_where_they_are(spark, monkeypatch):
    moved = []
    among = neardup.maybe_among

    def counted(rows, *a, **k):
        out = among(rows, *a, **k)
        moved.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(neardup, "maybe_among", counted)
    r = random.Random(3)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(40)) for _ in range(400)]
    texts += [t + " more" for t in texts[:5]]
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(corpus(spark, texts)).collect()}
    assert sum(k != v for k, v in got.items()) == 5
    assert moved and all(n == 405 and m < 60 for n, m in moved)
    hashes = spark.range(3000).select("id", F.xxhash64("id").alias("h"))
    for n in (0, 1, 300, 3000):
        for most in (1, 1 << 18):
            found = among(hashes, "h", hashes.where(f"id < {n}").select(F.col("h").alias("w")), "w", most)
            assert found.where(f"id < {n}").count() == n == found.select("id").where(f"id < {n}").distinct().count()


@pytest.mark.parametrize(("region", "matrix"), [(16_384, 512), (200, 512), (16_384, 64), (64, 20)])
def test_a_large_family_loses_no_links_at_any_limit(spark, region, matrix):
    texts = family(random.Random(29), 3200)
    want, links = components_by_product(texts, 85)
    assert links > 100_000 and len({c for _, _, c in want}) > 100
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(corpus(spark, texts), region=region, matrix=matrix).collect())
    assert got == want


def test_links_far_from_the_hub_of_a_large_region(spark, texts):
    r = random.Random(21)
    words = prose(r, 400, 5000).split(" ")
    more = list(texts)
    for k in range(12):  # each is near to the one before, the ends are far from each other
        words[k * 8 : k * 8 + 8] = prose(r, 8, 5000).split(" ")
        more.append(" ".join(words))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(corpus(spark, more), matrix=2).collect())
    assert got == brute_components(more, 3, 85)


@pytest.mark.parametrize(("region", "matrix"), [(3, 512), (7, 2)])
def test_regions_beyond_the_limit_lose_no_links(spark, texts, region, matrix):
    r = random.Random(23)
    base = prose(r, 300, 5000).split(" ")
    more = list(texts)
    for k in range(40):  # each shares about 0.86 with base, and less with one another
        own = list(base)
        own[k * 7 : k * 7 + 20] = prose(r, 20, 5000).split(" ")
        more.append(" ".join(own))
    more.append(" ".join(base))
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in neardup.near_duplicates(corpus(spark, more), region=region, matrix=matrix).collect())
    assert got == brute_components(more, 3, 85)


def brute_repeats(rows, span):
    seen, out = set(), {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - span + 1):
            if raw[p : p + span] in seen:
                gone[p : p + span] = True
            seen.add(raw[p : p + span])
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[i] = (len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "bucket"), [(2000, 12_000_000), (1, 5000), (0, 200)])
def test_suffix_dedup(spark, texts, hot, bucket):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_suffixes(corpus(spark, texts), hot=hot, bucket_bytes=bucket).collect()}
    assert got == brute_repeats(list(enumerate(texts)), 100)


def test_suffix_dedup_of_a_passage_that_most_documents_share(spark):
    r = random.Random(31)
    passage = prose(r, 60, 5000)
    rows = [(i, f"{prose(r, 8, 5000)} {passage} {prose(r, 8, 5000)}" if i % 3 else prose(r, 60, 5000)) for i in range(300)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffixdedup.dedup_suffixes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=20).collect()}
    assert got == brute_repeats(rows, 100)


def test_suffix_dedup_of_odd_tables(spark):
    assert suffixdedup.dedup_suffixes(empty(spark)).count() == 0
    long = prose(random.Random(1), 60)
    rows = spark.createDataFrame([(2, long), (2, long), (None, long), (5, long + "!")], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed) for r in suffixdedup.dedup_suffixes(rows).collect()}
    n = len(long.encode())
    assert got == {(None, 0), (2, n), (5, n)}


def test_suffix_order():
    r = np.random.default_rng(2)
    for _ in range(20):
        x = r.integers(97, 97 + r.integers(1, 5), r.integers(1, 300)).astype(np.uint8)
        padded = x.tobytes() + b"\xff" * 40
        order = suffixdedup.suffix_order(x, 24)
        keys = [padded[i : i + 24] for i in order]
        assert keys == sorted(keys) and sorted(order) == list(range(len(x)))


def brute_lines(rows, min_words):
    seen, out = set(), {}
    for i, t in rows:
        lines = (t or "").split("\n")
        full = [(k, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for k, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x)]
        gone = set()
        for a in range(len(full)):
            keys = [b for b in range(a + 1, len(full) + 1) if sum(x[2] for x in full[a:b]) >= min_words]
            keys = {b: tuple(x[1] for x in full[a:b]) for b in keys}
            for b, key in keys.items():  # runs of every length
                if key in seen:
                    gone |= {x[0] for x in full[a:b]}
            seen |= set(keys.values())
        out[i] = (len(full), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark, texts):
    r = random.Random(9)
    pool = [prose(r, r.randrange(1, 6)) for _ in range(12)]
    more = texts + ["\n".join(r.choice([*pool, "", " "]) for _ in range(r.randrange(1, 25))) for _ in range(60)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in linededup.dedup_lines(corpus(spark, more), carry=("start",)).collect()}
    assert got == brute_lines(list(enumerate(more)), linededup.MIN_WORDS)
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_intervals_of_the_line_suffix_array(spark):
    """Suffixes share an interval where their key runs and the lines after are equal, also where an interval goes on over several parts of the array."""
    r = random.Random(23)
    rows = [(d, -1 - d, s, r.choice([1, 2]), r.choice([3, 3, 3, 8]), r.choice([1, 1, 5]), [r.choice([4, 4, 4, 6]) for _ in range(r.randrange(5))]) for d in range(300) for s in range(3)]
    rows += [(None if d % 9 else d, d, 0, 2, 3, 1, [4, 4, 4]) for d in range(1000, 2500)]
    work = Workspace(spark)
    kept = work.keep(spark.createDataFrame(rows, "doc_id long, doc long, seq int, n int, first long, last long, tail array<long>").repartition(5))
    found = linededup.lcp_intervals(kept, work, 4).collect()
    of = {(doc, seq): rest for _, doc, seq, *rest in rows}
    names = {}
    for x in found:
        n, first, last, tail = of[x.doc, x.seq]
        assert x.n == n and x.more <= len(tail)
        names.setdefault((x.more, n, first, last, *tail[: x.more]), set()).add(x.start)
    assert len(found) == sum(len(x[6]) + 1 for x in rows)
    assert all(len(x) == 1 for x in names.values())
    assert len({(k[0], *v) for k, v in names.items()}) == len(names)
    assert len({x.start >> 33 for x in found}) > 1
    assert linededup.lcp_intervals(work.keep(kept.limit(0)), work, 4).count() == 0


def test_hot_line_runs_over_many_parts(spark):
    r = random.Random(29)
    hot = "\n".join(prose(r, 4) for _ in range(6))
    texts = [f"{prose(r, 12)}\n{hot}\n{prose(r, 3)}" if i % 3 else hot for i in range(400)]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in linededup.dedup_lines(corpus(spark, texts)).collect()}
    assert got == brute_lines(list(enumerate(texts)), linededup.MIN_WORDS)


def test_whole_maximal_line_runs_go(spark):
    r = random.Random(19)
    body, tail, end = prose(r, 20, 5000), "The end.", "x y z"
    rows = [(1, f"{body}\n{tail}\n{end}\nown one"), (2, f"a\n{tail}\n{body}\n\n{tail}\nother"), (3, f"{tail}\n{body}\n{tail}\n{end}"), (None, "q " * 12 + "\nshort"), (None, "q " * 12 + "\nshort"), (9, "q " * 12 + "\nshort\nz"), (9, "own text of row nine")]
    got = sorted((x.doc_id or 0, x.n_removed, x.text) for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("gone", F.lit(1))).collect())
    assert got == [(0, 0, rows[3][1]), (0, 0, rows[3][1]), (1, 0, rows[0][1]), (2, 2, f"a\n{tail}\n\nother"), (3, 4, ""), (9, 0, "own text of row nine"), (9, 2, "z")]


def test_hashes_tell_regular_texts_apart():
    order = [0]
    while len(order) < 1024:
        order += [1 - x for x in order]
    one = np.array([97 if x else 32 for x in order], np.uint8)
    other = np.array([32 if x else 97 for x in order], np.uint8)
    for size in (8, 16, 63, 64, 100, 1024):
        at = np.zeros(1, np.int64)
        assert tb.piece_hash(one, at, at + size) != tb.piece_hash(other, at, at + size)
        assert tb.window_hash(one, size)[0] != tb.window_hash(other, size)[0]
    r = np.random.default_rng(1)
    x = r.integers(97, 99, 3000).astype(np.uint8)
    for size in (1, 3, 8, 13, 32, 100):
        seen = {}
        for i, h in enumerate(tb.window_hash(x, size).tolist()):
            assert seen.setdefault(h, x[i : i + size].tobytes()) == x[i : i + size].tobytes()
        assert len(seen) == len({x[i : i + size].tobytes() for i in range(len(x) - size + 1)})
    for size in (1, 7, 8, 9, 63, 64, 65):
        piece = r.integers(0, 255, size).astype(np.uint8)
        found = {int(tb.piece_hash(np.concatenate((np.zeros(k, np.uint8), piece, np.ones(k, np.uint8))), np.array([k]), np.array([k + size]))[0]) for k in range(4)}
        assert len(found) == 1


def brute_windows(docs, items):
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for name, t in items:
        w = split(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(name))
    out = {}
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a : a + n])]
        names = sorted(found)
        out[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_chars", [16_000_000, 300])
def test_decontamination(spark, texts, block_chars):
    items = [(1, texts[7][50:260]), (2, texts[7][50:140].upper()), (3, "one two"), (4, None), (5, ""), (6, prose(random.Random(77), 30)), (10, "w1 w2"), (11, texts[16][1000:1300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(corpus(spark, texts), bench, block_chars=block_chars).collect()}
    assert got == brute_windows(list(enumerate(texts)), items)
    assert decontaminate.decontaminate(empty(spark), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(corpus(spark, texts), bench.limit(0)).collect())


@pytest.mark.parametrize("block_chars", [16_000_000, 60])
def test_decontamination_by_items_without_id(spark, block_chars):
    passage = prose(random.Random(3), 30, 5000)
    bench = spark.createDataFrame([(None, passage), (None, "q1 q2"), (5, "q1 q2 q3")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.item_ids, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(corpus(spark, [passage, "q1 q2 q3", "clean"]), bench, block_chars=block_chars).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {0: (len(WORD.findall(passage)), 1, [], sha(""), True), 1: (3, 2, ["5"], sha("5"), True), 2: (0, 0, [], sha(""), False)}


def test_licences(spark, texts):
    more = [*texts, "Released under the MIT License. mit license apache license CC BY-NC 4.0", "GNU General Public License", "x cc\nby y", licences.TEMPLATES[1][1] + " end", "Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in licences.scan(corpus(spark, more)).collect()}
    for i, t in enumerate(more):
        w = WORD.findall((t or "").translate(LOWER))
        places = [(k, label) for p, label in licences.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want = (len(w), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(sorted({x for _, x in places})))
        assert (got[i].n_words, got[i].n_base, got[i].first_word, got[i].last_word, got[i].base_labels) == want
        assert 0 <= got[i].score <= 1
    n = len(more)
    assert got[n - 2].labels == "mit" and got[n - 2].score == 1.0 and got[n - 1].labels == "cc-by,cc-by-nc-4.0"
    assert licences.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        licences.Automaton({"one": "x"}, [])


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under CC BY 3.0", "cc-by,cc-by-3.0"),
        ("Licensed under CC BY 7.0", "cc-by"),
        ("Licensed under the Apache License, Version 1.1", "apache"),
        ("Licensed under the Apache License, Version 2.0", "apache,apache-2.0"),
        ("licensed under the GNU General Public License, version 2", "gpl,gpl-2.0"),
        ("licensed under the GNU General Public License, version 3", "gpl,gpl-3.0"),
        ("licensed under the GNU Affero General Public License, version 3", "agpl-3.0"),
        ("Creative Commons Attribution-ShareAlike 4.0 International", "cc-by-sa-4.0"),
        ("Creative Commons Attribution 4.0 International", "cc-by-4.0"),
        (licences.TEMPLATES[1][1].replace("substantial portions", "big parts"), "mit"),
        (" ".join(licences.TEMPLATES[1][1].split()[:30]), ""),
    ],
)
def test_licence_labels(text, labels):
    a = licences.Automaton(licences.PHRASES, licences.TEMPLATES)
    words = licences.split_words(f"some file {text} and more")
    token = np.array([a.code.get(w, -1) for w in words])
    runs, at = [], 0
    for i in range(1, len(words) + 1):  # stretches of known pairs
        if i == len(words) or min(token[i - 1 : i + 1]) < 0 or not a.pair[token[i - 1], token[i]]:
            if i - at > 1:
                runs.append((at, token[at:i].tolist()))
            at = i
    places, spans, score = licences.read_text(a, runs, token, licences.MIN_MATCH, licences.MIN_COVER, licences.MAX_GAP)
    assert ",".join(sorted({a.phrases[k][1] for _, k in places} | {x[0] for x in spans})) == labels and 0 <= score <= 1


def test_matching_statistics():
    r = random.Random(4)
    templates = [("t", " ".join(r.choice("abc") for _ in range(r.randrange(2, 12)))) for _ in range(6)]
    a = licences.Automaton({}, templates)
    whole = [t.split() for _, t in templates]
    for _ in range(50):
        run = [r.choice("abc") for _ in range(20)]
        got = [length for length, _ in a.statistics([a.code[w] for w in run])]
        want = [max(n for n in range(i + 2) if n == 0 or any(run[i + 1 - n : i + 1] == t[k : k + n] for t in whole for k in range(len(t) - n + 1))) for i in range(20)]
        assert got == want


def test_nearest(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 6))
    x[50:150] = x[50]
    x[150:250] *= 0.01
    rows = [(i, [float(v) for v in v], "clash") for i, v in enumerate(x)] + [(1000, None, ""), (1001, [0.0] * 6, ""), (1002, [1.0, None, 0.0, 0.0, 0.0, 0.0], ""), (1003, [float("nan")] * 6, ""), (1004, [1.0], "")]
    got = {}
    for row in curveknn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, key string"), "vec_id % 5 = 0", window=7, query_chunk=16).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert set(got) == set(range(0, 400, 5))
    for q, found in got.items():
        d = np.zeros(400)
        for k in range(6):
            d += (x[:, k] - x[q, k]) ** 2
        d = np.sqrt(d)
        order = [int(i) for i in np.lexsort((np.arange(400), d)) if i != q][:10]
        assert sorted(found) == [(k + 1, i, float(d[i])) for k, i in enumerate(order)]


def test_nearest_of_small_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert curveknn.nearest(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    assert [(r["rank"], r.vec_id) for r in curveknn.nearest(rows).orderBy("rank").collect()] == [(1, 2), (2, 1)]


def test_nearest_of_ids_beyond_doubles_and_repeated_ids(spark):
    kind = "vec_id long, embedding array<double>"
    base = 1 << 53
    rows = [(base + i, [1.0, 2.0]) for i in range(600)] + [(base, [1.0, 2.0])] * 3
    got = curveknn.nearest(spark.createDataFrame(rows, kind), f"vec_id = {base + 100}", window=1).orderBy("rank").collect()
    assert [(x["rank"], x.vec_id - base, x.score) for x in got] == [(k + 1, k, 0.0) for k in range(10)]


def test_windows_alone_find_neighbours_where_there_are_groups(spark):
    r = np.random.default_rng(3)
    n, width = 6000, 32
    middles = r.normal(size=(300, 6)) @ r.normal(size=(6, width))
    x = middles[r.integers(0, 300, n)] + 0.05 * r.normal(size=(n, width))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for row in curveknn.nearest(rows, "vec_id % 20 = 0", check=False).collect():
        found.setdefault(row.query_id, set()).add(row.vec_id)
    hits = 0
    for q in range(0, n, 20):
        d = ((x - x[q]) ** 2).sum(axis=1)
        hits += len(found[q] & {int(i) for i in np.argsort(d, kind="stable")[:11] if i != q})
    assert hits >= 0.9 * 10 * n / 20


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_key(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_words_and_hashes():
    r = random.Random(8)
    texts = ["", "a", "Ab cD", "é-ß", *["".join(r.choice("aB1 .é\n") for _ in range(r.randrange(30))) for _ in range(60)]]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    data = np.frombuffer(b"".join(raw), np.uint8)
    hashes, first = tb.words(data, offsets, tb.ALNUM)
    known = {}
    for i, t in enumerate(texts):
        words = WORD.findall(t.translate(LOWER))
        own = hashes[first[i] : first[i + 1]].tolist()
        assert len(own) == len(words)
        for w, h in zip(words, own, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    x = np.array([5, 3, 8, 1, 9, 2], dtype=np.uint64)
    for w in range(1, 7):
        assert tb.sliding_min(x, w).tolist() == [min(x[i : i + w].tolist()) for i in range(7 - w)]


def test_workspace_needs_a_shared_folder(spark):
    from spanloom.llm.workspace import Workspace

    w = Workspace(spark)
    kept = w.keep(spark.range(5))
    assert kept.count() == 5
    w.drop(kept)
    assert F is not None


def test_very_long_texts_are_read_in_parts(spark, texts, monkeypatch):
    raw = "\n".join(t or "" for t in texts).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 0, len(raw)])
    whole = tb.words(data, offsets, tb.ALNUM)
    model = langid.Model({"a": np.arange(langid.BUCKETS) % 7 + 1.0, "b": np.arange(langid.BUCKETS) % 11 + 1.0})
    margins = model.margins(data, np.array([0, len(raw)]))
    lines = linededup.line_table(data, np.array([0, len(raw)]))
    monkeypatch.setattr(tb, "LONG", 700)
    assert all(a.tolist() == b.tolist() for a, b in zip(lines, linededup.line_table_in_parts(data, np.array([0, len(raw)])), strict=True))
    parts = tb.words(data, offsets, tb.ALNUM)
    assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()
    assert np.allclose(model.margins(data, np.array([0, len(raw)])), margins)
    windows = sorted((int(s) + i, int(g)) for _, s, n, g, _, _ in [suffixdedup.anchors(data, np.array([0, len(raw)]))] for s, n, g in zip(s, n, g, strict=True) for i in range(n))
    cut = sorted((int(s) + i, int(g)) for _, s, n, g, _, _ in suffixdedup._in_parts(data, np.array([0, len(raw)]), 100, 32) for s, n, g in zip(s, n, g, strict=True) for i in range(n))
    assert cut == windows


CLASHES = ("doc", "id", "cls", "region", "key", "place", "range", "bucket", "spans", "gone", "label", "n", "first", "host", "path", "salt", "page_id", "i", "d", "copies")


def test_very_long_texts_repeated_rows_and_clashing_columns(spark):
    r = random.Random(37)
    passage = prose(r, 40, 5000)
    long = f"{prose(r, 300_000, 5000)} {passage} GNU General Public License {prose(r, 600_000, 5000)}\nlast line\n{passage}"
    near = long.replace("w1.", "w2.", 20)
    texts = [(0, long), (1, near), (2, prose(r, 50, 5000)), (2, prose(r, 50, 5000)), (3, passage), (3, passage), (None, None), (None, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("clash") for c in CLASHES})
    found = sorted((x.doc_id if x.doc_id is not None else -1, x.component_id if x.component_id is not None else -1) for x in neardup.near_duplicates(docs).collect())
    assert found == [(-1, -1), (-1, -1), (0, 0), (1, 0), (2, 2), (2, 2), (3, 3), (3, 3)]
    lines = {(x.doc_id, x.n_lines, x.n_removed) for x in linededup.dedup_lines(docs).collect()}
    assert (0, 3, 0) in lines and (3, 1, 1) in lines and (None, 0, 0) in lines
    hits = {(x.doc_id, x.n_base, x.base_labels) for x in licences.scan(docs).collect()}
    assert (0, 1, "gpl") in hits and (3, 0, "") in hits
    items = spark.createDataFrame([(None, passage), (1, passage + " x"), (1, "")], "item_id long, text string").withColumns({c: F.lit("clash") for c in CLASHES})
    leaks = {(x.doc_id, x.n_hit, x.n_items, x.contaminated) for x in decontaminate.decontaminate(docs, items).collect()}
    assert (0, 80, 2, True) in leaks and (3, 40, 2, True) in leaks and (None, 0, 0, False) in leaks
    assert leaks == {(x.doc_id, x.n_hit, x.n_items, x.contaminated) for x in decontaminate.decontaminate(docs, items, block_chars=100).collect()}
    small = docs.where("doc_id is null or doc_id <> 1")
    removed = {(x.doc_id, x.n_bytes, x.n_removed) for x in suffixdedup.dedup_suffixes(small).collect()}
    n = len(passage.encode())
    assert (3, n, n) in removed and (0, len(long.encode()), n) in removed and (None, 0, 0) in removed
    model = langid.train(docs.withColumn("lang", F.lit("aa")))
    assert {x.lang_pred for x in langid.identify(docs, model).collect()} == {"aa", "und"}
