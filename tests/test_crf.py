import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import crf, tagging
from spanloom.operators import labelseq as ls
from spanloom.operators import tokens as tk

LABELS = ["O", "B-G", "I-G"]


def some_model(seed, features=6, constrained=True):
    r = np.random.default_rng(seed)
    m = crf.model(LABELS, features, constrained)
    return m.with_vector(r.normal(size=len(m.vector())))


def scored(m, feats, scores, path):
    """The score of a path by its definition; None if it is not allowed."""
    if not m.may_start[path[0]] or not all(m.may[a, b] for a, b in itertools.pairwise(path)):
        return None
    emitted = sum(scores[t][y] + sum(m.weights[f][y] for f in feats[t]) for t, y in enumerate(path))
    return emitted + sum(m.moves[a, b] for a, b in itertools.pairwise(path)) + m.start[path[0]] + m.end[path[-1]]


def all_paths(m, feats, scores):
    found = {p: scored(m, feats, scores, p) for p in itertools.product(range(len(LABELS)), repeat=len(feats))}
    return {p: s for p, s in found.items() if s is not None}


def data(seed, count=7, with_scores=True):
    r = random.Random(seed)
    out = []
    for k in range(count):
        n = r.randrange(1, 6)
        feats = [[r.randrange(6) for _ in range(r.randrange(0, 4))] for _ in range(n)]
        scores = [[r.gauss(0, 1) for _ in LABELS] if with_scores else [] for _ in range(n)]
        path = [0 if r.random() < 0.5 else 1 for _ in range(n)]
        path = [2 if t and y == 1 and path[t - 1] else y for t, y in enumerate(path)]
        out.append((k, list(range(n)), feats, scores, path))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, f"k int, positions array<int>, {crf.SEQUENCE}").repartition(3)


@pytest.mark.parametrize("constrained", [True, False])
def test_likelihood_and_best_path_equal_enumeration(spark, constrained):
    m, rows = some_model(1, constrained=constrained), data(2)
    likely = {r.k: r.log_likelihood for r in crf.likelihoods(frame(spark, rows), "k", m).collect()}
    best = {r.k: r.labels for r in crf.predict(frame(spark, rows), "k", m).collect()}
    for k, _, feats, scores, gold in rows:
        paths = all_paths(m, feats, scores)
        z = np.logaddexp.reduce(list(paths.values()))
        assert likely[k] == pytest.approx(paths[tuple(gold)] - z, abs=1e-9)
        assert best[k] == [LABELS[y] for y in max(paths, key=paths.get)]


def test_gradient_equals_enumeration(spark):
    m, rows = some_model(3), data(4)
    loss, g, tokens = crf.loss_and_gradient(frame(spark, rows), m)
    assert tokens == sum(len(r[1]) for r in rows)

    def brute(v):
        now, total = m.with_vector(v), 0.0
        for _, _, feats, scores, gold in rows:
            paths = all_paths(now, feats, scores)
            total += np.logaddexp.reduce(list(paths.values())) - paths[tuple(gold)]
        return total

    v = m.vector()
    assert loss == pytest.approx(brute(v), abs=1e-8)
    for i in range(len(v)):
        step = np.zeros(len(v))
        step[i] = 1e-5
        assert g[i] == pytest.approx((brute(v + step) - brute(v - step)) / 2e-5, abs=1e-5)


def test_a_sequence_alone_and_many_together_are_the_same(spark, monkeypatch):
    m, rows = some_model(5), data(6, 40)
    many = crf.loss_and_gradient(frame(spark, rows), m)
    parts = [crf.loss_and_gradient(frame(spark, rows[i::4]), m) for i in range(4)]
    assert many[0] == pytest.approx(sum(p[0] for p in parts)) and np.allclose(many[1], sum(p[1] for p in parts))
    assert crf.loss_and_gradient(frame(spark, []), m)[0] == 0.0


def test_long_sequences_do_not_lose_precision(spark):
    m = crf.model(["O", "B-G"], 0, constrained=False, moves=[[300.0, -300.0], [-300.0, 300.0]])
    rows = [(1, list(range(30_000)), [[]] * 30_000, [[1.0, 0.0]] * 30_000, [0] * 30_000)]
    assert crf.likelihoods(frame(spark, rows), "k", m).first().log_likelihood == pytest.approx(0.0, abs=1e-6)


def test_transitions_are_learnt(spark):
    """Words tell nothing; only the moves do: after B-G comes I-G twice, then O."""
    r = random.Random(1)
    rows = [(k, i, f"w{r.randrange(5)}", y) for k in range(60) for i, y in enumerate(["O", "B-G", "I-G", "I-G"] * 4)]
    tokens = spark.createDataFrame(rows, "k int, p int, w string, y string").withColumn("f", F.array("w"))
    seqs = crf.sequences(tokens, "k", "p", LABELS, "y", "f", size=64).persist()
    m = crf.fit(seqs, crf.model(LABELS, 64), penalty=1e-5)
    assert m.moves[0].argmax() == 1 and m.moves[1].argmax() == 2 and m.start.argmax() == 0
    bare = crf.model(LABELS, 64)
    likely = lambda x: crf.likelihoods(seqs, "k", x).agg(F.avg("log_likelihood")).first()[0]
    assert likely(m) > likely(bare) + 5
    assert np.allclose(crf.fit(seqs, bare, rounds=0).vector(), 0)


def test_a_field_beats_words_alone_on_held_out_documents(spark):
    r = random.Random(2)
    rows = []
    for k in range(150):
        i = 0
        while i < 30:
            if r.random() < 0.3:
                run = [f"a{r.randrange(8)}"] + [f"x{r.randrange(8)}" for _ in range(r.randrange(1, 3))]
                ys = ["B-G"] + ["I-G"] * (len(run) - 1)
            else:
                run, ys = [f"{r.choice('bx')}{r.randrange(8)}"], ["O"]  # x words are inside only after an a word
            for w, y in zip(run, ys, strict=True):
                rows.append((k, i, w, y))
                i += 1
    tokens = spark.createDataFrame(rows, "k int, p int, w string, y string").withColumn("f", F.array("w"))
    train, test = (crf.sequences(tokens.where(c), "k", "p", LABELS, "y", "f", size=512).persist() for c in ("k < 100", "k >= 100"))
    gold = tokens.where("k >= 100")

    def share(m):
        found = crf.as_tokens(crf.predict(test, "k", m), "k", "p", "label").join(gold, ["k", "p"])
        return found.where("label = y").count() / found.count()

    whole = crf.fit(train, crf.model(LABELS, 512), rounds=25)
    words = crf.Model(whole.labels, crf.fit(train, crf.model(LABELS, 512, constrained=False), rounds=25).weights, np.zeros((3, 3)), np.zeros(3), np.zeros(3), np.ones((3, 3), bool), np.ones(3, bool))
    assert share(whole) > 0.8 and share(whole) > share(words) + 0.02


def test_nulls_and_unknown_labels(spark):
    tokens = spark.createDataFrame([(None, 0, None, "O"), (1, 1, ["a"], "odd"), (1, 0, None, None), (2, 0, ["b", "c"], "B-G")], "k int, p int, f array<string>, y string")
    rows = {r.k: r for r in crf.sequences(tokens, "k", "p", LABELS, "y", "f", size=16).collect()}
    assert set(rows) == {1, 2} and rows[1].gold == [0, 0] and rows[1].positions == [0, 1] and rows[2].gold == [1]
    m = crf.fit(crf.sequences(tokens, "k", "p", LABELS, "y", "f", size=16), crf.model(LABELS, 16), rounds=3)
    assert np.isfinite(m.vector()).all()


def test_packed_lists_are_what_rows_are(spark):
    names = ["O", "B-X", "I-X", "B-Y", "I-Y"]
    label = lambda w: F.when(w.startswith("x"), "X").when(F.lower(w) == "yé", "Y")
    docs = spark.createDataFrame([(1, "x1 x2 Ab, yÉ yé x1"), (2, ""), (3, None), (None, "x1"), (4, "x"), (5, "Q x3 1½ İx ΑΣ 𝒳")], "k long, text string")
    lists = tk.token_lists(docs, "k")
    packed = crf.packed_sequences(lists, "k", "tokens", tagging.word_features, 1 << 12, label, names)
    # Nothing along a document is sorted, and no token is a row.
    assert not re.search(r"\b(Window|Sort|Generate)\b", packed._jdf.queryExecution().optimizedPlan().toString())
    rows = tk.tokens(docs, "k").withColumn("label", F.coalesce(label(F.col("word")), F.lit("O")))
    plain = crf.sequences(tagging.with_features(ls.iob2(rows, "label", "k"), "k"), "k", "pos", names, "iob2", "features_named", size=1 << 12)
    want = {r.k: r for r in plain.collect()}
    got = {r.k: r for r in packed.collect()}
    assert set(got) == {1, 2, 4, 5} and got[2].gold == []
    for k, r in want.items():
        assert np.frombuffer(got[k].features, "<u2").reshape(-1, got[k].width).tolist() == r.features and got[k].gold == r.gold
    r = np.random.default_rng(3)
    m = crf.model(names, 1 << 12)
    m = m.with_vector(r.normal(size=len(m.vector())))
    one, two = crf.loss_and_gradient(plain, m), crf.loss_and_gradient(packed, m)
    assert one[0] == pytest.approx(two[0]) and np.allclose(one[1], two[1]) and one[2] == two[2]
    assert sorted(crf.as_tokens(crf.predict(plain, "k", m), "k").collect()) == sorted(crf.as_tokens(crf.predict(packed, "k", m), "k").collect())


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_scaled_masses_are_logarithms_sums(spread):
    m = some_model(9)
    r = np.random.default_rng(1)
    own = np.array([40, 40, 7, 1])
    e = r.normal(size=(4, 40, len(m.labels))) * spread
    want, got = crf._logged(m, e, own), crf._scaled(m, e.transpose(1, 0, 2), own)
    assert all(np.allclose(a, b) for a, b in zip(want, got, strict=True))
    # Where a mass would be lost, nothing is said.
    e[0, :2] = [[2000, 0, 0], [0, 0, 2000]]
    assert crf._scaled(m, e.transpose(1, 0, 2), own) is None


def test_features_are_worked_out_once_for_all_documents(spark):
    label = lambda w: F.when(w.isin("b", "c"), "X").otherwise("O")
    names = ["O", "B-X", "I-X"]
    docs = spark.createDataFrame([(1, "a b c a"), (2, "c"), (3, ""), (4, None), (None, "a"), (5, "b d e f a")], "k int, text string")
    words = F.when(F.length("text") > 0, F.split("text", " ")).when(F.col("text").isNotNull(), F.array().cast("array<string>"))
    want = crf.packed_sequences(docs.select("k", words.alias("tokens")), "k", "tokens", tagging.word_features, 1 << 12, label, names, word=None).collect()
    assert sorted((r.k, len(r.gold), len(r.features)) for r in want) == [(1, 4, 64), (2, 1, 16), (3, 0, 0), (5, 5, 80)]
    for most in (1, 3, 100):
        held, table = crf.with_features(docs, words, tagging.word_features, 1 << 12, label, names, "k", most)
        got = crf.packed_sequences(held.select("k", words.alias("tokens"), "_further"), "k", "tokens", tagging.word_features, 1 << 12, label, names, word=None, table=table)
        assert table.num_rows == min(most, 6)
        # Neither features nor labels are made along documents, and only a table that lacks words needs a join.
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "xxhash64" not in plan and ("Join" in plan) == (most < 100)
        assert sorted(got.collect()) == sorted(want)
