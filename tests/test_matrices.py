"""Numbering, orders of variables, discrepancies and graphs."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import decoding, latent, ordering, splits


def test_numbers_are_distinct_and_in_order_beside_other_columns(spark):
    n = 3_000_000
    rows = spark.range(n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    found = splits.numbered(rows, "k", name="at")
    assert found.where("k <> at").limit(1).count() == 0
    assert found.agg(F.countDistinct("at")).first()[0] == n


@pytest.mark.parametrize(("text", "want"), [("&#9999999;x", "�x"), ("&#xD800;", "�"), ("&mu;m caf&eacute;", "μm café"), ("a &amp;lt; b", "a &lt; b"), ("&#956;&#x3bc;", "μμ"), ("none & here", "none & here"), ("&nbsp;", "\xa0"), ("&#0;", "�"), (None, None)])
def test_references_never_fail(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(tx.unescaped("t")).first()[0] == want


def brute_linkage(points):
    """Mergers of complete linkage, each time the nearest two clusters."""
    held, out = {i: [i] for i in range(len(points))}, []
    far = lambda x, y: max(np.linalg.norm(points[a] - points[b]) for a in held[x] for b in held[y])
    for k in range(len(points) - 1):
        x, y = min(itertools.combinations(sorted(held), 2), key=lambda p: far(*p))
        out.append((x, y, far(x, y)))
        held[len(points) + k] = held.pop(x) + held.pop(y)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_brute_force(seed):
    r = np.random.default_rng(seed)
    points = r.normal(size=(17, 5)) + 3 * r.integers(0, 3, (17, 1))
    found, want = ordering.linkage(points), brute_linkage(points)
    assert [(int(a), int(b)) for a, b, _ in found] == [(a, b) for a, b, _ in want]
    assert np.allclose(found[:, 2], [d for _, _, d in want])


def test_order_keeps_clusters_together():
    r = np.random.default_rng(0)
    groups = r.permutation(np.repeat(np.arange(4), 6))
    base = r.normal(size=(500, 4))
    c = np.corrcoef((base[:, groups] + 0.1 * r.normal(size=(500, 24))).T)
    order = ordering.correlated_order(c)
    assert sorted(order) == list(range(24)) and sum(a != b for a, b in itertools.pairwise(groups[order])) == 3
    assert ordering.correlated_order(np.eye(1)) == [0] and ordering.correlated_order(np.zeros((0, 0))) == []
    assert ordering.correlated_order(np.ones((3, 3))) == [0, 1, 2]


def test_two_thousand_variables_take_seconds():
    start = time.time()
    assert len(ordering.correlated_order(np.corrcoef(np.random.default_rng(1).normal(size=(2000, 50))))) == 2000
    assert time.time() - start < 30


@pytest.mark.parametrize("block", [2, 3, 128])
def test_correlations_in_blocks(spark, block):
    x = np.random.default_rng(3).normal(size=(40, 5)) * [1, 2, 3, 4, 0] + 1
    rows = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,), ([1.0, None, 1.0, 1.0, 1.0],)], "e array<double>").repartition(3)
    got = np.zeros((5, 5))
    for r in ordering.correlations(rows, "e", block).collect():
        got[r.i, r.j] = r.c
    want = np.eye(5)
    want[:4, :4] = np.corrcoef(x[:, :4].T)
    assert np.allclose(got, want)
    order = [r.component for r in ordering.ordered_components(rows, "e", block).orderBy("place").collect()]
    assert order == ordering.correlated_order(want)
    assert ordering.correlations(rows.where("false"), "e").count() == 0


def side(spark, x):
    return spark.createDataFrame([(i // 10, v.tolist()) for i, v in enumerate(x)] + [(None, None)], "b int, e array<double>").repartition(3)


@pytest.mark.parametrize("shift", [0.0, 1.0, 4.0])
def test_discrepancy_by_waves_is_within_its_bound(spark, shift):
    r = np.random.default_rng(5)
    x, y = r.normal(size=(80, 4)) * 2, r.normal(size=(60, 4)) * 2 + shift
    exact = latent.kernel_mean(x, x) + latent.kernel_mean(y, y) - 2 * latent.kernel_mean(x, y)
    for seed in range(3):
        got = latent.mmd_by_waves(side(spark, x), side(spark, y), "e", count=4096, seed=seed).first()
        assert abs(got.mmd - exact) <= got.bound < 0.1
    assert latent.mmd(side(spark, x), side(spark, y), "e").first()[0] == pytest.approx(exact)
    assert latent.mmd_by_waves(side(spark, x), side(spark, y[:0]), "e").count() == 0


def test_discrepancy_of_batches(spark):
    r = np.random.default_rng(6)
    x, y = r.normal(size=(30, 4)), r.normal(size=(20, 4))
    got = {q.b: q.mmd for q in latent.batch_mmd(side(spark, x), side(spark, y), "b", "e").collect()}
    want = {k: latent.kernel_mean(p, p) + latent.kernel_mean(q, q) - 2 * latent.kernel_mean(p, q) for k in range(2) for p, q in [(x[10 * k : 10 * k + 10], y[10 * k : 10 * k + 10])]}
    assert got == pytest.approx(want)


def test_acyclicity_of_rows(spark):
    cases = [[0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 1.0, 0.0], [2.0, 0.0, 0.0, 0.0], None, [1.0], [None, 0.0, 0.0, 0.0]]
    got = [r.acyclicity for r in latent.acyclicities(spark.createDataFrame(list(enumerate(cases)), "k int, w array<double>").coalesce(1), "w", 2).orderBy("k").collect()]
    # (I + W*W/2)^2: no cycle; the cycle of two, trace 2 + 2 * 1/4; a loop of weight 4/2, trace 9 + 1.
    assert got[:3] == pytest.approx([0.0, 0.5, 8.0]) and got[3:] == [None, None, None]
    assert latent.acyclicity([[0, 1], [0, 0]], 2) == pytest.approx(0.0)


def test_sampled_graphs(spark):
    keys = spark.range(300).repartition(5)
    rows = latent.sampled_graphs(keys, "id", 6, 4.0, 5.0, features=3, sigma=1.0, seed=1).collect()
    again = {r.id: r for r in latent.sampled_graphs(keys.repartition(2), "id", 6, 4.0, 5.0, features=3, sigma=1.0, seed=1).collect()}
    counts, loops = [], 0
    for r in rows:
        assert r == again[r.id] and len(set(r.subset)) == len(r.subset) <= 6
        edges, labels = np.array(r.edges).reshape(6, 6), np.array(r.labels).reshape(6, 3)
        outside = [i for i in range(6) if i not in r.subset]
        assert not edges[outside].any() and not edges[:, outside].any() and not labels[outside].any()
        counts.append((len(r.subset), int(edges.sum())))
        loops += int(np.trace(edges))
    assert abs(np.mean([a for a, _ in counts]) - 4) < 0.3 and abs(np.mean([b for _, b in counts]) - 5) < 0.3 and loops > 50
    exact = latent.sampled_graphs(keys, "id", 6, 4.0, 50.0).collect()
    assert {(len(r.subset), sum(r.edges)) for r in exact} == {(4, 16.0)}
    assert latent.sampled_graphs(keys.where("id < 0"), "id", 6, 4.0, 5.0).count() == 0


def test_decoding_over_many_batches(spark):
    rows = spark.range(0, 3000).select((F.col("id") / 1000).cast("int").alias("k"), F.col("id").alias("p"), F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)).alias("s"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 70)
    try:
        got = decoding.decode(rows.repartition(2), "k", "p", "s", ["O", "B-G", "I-G"]).groupBy("k", "label").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.k, r.label): r["count"] for r in got} == {(k, x): n for k in range(3) for x, n in (("B-G", 1), ("I-G", 999))}
