import pytest
from pyspark.sql import functions as F

from spanloom.operators import grid, metrics, splits, tokens
from spanloom.plans.parametric import Query


def test_queries_with_parameters(spark):
    q = Query("SELECT :low + id AS x, ':no' AS y FROM range(3) WHERE id >= :least", ("x",), lambda df: df.orderBy("x"))
    assert q.parameters == {"low", "least"}
    assert [r.x for r in q.run(spark, low=10, least=1).collect()] == [11, 12]
    with pytest.raises(ValueError):
        q.run(spark, low=1)
    with pytest.raises(ValueError):
        Query("SELECT 1 AS a", ("b",)).run(spark)


def test_grid(spark):
    trials = grid.grid(spark, {"learning_rate": [1e-4, 5e-5], "epochs": [2, 3]})
    assert trials.count() == 4
    row = grid.best(grid.search(trials, lambda t: t["epochs"] - t["learning_rate"])).first()
    assert (row.learning_rate, row.epochs) == (5e-5, 3.0)
    assert grid.for_task("GENEPROD_ROLES").masking_probability == 1.0


def test_as_of(spark):
    points = spark.createDataFrame([(0, 1), (0, 5), (0, 9), (1, 5)], "d long, p int")
    intervals = spark.createDataFrame([(0, 5, "a"), (0, 7, "b")], "d long, start int, name string")
    got = {(r.d, r.p): r.found and r.found["name"] for r in tokens.as_of(points, intervals, "d", "p").collect()}
    assert got == {(0, 1): None, (0, 5): "a", (0, 9): "b", (1, 5): None}


def test_report_of_lengths_and_dedupe(spark):
    rows = spark.createDataFrame([(0, "s", "a"), (1, "s", "a"), (2, "s", "bb")], "doc_id long, source string, text string")
    assert [r.doc_id for r in tokens.exact_dedupe(rows, "source", "doc_id", "text").orderBy("doc_id").collect()] == [0, 2]
    row = tokens.length_report(rows.withColumn("n", F.length("text")), "n", "doc_id").first()
    assert (row.min_length, row.max_length, row.shortest, row.longest) == (1, 2, 0, 2)


def test_as_of_of_tokens_that_share_an_exchange(spark):
    docs = spark.createDataFrame([(i, " ".join("ab"[(i * k) % 2] * 3 for k in range(40))) for i in range(60)], "doc_id long, text string")
    t = tokens.tokens(docs)
    spans = t.select("doc_id", "start", "end", "word")
    found = tokens.as_of(t, spans, "doc_id", "start")
    halves = [found.where(f"pos % 2 = {k}").groupBy("doc_id").agg(F.count_if(F.col("found.word") == F.col("word")).alias(f"n{k}")) for k in (0, 1)]
    assert {tuple(r) for r in halves[0].join(halves[1], "doc_id").select("n0", "n1").collect()} == {(20, 20)}


def test_evaluation_calls_its_hooks(spark):
    tags = [("B-G", "B-G"), ("I-G", "I-G"), ("O", "B-S"), ("B-S", "O"), ("I-S", "O"), ("B-G", "I-G")]
    t = spark.createDataFrame([(d, i, *x) for d in (0, 1) for i, x in enumerate(tags)], "doc_id long, pos int, truth string, guess string")
    seen = []
    report = metrics.evaluate(t, "truth", "guess", [lambda name, r: seen.append((name, r.count()))])
    assert seen == [("eval", 5)]
    rows = {r.label: r for r in report.collect()}
    assert (rows["G"].precision, rows["G"].recall, rows["G"].support) == (1.0, 1.0, 4) and rows["S"].f1 == 0.0
    strict = metrics.prf(metrics.match_tags(t, "truth", "guess", strict=True)).first()
    assert (strict.tp, strict.fp, strict.fn) == (2, 2, 4)


def test_numbers_and_differences(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "a long, b long").repartition(6)
    assert {(r.a, r.n) for r in splits.numbered(rows, "a", name="n").collect()} == {(i, i) for i in range(50)}
    one, two = (spark.createDataFrame([(x,) for x in xs], "x string") for xs in ("aabc", "bcd"))
    assert sorted(r.x for r in splits.in_one_alone(one, two).collect()) == ["a", "d"]
