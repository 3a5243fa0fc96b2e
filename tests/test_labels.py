import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import labels as lb
from spanloom.operators import labelseq as ls
from spanloom.operators import metrics as m
from spanloom.operators import splits as sp


def tagged(spark, tags, name="tag"):
    return spark.createDataFrame([(0, i, t) for i, t in enumerate(tags)], f"doc_id long, pos int, {name} string")


def test_vocabularies():
    assert lb.PANELIZATION.iob2 == ["O", "B-PANEL_START"]
    assert lb.GENEPROD_ROLES.iob2 == ["O", "B-CONTROLLED_VAR", "I-CONTROLLED_VAR", "B-MEASURED_VAR", "I-MEASURED_VAR"]
    assert lb.ENTITY_TYPES.iob2.index("I-EXP_ASSAY") == lb.iob2_index(7, True) == 14
    with pytest.raises(ValueError):
        lb.CodeMap("x", (), "other")


def test_first_fitting_constraint_wins(spark):
    rows = spark.createDataFrame([("sd-tag", "gene", "assay"), ("sd-tag", None, "assay"), ("fig", "gene", None), ("sd-tag", None, None)], "tag string, entity_type string, category string")
    assert [r.x for r in rows.select(lb.ENTITY_TYPES.code(F.col("tag"), F.col).alias("x")).collect()] == [2, 7, None, None]


def test_iob2(spark):
    rows = tagged(spark, ["O", "G", "G", "S", "G", "O", "G"], "label")
    assert [r.iob2 for r in ls.iob2(rows, "label").orderBy("pos").collect()] == ["O", "B-G", "I-G", "B-S", "B-G", "O", "B-G"]


TRUTH, GUESS = ["B-G", "I-G", "O", "B-C", "O", "B-G"], ["I-G", "I-G", "O", "B-C", "I-C", "B-G"]


@pytest.mark.parametrize(("strict", "tp", "precision", "recall"), [(False, 2, 2 / 3, 2 / 3), (True, 1, 1 / 2, 1 / 3)])
def test_span_scores(spark, strict, tp, precision, recall):
    a, b = (ls.runs(tagged(spark, x), "tag", strict=strict) for x in (TRUTH, GUESS))
    got = m.prf(m.match(a, b, "doc_id", "label", "first", "last")).first()
    assert (got.tp, round(got.precision, 6), round(got.recall, 6)) == (tp, round(precision, 6), round(recall, 6))


def loop_runs(tags, strict):
    """Runs as one would go along the tags."""
    out, run = [], None
    for i, tag in enumerate([*tags, "O"]):
        if run and not (tag is not None and tag[0] == "I" and tag[2:] == run[1]):
            out.append((run[1], run[2], i - 1, run[0]))
            run = None
        if tag not in (None, "O"):
            run = run or (tag[0], tag[2:], i)
    return {x[:3] for x in out if x[3] == "B" or not strict}


@pytest.mark.parametrize("strict", [False, True])
def test_runs_of_several_tags(spark, strict):
    kinds, draw = ["O", "B-G", "I-G", "B-C", "I-C", None], random.Random(5)
    docs = {d: [[draw.choice(kinds) for _ in range(40)] for _ in range(2)] for d in range(20)} | {20: [[None], ["O"]]}
    rows = spark.createDataFrame([(d, i, x, y, f"w{i}") for d, (a, b) in docs.items() for i, (x, y) in enumerate(zip(a, b, strict=True))], "doc_id long, pos int, a string, b string, word string")
    got = ls.runs_of(rows, ["a", "b"], strict=strict, word="word").collect()
    for d, tags in docs.items():
        for n in (0, 1):
            assert {(r.label, r.first, r["last"]) for r in got if (r.doc_id, r.nth) == (d, n)} == loop_runs(tags[n], strict)
    assert all(r.text == " ".join(f"w{i}" for i in range(r.first, r["last"] + 1)) for r in got)
    matched = m.match_tags(rows, "a", "b", strict=strict).collect()
    assert all((r.in_truth, r.in_predicted) == tuple((r.label, r.first, r["last"]) in loop_runs(docs[r.doc_id][n], strict) for n in (0, 1)) for r in matched)


def test_memorisation_by_text(spark):
    spans = [(0, "G", "a", True, False), (1, "G", "a", True, True), (1, "G", "b", False, True), (2, "G", "b", False, True), (3, "G", "c", True, True), (1, "G", "c", True, False), (4, "G", "a", True, True)]
    matched = spark.createDataFrame(spans, "doc_id long, label string, text string, in_truth boolean, in_predicted boolean")
    split = spark.createDataFrame([(0, "train"), (1, "test"), (2, "train"), (3, "eval")], "doc_id long, split string")
    got = {(r.in_training, r.label): (r.tp, r.fp, r.fn) for r in m.memorisation(matched, split).collect()}
    assert got == {(True, "G"): (1, 0, 0), (False, "G"): (0, 1, 1)}


def test_report_without_spans_or_support(spark):
    none = spark.createDataFrame([], "label string, in_truth boolean, in_predicted boolean")
    assert m.class_report(none).count() == 0
    guesses = spark.createDataFrame([("G", False, True)], none.schema)
    report = {r.label: r for r in m.class_report(guesses).collect()}
    assert report["G"].precision == 0.0 and report["macro avg"].f1 == 0.0 and report["weighted avg"].f1 is None


def test_report_and_accuracy(spark):
    a, b = (ls.runs(tagged(spark, x), "tag") for x in (TRUTH, GUESS))
    report = {r.label: r for r in m.class_report(m.match(a, b, "doc_id", "label", "first", "last")).collect()}
    assert report["G"].f1 == 1.0 and report["C"].f1 == 0.0 and report["macro avg"].f1 == 0.5
    assert report["micro avg"].support == 3 and round(report["weighted avg"].recall, 6) == round(2 / 3, 6)
    both = tagged(spark, TRUTH).join(tagged(spark, GUESS, "guess"), ["doc_id", "pos"])
    assert round(m.token_accuracy(both, "tag", "guess").first().accuracy, 6) == round(4 / 6, 6)


def test_ignored_positions(spark):
    rows = spark.createDataFrame([(1, 1), (-100, 3), (2, 1)], "y int, p int")
    assert m.masked_recall(rows, "y", "p").first().recall == 0.5
    assert {r.y: r.n for r in ls.histogram(rows, "y").collect()} == {1: 1, 2: 1}


def test_class_weights(spark):
    rows = spark.createDataFrame([("O", 60), ("A", 30), ("B", 10)], "label string, n long")
    assert {r.label: round(r.weight, 6) for r in ls.class_weights(rows).collect()} == {"O": 0.2, "A": 0.34, "B": 0.9}


def test_runs_end_with_their_document(spark):
    rows = spark.createDataFrame([(0, 0, "B-G", "x"), (1, 0, "I-G", "y")], "doc_id long, pos int, tag string, word string")
    assert sorted((r.doc_id, r.text) for r in ls.entity_texts(rows, "tag").collect()) == [(0, "x"), (1, "y")]


def test_subset_shift_mask(spark):
    row = spark.createDataFrame([([-100, 0, 1, 2, 3, 4],)], "x array<int>")
    assert row.select(lb.subset("x", {3: 1, 4: 2}).alias("y")).first().y == [-100, 0, 0, 0, 1, 2]
    assert row.select(lb.nonzero_mask("x").alias("y")).first().y == [0, 0, 1, 1, 1, 1]
    assert row.select(F.transform("x", lb.shifted).alias("y")).first().y == [-100, 0, 2, 2, 4, 4]
    assert row.select(lb.mask("x", [2, 4]).alias("y")).first().y == [0, 0, 0, 1, 0, 1]


def test_alignment(spark):
    words = spark.createDataFrame([(0, 0, 3), (0, 1, 0)], "doc_id long, word_id int, label int")
    subs = spark.createDataFrame([(0, None, 0), (0, 0, 1), (0, 0, 2), (0, 1, 3), (0, None, 4)], "doc_id long, word_id int, sub_pos int")
    assert [r.label for r in ls.align_subtokens(subs, words).orderBy("sub_pos").collect()] == [-100, 3, 4, 0, -100]


def test_split_sizes(spark):
    counts = lambda n, cap: {r.split: r["count"] for r in sp.document_split(spark.range(n).withColumnRenamed("id", "doc_id"), cap=cap).groupBy("split").count().collect()}
    assert counts(25, 9999) == {"eval": 2, "test": 2, "train": 21}
    assert counts(200, 5) == {"eval": 5, "test": 5, "train": 190}


def test_only_in(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",)], ["e"])
    assert [r.e for r in sp.only_in(a, spark.createDataFrame([("x",)], ["e"]), "e").collect()] == ["y"]
