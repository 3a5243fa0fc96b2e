"""Tokens as lists: nothing along a document is sorted or shuffled, and lists give what rows give."""

import re

import pytest
from pyspark.sql import functions as F

from spanloom.operators import inference as inf
from spanloom.operators import labelseq as ls
from spanloom.operators import tokens as tk
from spanloom.plans import catalogue

TEXTS = [(1, "Ab, cd  ef"), (2, None), (3, ""), (4, "  "), (5, "x"), (6, "é𝒳 1½ ./. end")]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["entity_islands", "panel_segments", "entity_in_panel", "mask_sentence", "tagged_json", "iob2_encode", "copy_and_tag", "separate_labels", "entity_list_text", "entity_runs", "role_mask", "lm_examples", "lm_mlm", "lm_nolm", "lm_twin_examples", "twin_pos_mask", "pos_alignment", "subword_islands", "entity_prf_strict", "boundary_tp_fp_fn", "char_iob2"])
def test_tokens_are_not_sorted(spark, name):
    found = plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not re.search(r"\b(Window|Sort|Join|Union)\b", found)
    assert found.count("Repartition") == 1
    # Lists that are written out in full inside lambdas cost the square of their length.
    assert len(found) < 12_000


def test_places(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tk.token_lists(docs).collect()}
    assert got[2] is None and got[3] == [] and got[4] == []
    for k in (1, 5, 6):
        text = dict(TEXTS)[k]
        assert [t.pos for t in got[k]] == list(range(len(got[k])))
        assert all(text[t.start : t.end] == t.word != " " for t in got[k])
    assert [t.word for t in got[6]] == ["é𝒳", "1½", ".", "/", ".", "end"]


def test_runs_and_masks_as_rows_have_them(spark):
    words = "a b c d e f g h".split()
    tags = [["I-X", "I-X", "B-X", "I-Y", "O", "O", "B-Y", "B-Y"], ["O", "B-X", "I-X", "O", "I-Y", "I-Y", "O", "B-Z"], ["O"] * 8]
    rows = spark.createDataFrame([(k, i, 2 * i, 2 * i + 1, w, t[i], t[7 - i]) for k, t in enumerate(tags) for i, w in enumerate(words)], "doc_id long, pos int, start long, end long, word string, a string, b string")
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "word", "a", "b"))).alias("tokens"))
    for strict in (False, True):
        one = ls.runs_of(rows, ["a", "b"], strict=strict, word="word")
        two = tk.rows_of(ls.run_lists(lists, ["a", "b"], strict, "word"), "runs", "doc_id").select(one.columns)
        assert sorted(one.collect()) == sorted(two.collect())
    one = inf.group_entities(rows, "doc_id", "pos", "a", word="word").drop("island")
    two = tk.rows_of(inf.group_lists(lists, "a", word="word"), "groups", "doc_id").select(one.columns)
    assert sorted(one.collect()) == sorted(two.collect())


def test_last_places(spark):
    rows = spark.createDataFrame([(1, [0, 4, 9], [1, 4, 8]), (2, [5], []), (3, [], [2]), (4, None, None), (5, [7, 1], [0])], "k int, p array<long>, s array<long>")
    got = {r.k: r.at for r in tk.last_places(rows, F.col("p"), F.col("s"), "at").collect()}
    assert got == {1: [None, 1, 2], 2: [None], 3: [], 4: None, 5: [0, 0]}


def test_characters_are_rows_of_sequences(spark):
    spans = "array<struct<start:long,end:long,label:string>>"
    texts = [(1, "abcdefgh", [(0, 2, "X"), (2, 3, "X"), (3, 4, "Y"), (6, 8, "X")]), (2, "a𝒳c", []), (3, "", []), (4, None, None), (5, "abc", None), (6, "abcdef", [(1, 2, "X"), (4, 5, "X")]), (None, "ab", [(1, 2, "X")])]
    docs = spark.createDataFrame(texts, f"doc_id long, text string, spans {spans}")
    found = ls.char_lists(docs)
    want = {1: "B-X I-X I-X B-Y O O B-X I-X", 2: "O O O", 5: "O O O", 6: "O B-X O O B-X O", None: "O B-X"}
    rows = {}
    for r in found.collect():
        rows.setdefault(r.doc_id, {})[r.i] = r.iob2
    assert {k: " ".join(v[i] for i in range(len(v))) for k, v in rows.items()} == want
    assert found.dtypes == [("doc_id", "bigint"), ("i", "int"), ("iob2", "string")]
    # No character goes to Python or through a function of lists.
    assert "MapInArrow" not in plan(found) and "_chars" not in plan(found)
