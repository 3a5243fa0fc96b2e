import json

import pytest
from pyspark.sql import functions as F

from spanloom.api import Lexicon, TextTagger
from spanloom.functions import vectors as v
from spanloom.operators import collate as co
from spanloom.operators import inference as inf
from spanloom.operators import latent
from spanloom.operators import seq2seq as sq


def loop_windows(n, size, stride):
    out, first = [], 0
    while n:
        start = max(0, first - stride)
        end = min(start + size, n)
        out.append((start, end))
        if end == n:
            break
        first = end
    return out


def test_windows_equal_the_loop(spark):
    rows = spark.range(0, 61).select(F.col("id").alias("doc_id"), F.col("id").alias("n"))
    for size, stride in ((10, 3), (7, 0), (5, 4)):
        got = {}
        for r in inf.windows(rows, "doc_id", "n", size, stride).collect():
            got.setdefault(r.doc_id, []).append((r.chunk, r.first, r.last))
        for n in range(61):
            assert [x[1:] for x in sorted(got.get(n, []))] == loop_windows(n, size, stride)
    with pytest.raises(ValueError):
        inf.windows(rows, "doc_id", "n", 5, 5)


def test_stitch_takes_the_lowest_window(spark):
    places = inf.in_windows(inf.windows(spark.createDataFrame([(0, 11)], "d long, n long"), "d", "n", 10, 3), "d")
    got = {r.pos: r.chunk for r in inf.stitch(places, "d").collect()}
    assert got == {**{i: 0 for i in range(10)}, 10: 1}


def test_panels(spark):
    groups = spark.createDataFrame([(0, "O", 0, 4), (0, "PANEL_START", 5, 6), (0, "O", 7, 20), (0, "PANEL_START", 21, 22), (1, "PANEL_START", 0, 1), (1, "O", 2, 9)], "d long, entity_group string, start long, end long")
    got = sorted((r.d, r.panel, r.start, r.end) for r in inf.panels(groups, "d").collect())
    assert got == [(0, 0, 0, 4), (0, 1, 5, 20), (0, 2, 21, 22), (1, 0, 0, 9)]


def test_entities_in_panels(spark):
    panel = spark.createDataFrame([(0, 0, 10, 20)], "d long, panel int, start long, end long")
    e = spark.createDataFrame([(0, 10, 15), (0, 18, 20), (0, 18, 21), (0, 20, 22), (1, 10, 15)], "d long, start long, end long")
    assert sorted((r.start, r.end) for r in inf.entities_in_panels(e, panel, "d").collect()) == [(10, 15), (18, 20)]


def test_panels_with_entities_in_one_pass(spark):
    panel = spark.createDataFrame([(0, 0, 10, 20), (0, 1, 20, 30), (2, 0, 0, 5)], "d long, panel int, start long, end long")
    e = spark.createDataFrame([(0, 10, 15, "a", "r"), (0, 18, 21, "b", None), (0, 25, 26, "c", None), (0, 2, 4, "d", None), (0, 40, 41, "e", None), (1, 10, 15, "f", None)], "d long, start long, end long, text string, role string").withColumn("type", F.lit("T"))
    want = inf.tagged_json(panel, inf.entities_in_panels(e, panel, "d"), "d")
    got = {r.d: r.tagged for r in inf.panels_json(panel, e, "d").collect()}
    assert got == {r.d: r.tagged for r in want.collect()} and set(got) == {0, 2}
    assert [[x["text"] for x in p["entities"]] for p in json.loads(got[0])] == [["a"], ["c"]] and json.loads(got[2])[0]["entities"] == []
    assert inf.panels_json(panel.limit(0), e, "d").count() == 0


def test_shares_of_draws(spark):
    rows = spark.range(2000).select(F.array(*[F.col("id")] * 5).alias("ids"), F.array(*[F.lit(1)] * 5).alias("m"), F.col("id").alias("k"))
    i = F.col("id")
    drawn = spark.range(500).select(co.draw(i, i, "s").alias("x"), *[co.below(i, i, "s", p).alias(f"p{n}") for n, p in enumerate((0, 0.3, 1))]).collect()
    assert all((r.p0, r.p1, r.p2) == (False, r.x < int(0.3 * 2**32), True) for r in drawn)
    counts = [sum(y != -100 for r in co.mask_targets(rows, "k", "ids", "m", p, -1).collect() for y in r.labels) for p in (0, 0.5, 1)]
    assert counts[0] == 0 and 4500 < counts[1] < 5500 and counts[2] == 10000


def test_masks(spark):
    docs = spark.createDataFrame([(0, "ERK1 and p53 up"), (1, "none here")], "doc_id long, text string")
    spans = spark.createDataFrame([(0, 0, 4), (0, 9, 12)], "doc_id long, start long, end long")
    got = {r.doc_id: r.masked for r in inf.masked_sentences(docs, spans).collect()}
    assert got == {0: "[MASK] and [MASK] up", 1: "none here"}
    assert inf.one_per_mask(inf.masked_sentences(docs, spans)).count() == 2


def test_roles(spark):
    e = spark.createDataFrame([(0, 0, 4, "g"), (0, 5, 6, "g")], "d long, start long, end long, type string")
    roles = spark.createDataFrame([(0, 0, 4, "g", "a", 1), (0, 0, 4, "g", "b", 2), (0, 5, 6, "m", "c", 1)], "d long, start long, end long, type string, role string, n int")
    assert {r.start: r.role for r in inf.attach_roles(e, roles, "d", "n").collect()} == {0: "b", 5: None}


def test_tagger_tags_every_text(spark):
    tagger = TextTagger(spark, Lexicon({"Creb1": "GENEPROD", "ATP": "SMALL_MOLECULE"}, {"Creb1": "intervention"}))
    rows = {r.doc_id: json.loads(r.tagged) for r in tagger(["(A) Creb1 with ATP. (B) more ATP", "plain"]).collect()}
    assert [p["start"] for p in rows[0]] == [0, 20] and [e["text"] for e in rows[0][0]["entities"]] == ["Creb1", "ATP"]
    assert rows[0][0]["entities"][0]["role"] == "intervention" and rows[1][0]["entities"] == []


def test_seq2seq(spark):
    t = spark.createDataFrame([(0, i, w, x) for i, (w, x) in enumerate([("a", "B-G"), ("b", "I-G"), ("c", "O"), ("d", "B-S"), ("e", "B-G")])], "doc_id long, pos int, word string, iob2 string")
    assert sq.copy_and_tag(t, ["G"]).first().tagged == "<G> a b </G> c d <G> e </G> "
    assert sq.copy_and_tag(t, ["G"], close_last=False).first().tagged == "<G> a b </G> c d <G> e "
    turns = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "z")], "conv_id long, turn long, role string, text string")
    assert sq.prompt_completion(sq.next_turns(turns)).first().completion == " a [END]"
    with pytest.raises(ValueError):
        sq.pair_rows(turns, F.col("text"), F.col("text"), "other")


def test_vectors_and_batches(spark):
    row = spark.createDataFrame([(0, [1.0, 3.0, 3.0], [5, 6, 7])], "k long, x array<double>, ids array<int>")
    p = row.select(v.softmax(F.col("x")).alias("p"), v.argmax(F.col("x")).alias("c")).first()
    assert abs(sum(p.p) - 1) < 1e-12 and p.c == 1
    assert row.select(v.pad(F.col("ids"), 5, 0).alias("y")).first().y == [5, 6, 7, 0, 0]
    assert row.select(v.pad(F.col("ids"), 5, 0, left=True).alias("y")).first().y == [0, 0, 5, 6, 7]
    assert row.select(v.shift_right(F.col("ids"), 1).alias("y")).first().y == [1, 5, 6]
    padded = co.pad_batches(row.withColumn("labels", F.col("ids")).withColumn("b", F.lit(1)), "b", "ids", "labels", 4).first()
    assert padded.ids == [5, 6, 7, 0] and padded.labels == [5, 6, 7, -100] and padded.attention_mask == [1, 1, 1, 0]
    masked = co.mask_targets(row.withColumn("m", F.array(F.lit(1), F.lit(0), F.lit(1))), "k", "ids", "m", 1.0, 4).first()
    assert masked.masked_ids == [4, 6, 4] and masked.labels == [5, -100, 7]


def test_latent(spark):
    a = spark.createDataFrame([([0.0, 0.0],), ([1.0, 1.0],)], "e array<double>")
    assert abs(latent.mmd(a, a, "e").first().mmd) < 1e-12
    c = latent.cross_correlation(spark.createDataFrame([([1.0, 0.0], [1.0, 2.0])], "x array<double>, y array<double>"), "x", "y")
    assert {(r.i, r.j): r.c for r in c.collect()} == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): 0.0, (1, 1): 0.0}
    assert latent.twin_loss(c).first().off_diagonal == 4.0
    assert abs(latent.acyclicity([[0, 1], [0, 0]], 2)) < 1e-12
