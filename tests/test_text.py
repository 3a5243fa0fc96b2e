import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.operators import tokens as tk


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], [*values]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def test_cleanup_order(spark):
    assert one(spark, tx.cleanup("t"), t="Abstract\tA–B  c\r\nd") == " A-B c d"


def test_length_is_strict(spark):
    assert one(spark, tx.long_enough("t"), t="x" * 80) is False
    assert one(spark, tx.long_enough("t"), t="x" * 81) is True


def test_natural_order(spark):
    texts = ["Figure 10", "Figure 2", "Figure 1", "figure 1", "x1234567890129", "x1234567890123", "x0001", "x1a", "x", " x", "1x", "", "Fig 2-B", "Fig 2.10", "Fig 2.9", "a" + "9" * 40, "a1" + "0" * 40]
    parts = lambda t: [int(x) if x.isdigit() else x for x in re.split("([0-9]+)", t)]
    rows = spark.createDataFrame([(t,) for t in texts], ["t"])
    assert [r.t for r in rows.orderBy(tx.natural_key("t")).collect()] == sorted(texts, key=parts)


@pytest.mark.parametrize(
    ("title", "caption", "want"),
    [
        ("", "<p>Figure 3. Cells grow. More</p>", "."),
        ("", "<b>Fig 3A Cells grow</b>. More", "A Cells grow."),
        ("Own", "x", "Own"),
        ("", "no end", ""),
        ("", "- (A) Cells &amp; &#945;&#x3b2; of FIG. S1 grow\nMore.", "A) Cells & αβ of FIG."),
        ("", "Cells grow.. More", "Cells grow."),
        ("", "...", "."),
        ("", None, None),
    ],
)
def test_titles(spark, title, caption, want):
    got = spark.createDataFrame([(title, caption)], "t string, c string").select(tx.figure_title("t", "c").alias("x")).first()["x"]
    assert got == want or (want is None and not got)


@pytest.mark.parametrize(
    ("caption", "want"),
    [
        ("(A)cells<br/> x\n", "<sd-panel>(A) cells<br/> x </sd-panel>"),
        ("a<br>b", "<sd-panel>a<br/>b </sd-panel>"),
        ("(A)-b (B)_c", "<sd-panel>(A)-b (B) _c </sd-panel>"),
        ("<sd-panel><sd-panel>a</sd-panel></sd-panel>", "<sd-panel>a </sd-panel>"),
        ("<sd-panel> <p> <sd-panel>a</sd-panel> </p></sd-panel>", "<sd-panel>a </sd-panel>"),
        ("<sd-panel>a", "<sd-panel>a </sd-panel>"),
        ("a<sd-panel/>b", "<sd-panel>ab </sd-panel>"),
        ("<?xml version='1.0'?><sd-panel>a  b</sd-panel>", "<sd-panel>a b </sd-panel>"),
        ('see <link href="u">', '<sd-panel>see <link href="u"/> </sd-panel>'),
        ('see <link href="u">text</link>', '<sd-panel>see <link href="u">t</link> </sd-panel>'),
        ("x" * 20_000, "<sd-panel>" + "x" * 20_000 + " </sd-panel>"),
    ],
)
def test_captions(spark, caption, want):
    assert one(spark, tx.panel_caption("c"), c=caption) == want


def test_cleaning(spark):
    clean = lambda t: one(spark, tx.cleaning_rules("t", " none "), t=t)
    assert clean('a "button" here') == "none" and clean("a button here") == "a button here"
    assert clean("\xa0\t a’s – b\xa0c (x) y &amp;amp; &gt; &nbsp;amp;\u2009\n") == "a's - b c (x)y & >  "
    assert one(spark, tx.cleaning_rules("t", rules=[("a", "b"), ("bb", "c")]), t="ab") == "c"


@pytest.mark.parametrize(
    ("key", "main", "scalar"),
    [
        ("loss", "losses/main_loss", "train"),
        ("eval_loss", "losses/main_loss", "eval"),
        ("eval_supp_data_loss_diag", "losses/eval_supp", "loss_diag"),
        ("eval_supp_data_img_correl", "images/eval_supp_data_correl", None),
        ("test_img_x", "images/test_x", None),
        ("epoch", "other_data/epoch", "epoch"),
        ("_img", "other_data/_img", "_img"),
    ],
)
def test_routes(spark, key, main, scalar):
    a, b = tx.log_route("k")
    assert tuple(spark.createDataFrame([(key,)], ["k"]).select(a, b).first()) == (main, scalar)


def test_prompt_has_no_null(spark):
    assert spark.sql("SELECT 'a' AS a, CAST(NULL AS STRING) AS b").select(tx.prompt("a", "b").alias("x")).first()["x"] == "a"


def test_geneprod_is_anchored(spark):
    rows = spark.createDataFrame([("gene",), ("geneprod",), ("protein",), ("molecule",)], ["t"])
    assert [r.x for r in rows.select(tx.geneprod("t").alias("x")).collect()] == ["geneprod", "geneprod", "geneprod", "molecule"]


def test_inner_text_ignores_document_type(spark):
    assert one(spark, tx.inner_text("x"), x='<!DOCTYPE a SYSTEM "http://no.example/x.dtd"><a>b<c>d</c>e</a>') == "bde"


def test_maps_splits_routes(spark):
    assert spark.sql("SELECT map('b', 2, 'a', 1) AS m").select(tx.map_text("m").alias("x")).first()["x"] == "a=1, b=2"
    assert one(spark, tx.split_name("s"), s="Trainset") == "train"
    assert one(spark, tx.split_name("s"), s="other") is None
    assert one(spark, tx.part("h", "?id=", 1), h="f?id=7") == "7"
    assert one(spark, tx.part("h", "=", 3), h="f?id=7") is None
    assert one(spark, tx.coloured("w", "p", "t"), w="x", p="A", t="A") == "\u001b[32mx\u001b[0m"
    assert one(spark, tx.between_tags("t", "G"), t="<G> a </G> b <G> a </G> <G> c </G>") == ["a", "c"]
    assert one(spark, tx.sentences("t"), t="A b. C d? E") == ["A b.", "C d?", "E"]
    assert one(spark, tx.ascii_fold("t"), t="aé–") == "a??"


def brute_tokens(text, flush=True):
    out, word = [], ""
    for i, c in enumerate(text):
        if c.isalnum():
            word += c
            continue
        if word:
            out.append((i - len(word), i, word))
        word = ""
        if c != " ":
            out.append((i, i + 1, c))
    if word and flush:
        out.append((len(text) - len(word), len(text), word))
    return out


@pytest.mark.parametrize("flush", [True, False])
def test_tokens_equal_a_plain_scan(spark, flush):
    r = random.Random(3)
    texts = ["", " ", "abc", "a  b.", "(A) x-1\té\n"] + ["".join(r.choice("ab1 .é-(\n") for _ in range(r.randint(0, 60))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for t in tk.tokens(rows, drop_trailing_word=not flush).collect():
        got.setdefault(t.doc_id, []).append((t.pos, t.start, t.end, t.word))
    for i, text in enumerate(texts):
        want = [(k, *x) for k, x in enumerate(brute_tokens(text, flush))]
        assert sorted(got.get(i, [])) == want, text
        assert [x[3] for x in want] == rows.where(F.col("doc_id") == i).select(tx.words("text", not flush).alias("w")).first()["w"]
