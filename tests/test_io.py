import io
import json

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.functions.text import DELIMITER
from spanloom.operators import lmprep, tagging
from spanloom.sources import readers, rest, writers
from spanloom.streaming import stream


def test_xml_corpus_and_split(spark, tmp_path):
    corpus = tmp_path / "in"
    corpus.mkdir()
    for i in range(25):
        (corpus / f"a{i}.xml").write_text(f"<article><fig>{'word ' * 30}{i}</fig></article>")
    (corpus / "no.txt").write_text("x")
    assert readers.xml_corpus(spark, str(corpus)).count() == 25
    cli.main(["split", str(corpus), str(tmp_path / "out")], spark)
    files = readers.split_files(spark, str(tmp_path / "out"))
    assert {r.split: r["count"] for r in files.groupBy("split").count().collect()} == {"train": 21, "eval": 2, "test": 2}
    assert {(r.name, r.xml) for r in files.collect()} == {(f.name, f.read_text()) for f in corpus.glob("*.xml")}
    cli.main(["extract", str(corpus), str(tmp_path / "lines"), "-P", ".//fig"], spark)
    assert readers.lines(spark, str(tmp_path / "lines")).count() == 25


def test_prepare_and_prompts(spark, tmp_path):
    (tmp_path / "l.txt").write_text("<p>a <sd-tag entity_type='gene'>b</sd-tag></p>\n\n")
    cli.main(["prepare", str(tmp_path / "l.txt"), str(tmp_path / "words")], spark)
    row = readers.json_lines(spark, str(tmp_path / "words"), "words").first()
    assert row.words == ["a", "b"] and row.label_ids["entity_types"] == ["O", "B-GENEPROD"]
    (tmp_path / "s.csv").write_text('subset,input_text,output_text\ntrainset,"a ""q"", b",c\nodd,x,y\ntest,,z\n')
    cli.main(["prompts", str(tmp_path / "s.csv"), str(tmp_path / "p")], spark)
    got = spark.read.json(str(tmp_path / "p")).collect()
    assert [(r.split, r.prompt, r.completion) for r in got] == [("train", 'a "q", b\n\n###\n\n', " c [END]")]


def test_rest_rows(spark):
    article = json.dumps({"doi": "10.1/x", "title": "T", "nbFigures": "2"})
    rows = readers.rest_articles(spark.createDataFrame([(article,), ("{}",), ("not json",)], ["body"]))
    assert sorted((r.doi, r.nb_figures) for r in rows.collect()) == [("", 0), ("", 0), ("10.1/x", 2)]
    assert sorted(r.idx for r in readers.figure_indices(rows).collect()) == [1, 2]
    panel = {"current_panel_id": "2", "paper": {"doi": "10.1/x"}, "figure": {"label": "F", "figure_id": "9", "panels": [{"panel_id": "1"}, {"panel_id": "2", "label": "B", "formatted_caption": "c", "coords": {"y": 2, "x": 1}, "tags": [{"id": "7", "type": "gene", "in_caption": "Y", "external_ids": ["a", "b"]}, {"id": "8", "in_caption": "N"}]}]}}
    panels = readers.rest_panels(spark.createDataFrame([(json.dumps(panel),), ("{}",)], ["body"]))
    assert [(r.panel_id, r.panel_label, r.coords) for r in panels.collect()] == [("2", "B", "x=1, y=2")]
    assert sorted((r.tag_id, r.ext_ids, r.in_caption) for r in readers.rest_tags(panels).collect()) == [("7", "a///b", True), ("8", "", False)]


def test_enrichment(spark):
    a = spark.createDataFrame([("x",), ("y",)], ["doi"])
    got = readers.with_abstracts(a, spark.createDataFrame([("x", "text")], ["doi", "abstract"]))
    assert {r.doi: r.abstract for r in got.collect()} == {"x": "text", "y": ""}
    body = json.dumps({"accession": "P1", "protein": {"recommendedName": {"fullName": {"value": "Full"}, "shortName": [{"value": "A"}]}, "alternativeName": [{"shortName": [{"value": "B"}, {"value": "A"}]}]}})
    row = readers.protein_names(spark.createDataFrame([(body,)], ["body"])).first()
    assert (row.recommended_name, row.short_names) == ("Full", ["A", "B"])


class Answer(io.BytesIO):
    status = 200


def test_fetch_retries_and_never_raises():
    calls, waits = [], []

    def opener(url, timeout):
        calls.append(url)
        if len(calls) < 3:
            raise rest.urllib.error.HTTPError(url, 502, "bad", None, None)
        return Answer(b'{"a": 1}')

    assert rest.fetch("http://x", {"q": "1"}, opener, waits.append) == '{"a": 1}'
    assert calls[0] == "http://x?q=1" and waits == [0.3, 0.6]
    assert rest.fetch("http://x", opener=lambda u, timeout: Answer(b'"text"'), wait=waits.append) == "{}"

    def gone(url, timeout):
        raise OSError

    assert rest.fetch("http://x", opener=gone) == "{}"


def test_rest_source_and_frame(spark):
    spark.dataSource.register(rest.RestSource)
    assert spark.read.format("rest").option("urls", "").load().count() == 0
    rows = rest.fetch_all(spark.createDataFrame([("u1",), ("u2",)], ["url"]), get=lambda u: json.dumps({"u": u}))
    assert sorted(r.body for r in rows.collect()) == ['{"u": "u1"}', '{"u": "u2"}']


def test_repeated_lines_and_lines_without_words_are_prepared(spark, tmp_path):
    (tmp_path / "l.txt").write_text("<p>a <b>c</b></p>\n\t<p>a <b>c</b></p> \n<p/>\n")
    cli.main(["prepare", str(tmp_path / "l.txt"), str(tmp_path / "words")], spark)
    rows = readers.json_lines(spark, str(tmp_path / "words"), "words").collect()
    assert sorted(r.words for r in rows) == [[], ["a", "c"], ["a", "c"]]
    assert all(len(r.label_ids["entity_types"]) == len(r.words) for r in rows)


def test_crawl(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    panel = lambda f, i, label: {"current_panel_id": i, "paper": {"doi": "10.1/x"}, "figure": {"label": "F", "figure_id": f, "panels": [{"panel_id": i, "label": label, "formatted_caption": f"<p>cap {label}</p>"}]}}
    write = lambda name, rows: (folder / f"{name}.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    write("articles", [{"doi": "10.1/x", "body": json.dumps({"doi": "10.1/x", "nbFigures": "2"})}, {"doi": "10.1/y", "body": json.dumps({"doi": "10.1/y"})}])
    write("figures", [{"doi": "10.1/x", "body": json.dumps({"figure_id": i, "label": f"Figure {i}", "caption": f"<b>Cells {i}</b> & more.", "href": f"h?id={i}"})} for i in ("10", "9")])
    write("panels", [{"figure_id": "9", "body": json.dumps(panel("9", "2", "B"))}, {"figure_id": "9", "body": json.dumps(panel("9", "1", "A"))}])
    cli.main(["crawl", str(folder), str(tmp_path / "out")], spark)
    got = {r.article: r.value for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert got["10-1_y"] == '<article doi="10.1/y"></article>'
    x = got["10-1_x"]
    assert x.index("Figure 9") < x.index("Figure 10") and x.index("cap A") < x.index("cap B") and "<title>Cells 9 &amp; more.</title>" in x
    assert writers.well_formed(spark.createDataFrame([("<a/>",), ("<a>",), (None,)], "xml string")).count() == 1


def test_examples_and_training(spark, tmp_path):
    (tmp_path / "tok.json").write_text(json.dumps({"version": "1.0", "pre_tokenizer": {"type": "Whitespace"}, "model": {"type": "WordLevel", "vocab": {"[UNK]": 3, "red": 4, "cell": 5}, "unk_token": "[UNK]"}}))
    (tmp_path / "l.txt").write_text("red cell grows\nred\n")
    cli.main(["examples", str(tmp_path / "l.txt"), str(tmp_path / "ex"), "--tokenizer", str(tmp_path / "tok.json"), "--max-length", "4"], spark)
    got = sorted((r.input_ids, r.label_ids, r.special_tokens_mask) for r in readers.json_lines(spark, str(tmp_path / "ex"), "lm").collect())
    assert got == [([0, 4, 2], ["X", "NOUN", "X"], [1, 0, 1]), ([0, 4, 5, 2], ["X", "NOUN", "NOUN", "X"], [1, 0, 0, 1])]
    rows = spark.createDataFrame([(0, f"red{DELIMITER}cell grows")], "doc_id long, value string")
    twin = lmprep.examples_of_lines(rows, lmprep.file_tokenizer(str(tmp_path / "tok.json")), [8, 8]).first()
    assert twin.input_ids == [[0, 4, 2], [0, 5, 3, 2]]
    words = [{"words": ["the", "Creb1", "rises"] if i % 2 else ["a", "lamp", "stands"], "text": "t", "label_ids": {"entity_types": ["O", "B-GENEPROD", "O"] if i % 2 else ["O", "O", "O"]}} for i in range(40)]
    (tmp_path / "w.json").write_text("\n".join(json.dumps(w) for w in words))
    cli.main(["train", str(tmp_path / "w.json"), str(tmp_path / "model")], spark)
    t = spark.createDataFrame([(0, 0, "the"), (0, 1, "Creb1"), (0, 2, "rises")], "doc_id long, pos int, word string")
    found = tagging.predict(PipelineModel.load(str(tmp_path / "model")), t).orderBy("pos").collect()
    assert [r.predicted for r in found] == ["O", "B-GENEPROD", "O"] and all(0.5 < r.score <= 1 for r in found)


def test_zip_of_unequal_sides_fails(spark):
    a = spark.createDataFrame([(0, 1), (0, 2)], "k long, p int")
    b = spark.createDataFrame([(0, 1, "x")], "k long, p int, role string")
    with pytest.raises(Exception, match="as many rows"):
        lmprep.zip_positions(a, b, "k", "p").collect()


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("10.1/a", "<a/>"), ("10.1/b", "<b/>")], ["doi", "xml"])
    writers.article_files(rows.limit(1), str(tmp_path / "x"))
    writers.article_files(rows.withColumn("xml", F.lit("<new/>")), str(tmp_path / "x"))
    got = sorted(r.value for r in spark.read.text(str(tmp_path / "x")).collect())
    assert len(got) == 2 and got.count("<new/>") == 1
    twin = spark.createDataFrame([(f"a\nb{DELIMITER}c",)], ["t"])
    writers.lines(twin, "t", str(tmp_path / "t"))
    assert readers.twins(readers.lines(spark, str(tmp_path / "t"))).first().asDict() == {"left": "a b", "right": "c"}
    writers.json_lines(rows, str(tmp_path / "j"), shuffle_by="doi")
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    rows.write.parquet(str(tmp_path / "old"))
    writers.upsert_table(spark, str(tmp_path / "old"), spark.createDataFrame([("10.1/a", "n"), ("10.1/c", "n")], ["doi", "xml"]), "doi", str(tmp_path / "new"))
    assert {r.doi: r.xml for r in spark.read.parquet(str(tmp_path / "new")).collect()} == {"10.1/a": "n", "10.1/b": "<b/>", "10.1/c": "n"}


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("x" * 90 + "\nshort\n" + "Abstract" + "y" * 90 + "\n")
    q = stream.each_batch(stream.text_stream(spark, str(tmp_path / "in")), lambda b: stream.cleaned(b), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert sorted(r.value[:1] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]
