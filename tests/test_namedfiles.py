import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.sources import namedfiles


def test_files_have_their_names(spark, tmp_path):
    rows = spark.createDataFrame([("train/a b.xml", "<a>é</a>"), ("eval/deep/er/x", "1"), ("top", ""), (None, "x"), ("none", None), ("train/a b.xml", "<a>é</a>")], "name string, content string").repartition(3)
    namedfiles.write(rows, "name", F.col("content"), str(tmp_path))
    found = {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    assert found == {"train/a b.xml": "<a>é</a>", "eval/deep/er/x": "1", "top": ""}
    namedfiles.write(rows.limit(0), "name", "content", str(tmp_path / "no"))
    assert not (tmp_path / "no").exists()


@pytest.mark.parametrize("name", ["/etc/x", "../x", "a/../../x", "", "a/.hidden"])
def test_names_stay_in_their_folder(spark, tmp_path, name):
    with pytest.raises(Exception, match="no name for a file"):
        namedfiles.write(spark.createDataFrame([(name, "x")], "name string, content string"), "name", "content", str(tmp_path / "f"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_split_command_writes_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(20):
        (tmp_path / "in" / f"a{i}.xml").write_text(f"<article>{i}</article>")
    cli.main(["split", str(tmp_path / "in"), str(tmp_path / "out"), "--files"], spark)
    files = {p.name: (p.parent.name, p.read_text()) for p in (tmp_path / "out").rglob("*.xml")}
    assert {n: t for n, (_, t) in files.items()} == {f"a{i}.xml": f"<article>{i}</article>" for i in range(20)}
    assert sorted(s for s, _ in files.values()) == ["eval"] * 2 + ["test"] * 2 + ["train"] * 16


def test_extract_command_takes_records(spark, tmp_path):
    (tmp_path / "big.xml").write_text("<all>" + "".join(f"<article><fig>{'word ' * 20}{i}</fig></article>" for i in range(9)) + "</all>")
    cli.main(["extract", str(tmp_path / "big.xml"), str(tmp_path / "lines"), "-P", ".//fig", "--record", "article"], spark)
    assert spark.read.text(str(tmp_path / "lines")).count() == 9
