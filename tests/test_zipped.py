import zipfile

from spanloom.sources import readers
from spanloom.streaming import stream


def test_members_of_archives(spark, tmp_path):
    long = "".join(f"line {k} é\n" for k in range(5000)) + "the end"
    for name, members in {"a": {"train/x.jsonl": long, "train/": "", "readme.md": "no", "empty.jsonl": "", "one.jsonl": "\n"}, "b": {"y.jsonl": "z"}}.items():
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for member, text in members.items():
                z.writestr(member, text)
    rows = readers.zipped(spark, str(tmp_path), "*.jsonl", 1000).collect()
    texts = {}
    for r in sorted(rows, key=lambda r: (r.archive, r.name, r.part)):
        texts[r.archive[-5:], r.name] = texts.get((r.archive[-5:], r.name), "") + r.value
    assert texts == {("a.zip", "train/x.jsonl"): long, ("a.zip", "empty.jsonl"): "", ("a.zip", "one.jsonl"): "\n", ("b.zip", "y.jsonl"): "z"}
    parts = [r for r in rows if r.name == "train/x.jsonl"]
    assert len(parts) > 50 and all(r.value.endswith("\n") for r in parts if r.part < len(parts) - 1)


def test_streams_and_files_strip_alike(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\t one  \n \x0b \n two\t\n")
    batch = sorted(r.value for r in readers.lines(spark, str(tmp_path / "a.txt")).collect())
    q = stream.text_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("stripped").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.value for r in spark.table("stripped").collect()) == batch == ["one", "two"]
