import random
import xml.etree.ElementTree as ET

import pytest

from spanloom.sources import xmlrecords


def outermost(element, name):
    """The elements of a name that are in no other of it."""
    for child in element:
        if child.tag == name:
            yield child
        else:
            yield from outermost(child, name)


def bare(element):
    element.tail = None
    return ET.canonicalize(ET.tostring(element, encoding="unicode"))


def document(r, count, nested=True):
    def record(depth):
        parts = [r.choice(["text é ", "a &lt; b ", "<i>x</i> ", "<recorder>no</recorder>", "<!-- </rec> <rec> -->", "<![CDATA[ </rec><rec a='>'> ]]>", "<?pi </rec> ?>", "\n"]) for _ in range(r.randrange(6))]
        if nested and depth < 3 and r.random() < 0.4:
            parts.insert(r.randrange(len(parts) + 1), record(depth + 1))
        if r.random() < 0.1:
            return f"<rec k='{r.randrange(99)}' note='a > b'/>"
        return f"<rec k=\"{r.randrange(99)}\">{''.join(parts)}</rec{r.choice(['', '', '', ' '])}>"

    body = "\n".join(record(0) + r.choice(["", "<other><p/></other>", "<!-- a comment <rec> -->"]) for _ in range(count))
    return f"<?xml version='1.0'?>\n<!-- <rec> -->\n<all><rec-list>{body}</rec-list>\n</all>\n"


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "1")

    def put(size):
        spark.conf.set(names[0], str(size))

    yield put
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [40, 333, 5000, 10_000_000])
@pytest.mark.parametrize("splits", [xmlrecords.SPLITS, 0])
def test_records_equal_the_parsed_whole(spark, tmp_path, small_splits, size, splits):
    r = random.Random(size)
    want = []
    for k in range(4):
        text = document(r, [40, 7, 1, 0][k], nested=k < 2)
        (tmp_path / f"{k}.xml").write_text(text)
        want += [bare(e) for e in outermost(ET.fromstring(text), "rec")]
    small_splits(size)
    rows = xmlrecords.records(spark, str(tmp_path), "rec", splits).collect()
    assert sorted(bare(ET.fromstring(x.xml)) for x in rows) == sorted(want)
    assert len({(x.path, x.start, x.number) for x in rows}) == len(rows)


def test_order_within_a_file_and_what_is_not_ended(spark, tmp_path, small_splits):
    (tmp_path / "a.xml").write_text("</rec><all>" + "".join(f"<rec>{k}</rec>" for k in range(300)) + "<rec>open <rec>inner")
    small_splits(100)
    rows = sorted(xmlrecords.records(spark, str(tmp_path / "a.xml"), "rec").collect(), key=lambda r: (r.start, r.number))
    assert [r.xml for r in rows] == [f"<rec>{k}</rec>" for k in range(300)]


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    body = "<p>words of a paragraph</p>" * 400
    with open(tmp_path / "big.xml", "w") as f:
        f.write("<all>")
        for k in range(19_000):
            f.write(f"<article id='{k}'>{body}</article>\n")
        f.write("</all>")
    assert (tmp_path / "big.xml").stat().st_size > 200_000_000
    rows = xmlrecords.records(spark, str(tmp_path / "big.xml"), "article")
    found = rows.selectExpr("length(xml) as n", "cast(regexp_extract(xml, \"id='([0-9]+)'\", 1) as int) as k", "xml like '<article%</article>' as whole", "spark_partition_id() as p")
    got = found.selectExpr("count(*) c", "count(distinct k) d", "min(n) low", "max(n) high", "every(whole) w", "count(distinct p) p").first()
    assert (got.c, got.d, got.w) == (19_000, 19_000, True) and got.p > 1
    assert got.high - got.low == 4 and got.low == len(f"<article id='0'>{body}</article>")
