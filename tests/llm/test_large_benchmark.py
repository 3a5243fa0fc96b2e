"""A benchmark beyond one block: fingerprints meet in a join, and only items that documents touch are looked up."""

import random

import pytest

from spanloom.llm import decontaminate as de
from spanloom.llm.workspace import Workspace


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    prose = lambda n: " ".join(f"w{r.randrange(4000)}" for _ in range(n))
    items = [(str(i), prose(r.randrange(10, 40))) for i in range(300)] + [("short", "just three words"), ("none", None), ("empty", " ,. "), (None, prose(20)), ("5", prose(15)), ("same", "a b c d e f g h i j k"), ("again", "a b c d e f g h i j k")]
    docs = [(k, f"{prose(50)} {items[k * 7][1]} {prose(30)}") for k in range(20)] + [(100, f"{prose(9)}. JUST three, words"), (101, None), (102, ""), (103, f"x {items[303][1]} y"), (104, "a b c d e f g h i j k " * 200), (104, "a b c d e f g h i j k " * 200), (105, prose(400))]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3).persist(), spark.createDataFrame(items, "item_id string, text string").repartition(2).persist()


@pytest.mark.parametrize("block", [40, 500, 3000])
def test_blocks_change_nothing(tables, block):
    docs, items = tables
    columns = ["doc_id", "n_words", "n_hit", "n_items", "item_ids", "items_sha256", "contaminated"]
    rows = lambda **k: sorted(map(tuple, de.decontaminate(docs, items, **k).select(columns).collect()), key=repr)
    found = rows(block_chars=block)
    assert found == rows() and len(found) == docs.count()
    assert sum(r[-1] for r in found) == 24


def test_only_touched_items_are_left(spark, tables):
    docs, items = tables
    left = {r.item for r in de.touched(docs, items.withColumnRenamed("item_id", "item"), de.SPAN, de.K, Workspace(spark)).collect()}
    assert {str(k * 7) for k in range(20)} | {"short", "same", "again", None} <= left and len(left) < 60
    assert "none" not in left and "empty" not in left
    short = {r.item for r in de.touched(docs.limit(0), items.withColumnRenamed("item_id", "item"), de.SPAN, de.K, Workspace(spark)).collect()}
    assert short == {"short"}


def test_an_empty_benchmark_and_no_documents(spark, tables):
    docs, items = tables
    assert de.decontaminate(docs.limit(0), items, block_chars=100).count() == 0
    assert de.decontaminate(docs, items.limit(0), block_chars=100).where("contaminated").count() == 0
