import random

import pytest

from spanloom.operators import sentences as se


@pytest.fixture(scope="module")
def stats(spark):
    """A corpus in which a few words keep their dots and others begin sentences."""
    r = random.Random(3)
    nouns = ["cells", "mice", "proteins", "tissue", "samples", "levels", "extracts", "controls"]
    verbs = ["grow", "move", "bind", "change", "remain"]
    rows = []
    for k in range(400):
        out = []
        for _ in range(12):
            start = r.choice(["The", "The", "We", "However", "These", "In"])
            middle = r.choice(["", " cf. Smith", " approx. 3 of them", " e.g. in Vienna", " i.e. often", " by Dr. Brown", " in Fig. 2", " as J. Brown says", " on the 3. April day", " et al. again"])
            out.append(f"{start} {r.choice(nouns)} {r.choice(verbs)}{middle} and {r.choice(nouns)} {r.choice(verbs)}.")
        rows.append((k, " ".join(out)))
    tokens = se.words(spark.createDataFrame(rows, "doc_id long, text string"))
    found = se.statistics(tokens)
    for x in (found.abbreviations, found.starters, found.collocations):
        x.persist()
    return found


def test_abbreviations_and_starters(stats):
    short = {r.word for r in stats.abbreviations.collect()}
    assert {"cf", "approx", "e.g", "i.e", "dr", "fig", "al"} - short <= {"approx"}
    assert not short & {"grow", "move", "bind", "change", "remain"}
    starts = {r.word for r in stats.starters.collect()}
    assert {"the", "we", "however", "these"} <= starts and not starts & {"cells", "grow", "and"}


CASES = [
    ("We grow cells. The mice move.", ["We grow cells.", "The mice move."]),
    ("It was Dr. Brown. We saw it.", ["It was Dr. Brown.", "We saw it."]),
    ("See Fig. 2 for this. However it moves!", ["See Fig. 2 for this.", "However it moves!"]),
    ("A value of 3.14 or 2,5. These change.", ["A value of 3.14 or 2,5.", "These change."]),
    ("By J. Brown and K. Smith here. In mice too.", ["By J. Brown and K. Smith here.", "In mice too."]),
    ("On the 3. April day. We move? Yes! (It does.) So", ["On the 3. April day.", "We move?", "Yes!", "(It does.)", "So"]),
    ("Found e.g. in cells, i.e. often. The end", ["Found e.g. in cells, i.e. often.", "The end"]),
    ("Brown et al. The mice move.", ["Brown et al.", "The mice move."]),
    ("It is small. it goes on. éa", ["It is small. it goes on. éa"]),
    ("  \n", []),
    ("", []),
    (None, []),
    ("one", ["one"]),
    ("First line.\n\n  Second line.", ["First line.", "Second line."]),
]


def test_sentences_of_a_fixture(spark, stats):
    docs = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "doc_id long, text string").repartition(3)
    found = se.sentences(docs, stats).collect()
    for k, (text, want) in enumerate(CASES):
        mine = sorted((r for r in found if r.doc_id == k), key=lambda r: r.number)
        assert [r.sentence for r in mine] == want, text
        assert [r.number for r in mine] == list(range(len(want)))
        assert all(text[r.start : r.end] == r.sentence for r in mine)


def test_an_empty_table_has_no_sentences(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert se.sentences(docs).count() == 0


def test_no_text_goes_with_each_of_its_sentences(spark):
    docs = spark.createDataFrame([(1, "It is. We go."), (1, "We go. It is."), (2, "One."), (2, "One."), (None, "Two.")], "doc_id long, text string")
    found = se.sentences(docs)
    # Rows of equal ids are cut by their own texts.
    assert sorted((r.doc_id, r.number, r.sentence) for r in found.collect()) == [(1, 0, "It is."), (1, 0, "We go."), (1, 1, "It is."), (1, 1, "We go."), (2, 0, "One."), (2, 0, "One.")]
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
