"""Records of large XML files, each file read by many tasks.

Spark's text reader cuts files at a record's end tag, so a file of any size is read in splits
and no task holds it. What stands before an end tag is a piece: a record as a rule, but not
where records hold records of their own name, where a comment or character data has the tag in
it, or where a record goes over the end of a split. A first pass takes from each split what it
does to where one stands (in text, a comment, character data or an instruction) and to the
depth of open records; this is carried on from split to split of a file, one row for each; and
a second pass cuts out the records. Parts of a record that lies in several splits meet in a
group-by, all others leave the task that has read them.

Files are UTF-8. An end tag of nothing is passed over; an element whose end tag is missing ends
with its file, if no other is open inside it, and is left out else.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = 0
#: What ends each place one can stand in, after TEXT.
_ENDS = ("", "-->", "]]>", "?>")
_STARTS = {"<!--": 1, "<![CDATA[": 2, "<?": 3}


def _marks(name: str) -> re.Pattern:
    tag = re.escape(name)
    return re.compile(rf"""<!--|<!\[CDATA\[|<\?|<{tag}(?=[\s/>])(?:[^>"']|"[^"]*"|'[^']*')*>|</{tag}\s+>""")


def _events(text: str, place: int, marks: re.Pattern) -> tuple[list[tuple[int, int, int]], int]:
    """Openings (+1), ends (-1) and whole empty records (0) of a piece, as (kind, start, end), and the place at its end."""
    out, at = [], 0
    while True:
        if place != TEXT:
            end = text.find(_ENDS[place], at)
            if end < 0:
                return out, place
            at, place = end + len(_ENDS[place]), TEXT
        m = marks.search(text, at)
        if m is None:
            return out, TEXT
        at = m.end()
        if m[0] in _STARTS:
            place = _STARTS[m[0]]
        else:
            out.append((-1 if m[0][1] == "/" else 0 if m[0].endswith("/>") else 1, m.start(), m.end()))


def pieces(spark: SparkSession, path: str, name: str) -> DataFrame:
    """path, split (its first byte), value: what stands before the end tags, in the order of each split."""
    rows = spark.read.option("lineSep", f"</{name}>").text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")


def _with_end(events: list[tuple[int, int, int]], after: int, size: int) -> list[tuple[int, int, int]]:
    """The end tag that stands behind a piece is one, unless the piece ends in a comment or the like."""
    return [*events, (-1, size, size)] if after == TEXT else events


def _summed(name: str):
    """For each split and each place at its start: the place at its end, and what it does to the depth, least on the way and in all."""
    marks = _marks(name)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, key, out = {}, None, []
        for batch in batches:
            for path, split, text in zip(batch["path"], batch["split"], batch["value"], strict=True):
                if (path, split) != key:
                    out += [(*key, s, *of) for s, of in now.items()]
                    key, now = (path, split), {s: (s, 0, 0) for s in range(len(_ENDS))}
                found: dict = {}
                for s, (place, low, total) in now.items():
                    if place not in found:
                        found[place] = _events(text, place, marks)
                    events, after = found[place]
                    for kind, _, _ in _with_end(events, after, len(text)):
                        total += kind
                        low = min(low, total)
                    now[s] = (after, low, total)
            yield pd.DataFrame(out, columns=["path", "split", "start", "place", "low", "total"])
            out = []
        yield pd.DataFrame([(*key, s, *of) for s, of in now.items()], columns=["path", "split", "start", "place", "low", "total"])

    return each


def _carried(splits: pd.DataFrame) -> pd.DataFrame:
    """For each split of a file, where it starts: the place, the depth, and the split in which the open record began."""
    out, place, depth, began = [], TEXT, 0, -1
    ordered = splits.sort_values(["split", "start"])
    for (path, split), rows in ordered.groupby(["path", "split"], sort=True):
        out.append((path, split, place, depth, began))
        place, low, total = (int(rows[c].iloc[place]) for c in ("place", "low", "total"))
        if depth + low <= 0:  # no record goes through all of the split
            began = split
        depth = max(depth, -low) + total
    return pd.DataFrame(out, columns=["path", "split", "place", "depth", "began"])


_PART = "path string, start long, number long, part long, whole boolean, ends boolean, xml string"


def _cut(name: str):
    """Whole records of each split, and parts of those that go over its ends, which are known by the split that they begin in."""
    marks, tail, columns = _marks(name), f"</{name}>", [c.split()[0] for c in _PART.split(", ")]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        place, depth, began, count = TEXT, 0, -1, 0

        def give(ends: bool) -> None:
            mine = began == key[1]
            out.append((key[0], began, count if mine else None, key[1], mine and ends, ends, "".join(held)))
            held.clear()

        for batch in batches:
            for path, split, p, d, b, text in zip(*[batch[c] for c in ("path", "split", "place", "depth", "began", "value")], strict=True):
                if (path, split) != key:
                    if depth:
                        give(False)
                    key, place, depth, began, count = (path, split), p, d, b, 0
                events, after = _events(text, place, marks)
                at = 0
                for kind, start, end in _with_end(events, after, len(text)):
                    if depth == 0:
                        if kind < 0:
                            continue
                        at, began, count = start, split, count + 1
                    depth += kind
                    if depth == 0:
                        held.append(text[at:end] + (tail if start == len(text) else ""))
                        give(True)
                if depth:
                    held.append(text[at:] + tail)
                place = after
            yield pd.DataFrame(out, columns=columns)
            out.clear()
        if depth:
            give(False)
        yield pd.DataFrame(out, columns=columns)

    return each


#: Splits whose starts are broadcast, at most (some 40 bytes each).
SPLITS = 1 << 20


def records(spark: SparkSession, path: str, name: str, splits: int = SPLITS) -> DataFrame:
    """path, start (the first byte of the split that a record begins in), number (from 1 there), xml: the elements called name of the files of a path, outermost ones as wholes.

    Splits are those of the session (spark.sql.files.maxPartitionBytes), the same for both passes.
    """
    read = pieces(spark, path, name)
    sums = read.mapInPandas(_summed(name), "path string, split long, start int, place int, low long, total long")
    begins = sums.groupBy("path").applyInPandas(_carried, "path string, split long, place int, depth long, began long").select(F.xxhash64("path").alias("_file"), F.col("split").alias("_split"), "place", "depth", "began").persist()
    file = F.xxhash64("path")
    if begins.count() <= splits:
        placed = read.join(F.broadcast(begins), (file == F.col("_file")) & (F.col("split") == F.col("_split")))
    else:
        order = read.withColumn("_order", F.monotonically_increasing_id())
        placed = order.join(begins, (file == F.col("_file")) & (F.col("split") == F.col("_split"))).sortWithinPartitions("path", "split", "_order")
    parts = placed.select("path", "split", "place", "depth", "began", "value").mapInPandas(_cut(name), _PART)
    return joined(parts)


def joined(parts: DataFrame) -> DataFrame:
    """Whole records as they are, and those of several parts put together in the order of their splits; what has no end is left out."""
    columns = ["path", "start", "number", "xml"]
    over = parts.where("not whole").groupBy("path", "start").agg(F.max("number").alias("number"), F.max("ends").alias("ends"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "xml"))), lambda p: p["xml"]), "").alias("xml"))
    return parts.where("whole").select(columns).unionByName(over.where("ends").select(columns))
