import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanloom.sources import eventfiles as ev


def crc_by_bits(data):
    """The checksum by its polynomial, bit by bit."""
    c = 0xFFFFFFFF
    for byte in data:
        for k in range(8):
            bit = (c ^ byte >> k) & 1
            c = c >> 1 ^ (0x82F63B78 if bit else 0)
    return c ^ 0xFFFFFFFF


def unmasked(x):
    r = (x - 0xA282EAD8) & 0xFFFFFFFF
    return (r >> 17 | r << 15) & 0xFFFFFFFF


def fields(data):
    """Fields of a message: number, and the value as it stands."""
    i, out = 0, []

    def varint():
        nonlocal i
        n = shift = 0
        while True:
            b = data[i]
            i += 1
            n |= (b & 127) << shift
            shift += 7
            if b < 128:
                return n

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            value = varint()
        elif key & 7 == 1:
            value, i = struct.unpack("<d", data[i : i + 8])[0], i + 8
        elif key & 7 == 5:
            value, i = struct.unpack("<f", data[i : i + 4])[0], i + 4
        else:
            n = varint()
            value, i = data[i : i + n], i + n
        out.append((key >> 3, value))
    return out


def events(folder):
    out, versions = [], 0
    for file in sorted(Path(folder).glob("events.out.tfevents.*")):
        data, i = file.read_bytes(), 0
        while i < len(data):
            n, c = struct.unpack("<QI", data[i : i + 12])
            body, (d,) = data[i + 12 : i + 12 + n], struct.unpack("<I", data[i + 12 + n : i + 16 + n])
            assert unmasked(c) == crc_by_bits(data[i : i + 8]) and unmasked(d) == crc_by_bits(body)
            i += 16 + n
            e = dict(fields(body))
            if 3 in e:
                assert e[3] == b"brain.Event:2"
                versions += 1
                continue
            value = dict(fields(dict(fields(e[5]))[1]))
            out.append((e.get(2, 0), e[1], value[1].decode(), value.get(2), value.get(4)))
    return out, versions


@pytest.fixture
def sink(spark):
    spark.dataSource.register(ev.EventFiles)
    return lambda rows, to: rows.write.format("eventfiles").mode("append").save(str(to))


def test_scalars_and_images_come_back(spark, sink, tmp_path):
    image = ev.png(bytes(range(24)), 4, 2, 3)
    rows = [(k, 1000.5 + k, f"loss/é{k % 3}", k / 8, None) for k in range(200)] + [(7, 1.0, "picture", None, bytearray(image)), (-1, 2.0, "before", 1.0, None), (1 << 40, None, "late", 2.0, None), (None, 3.0, "no step", 3.0, None), (1, 1.0, None, 4.0, None), (1, 1.0, "nothing", None, None)]
    sink(spark.createDataFrame(rows, ev.SCHEMA).repartition(5), tmp_path / "a")
    found, versions = events(tmp_path / "a")
    assert versions == 5 and len(found) == 204
    scalars = {(s, t): (w, v) for s, w, t, v, i in found if i is None}
    assert scalars[(9, "loss/é0")] == (1009.5, 9 / 8) and scalars[((1 << 64) - 1, "before")] == (2.0, 1.0) and scalars[(1 << 40, "late")] == (0.0, 2.0) and scalars[(0, "no step")] == (3.0, 3.0)
    shown = dict(fields(next(i for *_, i in found if i)))
    assert (shown[1], shown[2], shown[3], shown[4]) == (2, 4, 3, image)
    assert not list((tmp_path / "a").glob(".run-*"))
    sink(spark.createDataFrame(rows[:3], ev.SCHEMA), f"file://{tmp_path}/a")
    assert len(events(tmp_path / "a")[0]) == 207


def test_a_run_that_fails_leaves_nothing(spark, sink, tmp_path):
    rows = spark.range(100).repartition(4).select(F.col("id").alias("step"), F.lit(0.0).alias("wall_time"), F.lit("t").alias("tag"), F.lit(1.0).alias("value"), F.when(F.col("id") == 77, F.lit(b"no png")).alias("image"))
    with pytest.raises(Exception, match="must be a PNG"):
        sink(rows, tmp_path / "b")
    left = [p for p in (tmp_path / "b").rglob("*")] if (tmp_path / "b").exists() else []
    assert left == []
    with pytest.raises(Exception, match="append"):
        rows.where("id < 5").write.format("eventfiles").mode("overwrite").save(str(tmp_path / "b"))


def test_an_empty_table_writes_no_file(spark, sink, tmp_path):
    sink(spark.createDataFrame([], ev.SCHEMA), tmp_path / "c")
    assert events(tmp_path / "c") == ([], 0)


def test_checksums_and_pictures():
    assert ev.crc32c(b"123456789") == 0xE3069283 == crc_by_bits(b"123456789")
    image = ev.png(bytes(6), 3, 2, 1)
    assert ev.png_size(image) == (3, 2, 1) and zlib.decompress(image[41 : image.index(b"IEND") - 8]) == b"\0\0\0\0" * 2
    with pytest.raises(ValueError, match="needs 6 bytes"):
        ev.png(b"", 3, 2, 1)
