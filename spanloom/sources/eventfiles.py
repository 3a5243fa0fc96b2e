"""A sink of event files, as training boards read them: scalars and images by tag and step.

spark.dataSource.register(EventFiles), then rows.write.format("eventfiles").mode("append").save(folder).
Rows have step (long), wall_time (double), tag (string) and value (double) or image (binary, a PNG).
Each task writes a file of framed records under a hidden folder; when all tasks have ended well the
files are moved to their names, and when one has not the hidden folder goes, so a reader never
sees a part of a run. Files are reached by pyarrow's file systems, so the folder may be an address
of any of these; driver and executors must share it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "step long, wall_time double, tag string, value double, image binary"


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return out


_CRC = _crc_table()


def crc32c(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = _CRC[(c ^ b) & 255] ^ c >> 8
    return c ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    """A checksum as records carry it: turned by 15 bits, plus a constant."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def record(data: bytes) -> bytes:
    """Length, its checksum, data, their checksum."""
    size = struct.pack("<Q", len(data))
    return size + struct.pack("<I", masked(crc32c(size))) + data + struct.pack("<I", masked(crc32c(data)))


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _bytes(field: int, data: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(data)) + data


def _whole(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def png_size(image: bytes) -> tuple[int, int, int]:
    """Width, height and channels of a PNG, from its head."""
    if image[:8] != b"\x89PNG\r\n\x1a\n" or image[12:16] != b"IHDR":
        raise ValueError("an image must be a PNG")
    width, height, _, kind = struct.unpack(">IIBB", image[16:26])
    return width, height, {0: 1, 2: 3, 3: 3, 4: 2, 6: 4}[kind]


def png(pixels: bytes, width: int, height: int, channels: int) -> bytes:
    """A PNG of rows of bytes: 1 (grey), 2 (grey and alpha), 3 (colours) or 4 channels."""
    step = width * channels
    if len(pixels) != step * height:
        raise ValueError(f"{width} x {height} x {channels} needs {step * height} bytes, not {len(pixels)}")
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[i : i + step] for i in range(0, len(pixels), step)) if step else b""
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def event(wall_time: float, step: int, tag: str, value: float | None = None, image: bytes | None = None) -> bytes:
    """An event of one value; an image goes before a number."""
    if image is not None:
        width, height, channels = png_size(image)
        held = _bytes(4, _whole(1, height) + _whole(2, width) + _whole(3, channels) + _bytes(4, image))
    else:
        held = _varint(2 << 3 | 5) + struct.pack("<f", value)
    summary = _bytes(1, _bytes(1, tag.encode()) + held)
    return struct.pack("<Bd", 1 << 3 | 1, wall_time) + _whole(2, step) + _bytes(5, summary)


def head(wall_time: float) -> bytes:
    """The first event of a file: the format's version."""
    return struct.pack("<Bd", 1 << 3 | 1, wall_time) + _bytes(3, b"brain.Event:2")


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    count: int


class EventFiles(DataSource):
    """The sink; options: path."""

    @classmethod
    def name(cls) -> str:
        return "eventfiles"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("event files are appended to a folder: use mode append")
        return _Writer(self.options["path"])


class _Writer(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path.rstrip("/"), uuid.uuid4().hex

    def _folder(self):
        from pyarrow import fs

        store, where = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return store, where, f"{where}/.run-{self.run}"

    def write(self, iterator) -> _Written:
        from pyspark import TaskContext

        store, _, hidden = self._folder()
        context, out, name, count = TaskContext.get(), None, None, 0
        try:
            for row in iterator:
                # A value of neither kind, or without a tag, has nothing to show.
                if row["tag"] is None or (row["value"] is None and row["image"] is None):
                    continue
                when = float(row["wall_time"] or 0.0)
                if out is None:
                    name = f"{context.partitionId():05d}-{context.taskAttemptId()}"
                    store.create_dir(hidden, recursive=True)
                    out = store.open_output_stream(f"{hidden}/{name}")
                    out.write(record(head(when)))
                out.write(record(event(when, int(row["step"] or 0), row["tag"], row["value"], row["image"])))
                count += 1
        finally:
            if out is not None:
                out.close()
        return _Written(name, count)

    def commit(self, messages: list) -> None:
        store, where, hidden = self._folder()
        written = [m for m in messages if m is not None and m.name]
        for m in written:
            store.move(f"{hidden}/{m.name}", f"{where}/events.out.tfevents.{m.name}.{self.run}")
        if written:  # with what attempts that lost have left
            store.delete_dir(hidden)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _, hidden = self._folder()
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)
