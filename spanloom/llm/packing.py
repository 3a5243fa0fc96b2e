"""Packing of documents into training sequences along a Hilbert curve.

A document's words are hashed to signs in DIMS dimensions and averaged; that
vector, squashed to integers, has a place on a Hilbert curve, and documents near
one another on it use the same words. The curve is cut into ranges of about equal
bytes (equal keys are ordered by a hash of doc_id, so a large group of copies is
split), as many as the bytes of all texts ask for; the cuts come from the keys of
about RANGE_SAMPLE documents a range, picked at random, and each document's own key
is computed once. Each range is sorted, and its documents are laid end to end and
cut every max_tokens ids.
What is left at a partition's end is cut into powers of two, which need no
padding. Tokens exist only inside the task that packs them. A long text is tokenized
in parts of about PART characters that begin with white space after something else,
where byte-level pre-tokenization always cuts.

Defined results: a null or empty text is one end-of-document id; copies and equal
ids are packed one by one; ties on the curve are ordered by hash and doc_id; an
empty table gives no rows; further columns are ignored. Texts of any length are
cut where sequences end.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .hilbert import hilbert_key
from .workspace import bounded_batches, partitions

MAX_TOKENS = 2048
END_ID = 1
DIMS, BITS = 4, 12
RANGE_SAMPLE, RANGE_BYTES = 16, 8 << 20
PART = 1 << 18
#: White space from which on the faster library's pattern would run out of stack.
LONG_SPACE = 2000
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_tokenizers: dict[object, object] = {}
_LONG_SPACE = re.compile(rf"(?<!\s)\s{{{LONG_SPACE}}}")
_CUT = re.compile(r"(?<=\S)\s")


def tokenizer(path: str | None = None):
    """A function from text to ids, by the byte-level BPE in a tokenizers JSON file.

    Where ids are in the order of the merges, the ranks are the ids and a faster
    library gives the same ids; else, and for parts with very long white space, the
    file's own library is used. Special tokens' strings in a text are these tokens, as
    the file's library has it; parts that hold one go to that library too.
    """
    if path not in _tokenizers:
        if path is None:
            import public_tokenizers

            file = public_tokenizers.path("byte_bpe_50k.json")
        else:
            file = path
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not spec.get("normalizer") and not model.get("continuing_subword_prefix")
        if plain and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs)):
            import tiktoken

            special = {t["content"] for t in spec.get("added_tokens", [])}
            back = {c: b for b, c in _byte_letters().items()}
            ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
            # Fixed value: the pattern of byte-level pre-tokenization.
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            slow = lambda part: any(t in part for t in special) or (len(part) >= LONG_SPACE and _LONG_SPACE.search(part))
            _tokenizers[path] = lambda text: _in_parts(text, lambda part: _plain(file)(part) if slow(part) else fast(part))
        elif before.get("type") == "ByteLevel":
            _tokenizers[path] = lambda text: _in_parts(text, _plain(file))
        else:
            _tokenizers[path] = _plain(file)
    return _tokenizers[path]


def _plain(file: str):
    """A function from text to ids, by the file's own library."""
    if ("plain", file) not in _tokenizers:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(file)
        _tokenizers["plain", file] = lambda text: own.encode(text, add_special_tokens=False).ids
    return _tokenizers["plain", file]


def _in_parts(text: str, encode) -> list[int]:
    """encode(text), for a long text part by part."""
    if len(text) <= PART:
        return encode(text)
    ids: list[int] = []
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PART) if len(text) - at > PART else None
        to = cut.start() if cut else len(text)
        ids += encode(text[at:to])
        at = to
    return ids


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def curve_keys(text: pa.Array) -> np.ndarray:
    """The Hilbert key of each text."""
    data, offsets = tb.column_bytes(text)
    out = np.zeros(len(offsets) - 1, dtype=np.int64)
    for i, j in tb.chunks(offsets):
        hashes, first = tb.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tb.ALNUM)
        counts = np.maximum(np.diff(first), 1)
        points = np.zeros((j - i, DIMS), dtype=np.int64)
        for d in range(DIMS):
            signs = np.concatenate(([0], np.cumsum((hashes >> np.uint64(8 * d)).astype(np.int64) & 255)))
            mean = (signs[first[1:]] - signs[first[:-1]]) / counts / 127.5 - 1  # -1 to 1
            mean[np.diff(first) == 0] = 0
            points[:, d] = (1 + np.tanh(4 * mean)) / 2 * ((1 << BITS) - 1)
        out[i:j] = hilbert_key(points, BITS)
    return out


class _Stream:
    """Ids of a partition's documents, end to end, and the pieces cut from them."""

    def __init__(self, partition: int, max_tokens: int):
        self.sequence, self.max = partition << 33, max_tokens
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, start in its document, document's length; of the ids held
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc, 0, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def take(self, at_end: bool) -> Iterator[tuple]:
        """Pieces of all full sequences; at the end, of the rest too."""
        full = self.held // self.max
        lengths = [self.max] * full
        if at_end:
            rest = self.held - full * self.max
            lengths += [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        k = used = 0  # document, ids of it that are used
        for length in lengths:
            offset = 0
            while offset < length:
                doc, start, total = self.docs[k]
                ids = self.ids[k]
                n = min(length - offset, len(ids) - used)
                yield doc, start + used, n, zlib.crc32(ids[used : used + n].tobytes()), total, self.sequence, offset
                offset += n
                used += n
                if used == len(ids):
                    k, used = k + 1, 0
            self.sequence += 1
        self.held -= sum(lengths)
        self.docs, self.ids = self.docs[k:], self.ids[k:]
        if used:
            doc, start, total = self.docs[0]
            self.docs[0], self.ids[0] = (doc, start + used, total), self.ids[0][used:]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = MAX_TOKENS, end_id: int = END_ID, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces as in RESULT; every id of every document is in exactly one. max_tokens is a power of two."""
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    bounded_batches(docs.sparkSession)
    key = F.arrow_udf(lambda text: pa.array(curve_keys(text), pa.int64()), "long")

    def each(batches):
        encode = tokenizer(tokenizer_path)
        stream = _Stream(TaskContext.get().partitionId(), max_tokens)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids = np.concatenate((np.array(encode(text), dtype="<u4"), end)) if text else end
                stream.add(doc, ids)
                if stream.held >= 256 * max_tokens:
                    yield _rows(stream.take(False))
        yield _rows(stream.take(True))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = own.withColumn("deal", F.xxhash64("doc_id"))
    size, n = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    parts = partitions(docs.sparkSession, size, RANGE_BYTES)
    # By place in the table, so that rows of one id or text are not all picked together.
    picked = own.withColumn("row", F.xxhash64(F.monotonically_increasing_id())).where(F.pmod("row", F.lit(max(1, n // (RANGE_SAMPLE * parts)))) == 0)
    cuts = range_cuts(picked.select(key("text").alias("place"), "deal", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size")), parts)
    ranged = F.arrow_udf(lambda place, deal: pa.array(which_range(cuts, place, deal), pa.int32()), "int")
    placed = own.withColumn("place", key("text")).withColumn("range", ranged("place", "deal"))
    return placed.repartitionById(parts, "range").sortWithinPartitions("place", "deal", "doc_id").select("doc_id", "text").mapInArrow(each, RESULT)


def range_cuts(sample: DataFrame, parts: int) -> np.ndarray:
    """parts - 1 cuts (place, deal) or fewer, between ranges of about equal size, from rows place, deal, size."""
    rows = np.array(sorted(tuple(r) for r in sample.collect()), dtype=np.int64).reshape(-1, 3)  # about RANGE_SAMPLE rows a partition
    if not len(rows) or parts < 2:
        return np.zeros((0, 2), np.int64)
    share = np.cumsum(rows[:, 2]) / rows[:, 2].sum()
    at = np.minimum(np.searchsorted(share, np.arange(1, parts) / parts), len(rows) - 1)
    return np.unique(rows[at, :2], axis=0)


def which_range(cuts: np.ndarray, place: pa.Array, deal: pa.Array) -> np.ndarray:
    """How many cuts are below each (place, deal)."""
    pair = np.dtype([("place", "<i8"), ("deal", "<i8")])
    points = np.empty(len(place), pair)
    points["place"], points["deal"] = place.to_numpy(zero_copy_only=False), deal.to_numpy(zero_copy_only=False)
    return np.searchsorted(np.array([tuple(c) for c in cuts], pair), points, side="left")


def _rows(pieces: Iterator[tuple]) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
