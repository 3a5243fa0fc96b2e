"""Whole texts as UTF-8 bytes in numpy: words, lines and their hashes, many documents at a time.

Arrow hands a task its strings as one byte buffer with offsets. Everything here
works on that buffer directly, in chunks of about CHUNK bytes, so memory follows
the chunk (or one very long text), not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
LONG = 4 * CHUNK
_MULT = 0x9E6C63D0876A3F6B
#: Bytes from which on a piece is hashed by itself.
_LONG_PIECE = 64

UPPER_TO_LOWER = np.arange(256, dtype=np.uint8)
UPPER_TO_LOWER[65:91] += 32

#: Bytes of a word when words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of a word when words are [^\x20\x09-\x0D]+.
NONSPACE = np.ones(256, dtype=bool)
NONSPACE[[32, 9, 10, 11, 12, 13]] = False


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Ranges [i, j) of texts of about size bytes together; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, zeros after the end."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate((data, np.zeros(8, np.uint8))), 8)


def absorb(h: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A hash and one more value; not linear, so that no exchange of values goes unseen."""
    h = (h * np.uint64(_MULT)) ^ value
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def piece_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of pieces [start, end) of bytes; equal pieces have equal hashes wherever they stand."""
    return piece_hashes(data, starts, ends, 1)[0]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: int = 2) -> list[np.ndarray]:
    """count (two at most) independent hashes of each piece [start, end) of bytes."""
    lengths = ends - starts
    out = [mix(lengths.astype(np.uint64) + np.uint64(_MULT * (k + 1) & 0xFFFFFFFFFFFFFFFF)) for k in range(count)]
    view = eights(data)
    left = np.arange(len(starts))
    long = lengths >= _LONG_PIECE
    if long.any():
        raw = memoryview(np.ascontiguousarray(data))
        where, left = left[long], left[~long]
        whole = [xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)]
        both = np.frombuffer(b"".join(whole), "<u8").reshape(-1, 2)
        for k in range(count):
            out[k][where] = both[:, k]
    at = 0
    while len(left):
        left = left[lengths[left] > at]
        value = np.ascontiguousarray(view[starts[left] + at]).view("<u8").ravel()
        spare = np.clip(at + 8 - lengths[left], 0, 7).astype(np.uint64) * np.uint64(8)
        value = value << spare >> spare
        for h in out:
            h[left] = absorb(h[left], value)
        at += 8
    return [mix(h) for h in out]


def window_hash(data: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of size bytes in a row from each place on, by doubling; len(data) - size + 1 of them."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    have = 8 if size >= 8 else 1
    h = np.ascontiguousarray(eights(data)[: len(data) - have + 1]).view("<u8").ravel() if have == 8 else data.astype(np.uint64)
    h = absorb(mix(np.full(len(h), size * 1_000_003 + seed, np.uint64)), h)
    while have * 2 <= size:
        h = absorb(h[: len(h) - have], h[have:])
        have *= 2
    if have < size:
        h = absorb(h[:n], h[size - have : size - have + n])
    return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of the first word of each text (n + 1 of them)."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = letters[data]
    turn = np.diff(inside)
    first = turn[:-1] == 1
    last = turn[1:] == -1  # the byte is the last of a word
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a word would run on into the next text
    first[both] = True
    last[both - 1] = True
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words, and the index of the first word of each text.

    A text beyond LONG bytes is hashed in parts that end between words.
    """
    if len(data) <= LONG:
        starts, ends, first = word_spans(data, offsets, letters)
        return piece_hash(UPPER_TO_LOWER[data], starts, ends), first
    parts, first, count = [], [0], 0
    for i in range(len(offsets) - 1):
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(at + LONG, end)
            while to < end and letters[data[to - 1]] and letters[data[to]]:
                to += 1
            starts, ends, _ = word_spans(data[at:to], np.array([0, to - at]), letters)
            parts.append(piece_hash(UPPER_TO_LOWER[data[at:to]], starts, ends))
            count += len(starts)
            at = to
        first.append(count)
    return np.concatenate(parts), np.array(first)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k values in a row; len(values) - k + 1 of them, over the ends of texts too."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out + values[j : j + n]) * np.uint64(_MULT)
        out ^= out >> np.uint64(29)
    return mix(out)


def within(first: np.ndarray, total: int, k: int) -> np.ndarray:
    """Starts of all runs of k items that lie in one text."""
    starts = np.arange(max(0, total - k + 1))
    owner_end = np.repeat(first[1:], np.diff(first))[: len(starts)]
    return starts[starts + k <= owner_end]


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row, by doubling."""
    out, have = values, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(values) - w + 1], out[w - have : w - have + len(values) - w + 1])
    return out


def grams_at(values: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """grams(values, k)[starts], without computing the others."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for j in range(k):
        out = (out + values[starts + j]) * np.uint64(_MULT)
        out ^= out >> np.uint64(29)
    return mix(out)
