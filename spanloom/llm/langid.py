"""Language identification by error-correcting output codes.

Each language gets a codeword. For every bit, a binary n-gram classifier says on
which side of the code a text lies; its weights are log ratios of hashed byte
n-gram frequencies between the languages with that bit and those without. A text's
margins are decoded to the codeword of least loss; a text whose two best codewords are
nearly as close is flagged ambiguous. Each bit's loss is weighted by the log odds that
its classifier is right, as measured on learning rows that are held back from its counts
(one in HOLD_BACK of the sample).

Counts are gathered in Spark from a bounded sample of the labelled rows
(sample_rows per language, by a hash of doc_id); the model is broadcast. It has BUCKETS
weights for each bit; beyond MANY languages bits grow with the logarithm of their number.

Defined results: a null or empty text, or one without any letter, gives und with
score 0 and is not ambiguous; the score is the best codeword's share of the
exponentiated losses (0 to 1); ties go to the language that sorts first; copies
get equal answers; no labelled rows at all give und throughout; an empty table
gives no rows. Whole texts are read, however long.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .workspace import bounded_batches

BUCKETS = 1 << 16
SAMPLE_ROWS = 3000
HOLD_BACK = 5
MANY = 32
COUNT_TASKS = 12
AMBIGUOUS = 0.6
RESULT = "doc_id long, lang_pred string, score double, ambiguous boolean"
_LETTER = regex.compile(r"\p{L}")
_ASCII_LETTERS = np.zeros(256, dtype=bool)
_ASCII_LETTERS[65:91] = _ASCII_LETTERS[97:123] = True
#: A byte's class in n-grams: letters as they are, everything else one separator.
_CLASS = np.where(tb.ALNUM, tb.UPPER_TO_LOWER, 32).astype(np.uint32)
_CLASS[48:58] = 32


def codewords(n: int) -> np.ndarray:
    """n codewords (rows) of -1 and 1, far apart from one another.

    Up to seven languages get the exhaustive code: every split of the languages
    into two sides is one bit. More get rows of a Hadamard matrix, any two of
    which differ in half of the bits; beyond MANY the best of some random codes of
    12 log2 n bits.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = [s for s in itertools.product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, dtype=float).T
    if n > MANY:
        rng, best = np.random.default_rng(n), (-1, None)
        for _ in range(20):
            code = rng.choice([-1.0, 1.0], (n, int(np.ceil(12 * np.log2(n)))))
            agree = code @ code.T
            np.fill_diagonal(agree, -np.inf)
            best = max(best, (float(-agree.max()), code), key=lambda x: x[0]) if best[1] is not None else (float(-agree.max()), code)
        return best[1]
    h = np.ones((1, 1))
    while len(h) <= n:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:]


def gram_ids(data: np.ndarray) -> np.ndarray:
    """The bucket of the four bytes that end at each byte."""
    c = _CLASS[data]
    x = c * np.uint32(0x9E3779B1)
    x[1:] += c[:-1] * np.uint32(0x85EBCA6B)
    x[2:] += c[:-2] * np.uint32(0xC2B2AE35)
    if len(c) > 3:
        x[3:] += c[:-3] * np.uint32(0x27D4EB2F)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return (x >> np.uint32(16)).astype(np.intp)


class Model:
    """Languages, their codewords, and for each bit its n-gram weights and its weight in decoding."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.code = codewords(len(self.languages))
        share = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * BUCKETS) for x in self.languages])
        self.weights = np.zeros((self.code.shape[1], BUCKETS), dtype=np.float32)
        for b in range(self.code.shape[1]):
            one, other = self.code[:, b] > 0, self.code[:, b] < 0
            if one.any() and other.any():
                self.weights[b] = np.log(share[one].mean(axis=0)) - np.log(share[other].mean(axis=0))
        self.trust = np.full(self.code.shape[1], 1 / max(1, self.code.shape[1]))

    def weigh(self, right: np.ndarray, rows: int) -> None:
        """Give each bit its weight in decoding, from how often its classifier was right on rows it had not seen."""
        rate = (right + 1) / (rows + 2)
        self.trust = np.clip(np.log(rate / (1 - rate)), 1e-3, None)
        self.trust /= self.trust.sum()

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The mean weight of each text's n-grams, for each bit."""
        if len(data) > tb.LONG and len(offsets) == 2:  # part by part, with the bytes before each
            total = np.zeros(len(self.weights))
            for at in range(0, len(data), tb.LONG):
                before = min(3, at)
                ids = gram_ids(data[at - before : at + tb.LONG])[before:]
                total += [w[ids].astype(np.float64).sum() for w in self.weights]
            return total[None, :] / len(data)
        out = np.zeros((len(offsets) - 1, len(self.weights)))
        full = np.diff(offsets) > 0
        if len(data):
            ids = gram_ids(data)
            for b, w in enumerate(self.weights):
                out[full, b] = np.add.reduceat(w[ids].astype(np.float64), offsets[:-1][full]) / np.diff(offsets)[full]
        return out

    def decode(self, margins: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest codeword and its share, for each text."""
        scale = np.sqrt(np.maximum(lengths, 1))[:, None, None]  # n-grams of a text depend on one another
        agree = margins[:, None, :] * self.code[None, :, :] * np.minimum(scale, 30)
        loss = (np.logaddexp(0, -agree) * self.trust).sum(axis=2)
        likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)) * len(self.trust))
        likely /= likely.sum(axis=1, keepdims=True)
        best = likely.argmax(axis=1)
        return best, likely[np.arange(len(best)), best]


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages of labelled rows; about sample_rows of each are read whole."""
    bounded_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, float(min(1.0, sample_rows / n)))])
    sample = rows.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language sample")), F.lit(1 << 20)) < bound[F.col("lang")] * (1 << 20))

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            data, offsets = tb.column_bytes(batch.column(0))
            for i, lang in enumerate(langs):
                got = np.bincount(gram_ids(data[offsets[i] : offsets[i + 1]]), minlength=BUCKETS)
                total[lang] = total[lang] + got if lang in total else got
        for lang, got in total.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], names=["lang", "gram", "n"])

    # The sample is bounded, so a few tasks count it, however many partitions the table has.
    many = [k for k, n in sizes.items() if n >= 10 * HOLD_BACK]  # a language of few rows needs them all for its counts
    back = F.col("lang").isin(many) & (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("held back")), F.lit(HOLD_BACK)) == 0)
    gathered = sample.repartition(COUNT_TASKS, "doc_id").select("text", "lang", back.alias("back")).where("not back").mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    def dense(batches):
        for batch in batches:
            langs, out = batch.column(0).to_pylist(), []
            for i in range(len(langs)):
                row = np.zeros(BUCKETS, dtype="<i8")
                own = batch.column(1)[i].values
                row[own.field("gram").to_numpy()] = own.field("n").to_numpy()
                out.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["lang", "counts"])

    # One row of BUCKETS counts for each language, at any size of the table.
    packed = gathered.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("grams")).mapInArrow(dense, "lang string, counts binary")
    counts: dict[str, np.ndarray] = {k: np.zeros(BUCKETS) for k in sizes}
    for row in packed.collect():
        counts[row["lang"]] = np.frombuffer(row["counts"], "<i8").astype(float)
    model = Model(counts)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        model = sent.value
        where = {x: k for k, x in enumerate(model.languages)}
        right, rows = np.zeros(model.code.shape[1], dtype=np.int64), 0
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(0))
            side = model.code[[where[x] for x in batch.column(1).to_pylist()]].reshape(-1, model.code.shape[1])
            for i, j in tb.chunks(offsets):
                margins = model.margins(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                right += (margins * side[i:j] > 0).sum(axis=0)
                rows += j - i
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([right.tolist()], pa.list_(pa.int64()))], names=["rows", "right"])

    judged = sample.where(back).repartition(COUNT_TASKS, "doc_id").select("text", "lang").mapInArrow(judge, "rows long, right array<long>").collect()  # one row a task
    model.weigh(np.sum([r["right"] for r in judged], axis=0) if judged else np.zeros(model.code.shape[1]), sum(r["rows"] for r in judged))
    return model


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = tb.column_bytes(column)
    found = np.zeros(len(offsets) - 1, dtype=bool)
    full = np.diff(offsets) > 0
    for i, j in tb.chunks(offsets):
        if full[i:j].any():
            own = offsets[i:j][full[i:j]] - offsets[i]
            found[i:j][full[i:j]] = np.logical_or.reduceat(_ASCII_LETTERS[data[offsets[i] : offsets[j]]], own)
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = _LETTER.search(column[int(i)].as_py()) is not None
    return found


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document, as in RESULT, and the columns to carry, each as carried_ and its name."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        model = sent.value
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            known = has_letter(batch.column(1)) & (len(model.languages) > 0)
            langs, scores = [], []
            for i, j in tb.chunks(offsets):
                if not model.languages:
                    break
                own = offsets[i : j + 1] - offsets[i]
                best, share = model.decode(model.margins(data[offsets[i] : offsets[j]], own), np.diff(own))
                langs += [model.languages[b] for b in best]
                scores += share.tolist()
            langs = [x if k else "und" for x, k in zip(langs or [""] * len(known), known, strict=True)]
            scores = [x if k else 0.0 for x, k in zip(scores or [0.0] * len(known), known, strict=True)]
            doubt = [bool(k and s < AMBIGUOUS) for s, k in zip(scores, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_()), *[batch.column(k) for k in range(2, batch.num_columns)]], names=["doc_id", "lang_pred", "score", "ambiguous", *batch.schema.names[2:]])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])
    kinds = "".join(f", carry_{i} {own.schema[f'carry_{i}'].dataType.simpleString()}" for i in range(len(carry)))
    found = own.mapInArrow(each, RESULT + kinds)
    return found.select("doc_id", "lang_pred", "score", "ambiguous", *[F.col(f"carry_{i}").alias(f"carried_{c}") for i, c in enumerate(carry)])


def held_out(doc_id) -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2
