"""Secret scanning with a random forest that removes false positives.

Candidates are found by bytes alone: runs of letters, digits, '_', '+', '/', '-' that
are long and mixed, or that an assignment precedes; what an assignment ('=', ':', '=>',
':=', then any white space) gives, of any bytes up to its closing quote or white space, and
where assignments stand in a value the outermost, the innermost and the pieces between them;
signed tokens with their dots, passwords in addresses, and private keys with their armour.
A finding inside a longer one is not given again. Each gets features of its length, its
character transitions, the share that dictionary words cover, its path (where the text
comes from) and the words around it, and no format of a known service; a random forest
says whether it is a secret. The forest is trained from labelled findings: a table of
them, of at most MAX_FINDINGS rows (those of least hash), or the generated ones of
findings.labelled_findings(). Formats of services only name the kind of a finding.

Defined results: a null or empty text has no findings; a null path is an empty one;
candidates of any length are read whole, texts of any length in parts that end with lines; equal findings at other places are rows of
their own, and copies of a document have findings of their own; an empty table gives
no rows; a text that never holds a candidate gives none. Offsets are in UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .findings import labelled_findings
from .workspace import bounded_batches

LONG, ASSIGNED, VALUE = 16, 8, 6
AROUND = 48
TREES, TREE_DEPTH, LEAF = 40, 10, 3
MAX_FINDINGS = 20_000
THRESHOLD = 0.5
RESULT = "doc_id long, start long, length long, kind string, sha256 string, score double"

_RUN = np.zeros(256, dtype=bool)
_RUN[48:58] = _RUN[65:91] = _RUN[97:123] = True
_RUN[[43, 45, 47, 95]] = True
_DIGIT = np.zeros(256, dtype=np.int32)
_DIGIT[48:58] = 1
_UPPER = np.zeros(256, dtype=np.int32)
_UPPER[65:91] = 1
_LETTER = _UPPER.copy()
_LETTER[97:123] = 1

# How keys of known services begin, what their formats are, and words that tell.
KINDS = [
    ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws-access-key", r"(?:AKIA|ASIA)[A-Z0-9]{16}$"),
    ("github-token", r"gh[pousr]_[A-Za-z0-9]{20,}$"),
    ("slack-token", r"xox[abprs]-[A-Za-z0-9-]{10,}$"),
    ("google-api-key", r"AIza[A-Za-z0-9_-]{30,}$"),
    ("stripe-key", r"[sr]k_(?:live|test)_[A-Za-z0-9]{10,}$"),
    ("json-web-token", r"eyJ[A-Za-z0-9_-]{10,}"),
    ("hex-token", r"[0-9a-f]{16,}$"),
]
SECRET_WORDS = frozenset("password passwd pwd secret token key apikey api auth authorization bearer credential credentials private access client signing passphrase pass".split())
PLAIN_WORDS = frozenset("commit sha sha1 sha256 md5 checksum hash digest uuid guid id revision rev version build etag integrity page isbn doi phone tel order invoice ticket serial card http https www file path image url".split())
DICTIONARY = frozenset("the and for with from this that have not are was been but all any can had her his one our out day get has him how man new now old see two way who did its let put say she too use about after again also back because before being between both come could down each even find first give good great hand here high home house into just know last life like line little long look made make many more most much must name never next number off only other over own part people place right said same should show small some still such take tell than them then there these they thing think those time under until upon very want well were what when where which while will work world would write year your data code test sample example user admin default config file path image page service server client value table index cache query type name string number class method function module package version release build branch commit merge request response header content token key secret password account email address order item product model train label score result report note document section chapter article figure panel text word language".split())
TEST_PATH = re.compile(r"test|example|sample|fixture|mock|demo|docs?/", re.I)
_KINDS = [(name, re.compile(p)) for name, p in KINDS]
_PEM = re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----")
_PEM_END = re.compile(rb"-----END [A-Z ]*PRIVATE KEY-----")
#: From the start of each run of a token's letters: the run and one or two more after dots. Anchored and without backtracking, so that a long run is read once.
_DOTTED = re.compile(rb"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{13,}+)((?:\.[A-Za-z0-9_-]++){1,2}+))")
_USER = re.compile(rb"://[^\s/:@\"'<>]*+:([^\s/@\"'<>]{4,}+)@")
#: Where a long text may be cut: a line's end that no value runs over.
_CUT = re.compile(rb"[^\s=:>\"'`]\n")
_WORDS = re.compile(r"[A-Za-z]+[0-9]*")
FEATURES = 25
_SIGN = re.compile(rb"(?:=>|:=|[=:])\s*+")
_STOP = np.zeros(256, dtype=bool)
_STOP[[9, 10, 11, 12, 13, 32, 34, 39, 96]] = True
#: What stands between one assignment's value and the next one's name.
_BETWEEN = b"&;,|"


def kind_of(candidate: str) -> str:
    return next((name for name, p in _KINDS if p.match(candidate)), "generic")


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of candidate runs; runs do not cross texts."""
    starts, ends, _ = tb.word_spans(data, offsets, _RUN)
    size = ends - starts
    some = size >= ASSIGNED
    starts, ends, size = starts[some], ends[some], size[some]
    if not len(starts):
        return starts, ends
    text_of = offsets[np.searchsorted(offsets, starts, side="right") - 1]
    back = starts - 1
    for _ in range(3):  # over blanks and quotes
        over = (back >= text_of) & np.isin(data[np.maximum(back, 0)], (32, 34, 39, 96))
        back = np.where(over, back - 1, back)
    assigned = (back >= text_of) & np.isin(data[np.maximum(back, 0)], (61, 58))
    count = lambda table: (c := np.concatenate(([0], np.cumsum(table[data], dtype=np.int64))))[ends] - c[starts]
    digits, upper, letters = count(_DIGIT), count(_UPPER), count(_LETTER)
    mixed = (size >= LONG) & (((digits > 0) & (letters > 0)) | (upper == size))
    take = mixed | assigned
    return starts[take], ends[take]


def assigned_values(whole: bytes, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of values after an assignment, without a full stop, comma or semicolon after one without quotes; values do not cross texts.

    A value in quotes ends with its quote. One without ends at white space or a quote; if it
    holds further assignments, the outermost and the innermost are values up to there, and
    each between them one up to the next, less the next one's name. So values are a few times
    as long as the text together, however assignments nest.
    """
    out = []
    stops = np.flatnonzero(_STOP[np.frombuffer(whole, np.uint8)])
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        signs: list[tuple[int, int]] = []  # of one unquoted run: where the sign is, where its value begins
        run_end = -1
        for m in _SIGN.finditer(whole, lo, hi):
            at = m.end()
            if at >= hi:
                continue
            if whole[at] in b"\"'`":
                close = whole.find(whole[at : at + 1], at + 1, hi)
                if close - at > VALUE and whole.find(b"\n", at + 1, close) < 0:
                    out.append((at + 1, close))
                    continue
                at += 1
            k = int(np.searchsorted(stops, at))
            end = min(hi, int(stops[k])) if k < len(stops) else hi
            if end != run_end:
                out += _unquoted(whole, signs, run_end)
                signs, run_end = [], end
            signs.append((m.start(), at))
        out += _unquoted(whole, signs, run_end)
    return out


def _unquoted(whole: bytes, signs: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """The values of a run that ends at end, given its assignments."""
    last = end
    while signs and last > signs[0][1] and whole[last - 1] in b".,;":
        last -= 1
    full = [a for _, a in signs if last - a >= VALUE]
    out = [(a, last) for a in {*full[:1], *full[-1:]}]
    for (_, a), (sign, _) in zip(signs, signs[1:], strict=False):
        if sign - a >= VALUE:
            cut = max(whole.rfind(bytes([x]), a, sign) for x in _BETWEEN)
            stop = cut if cut >= 0 else sign
            if stop - a >= VALUE:
                out.append((a, stop))
    return out


def blocks(whole: bytes) -> list[tuple[int, int]]:
    """Starts and ends of private keys in their armour; of the head alone where the end is missing."""
    heads = [m.span() for m in _PEM.finditer(whole)]
    tails = [m.span() for m in _PEM_END.finditer(whole)]
    out, k = [], 0
    for (a, b), (_, following) in zip(heads, [*heads[1:], (0, len(whole) + 1)], strict=True):
        while k < len(tails) and tails[k][0] < b:
            k += 1
        out.append((a, tails[k][1] if k < len(tails) and following > tails[k][0] else b))
    return out


def signed_tokens(whole: bytes) -> list[tuple[int, int]]:
    """Starts and ends of signed tokens with their dots."""
    out = []
    for m in _DOTTED.finditer(whole):
        at = m[1].find(b"eyJ")
        if 0 <= at <= len(m[1]) - 13:
            out.append((m.start(1) + at, m.end(2)))
    return out


def found_in(raw: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of all candidates of some texts, or of a very long one part by part."""
    whole = raw.tobytes()
    spans = set(blocks(whole)) if b"-----BEGIN " in whole else set()
    at, end = 0, len(raw)
    while at < end:
        cut = _CUT.search(whole, at + tb.LONG) if end - at > tb.LONG and len(own) == 2 else None
        to = cut.end() if cut else end
        part = own if to - at == end else np.array([0, to - at])
        starts, ends = candidates(raw[at:to], part)
        spans.update(zip((starts + at).tolist(), (ends + at).tolist(), strict=True))
        piece = whole if to - at == end else whole[at:to]
        users = [m.span(1) for m in _USER.finditer(piece)]
        ends = np.array([b for _, b in users])
        for a, b in assigned_values(piece, part):
            k = int(np.searchsorted(ends, a, side="right"))
            if k == len(users) or users[k][0] < a or users[k][1] >= b:  # not a value that goes on after a password in an address
                spans.add((a + at, b + at))
        spans.update((a + at, b + at) for a, b in [*users, *signed_tokens(piece)])
        at = to
    return sorted(spans)


def _by_first_letter(words: frozenset[str]) -> re.Pattern:
    """Words of three to ten letters, the longest of those that stand at a place."""
    groups: dict[str, list[str]] = {}
    for w in sorted((w for w in words if 3 <= len(w) <= 10), key=lambda w: (-len(w), w)):
        groups.setdefault(w[0], []).append(w[1:])
    return re.compile("|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(groups.items())))


_VOWEL = frozenset("aeiouy")
_COVER = _by_first_letter(DICTIONARY)
_CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]+")


def features(candidate: str, path: str, before: str, after: str) -> list[float]:
    """The features of a candidate; its characters are looked at as an array, so that a long one takes time and memory in proportion."""
    n = len(candidate)
    codes, place, counts = np.unique(np.frombuffer(candidate.encode("utf-32-le", "surrogatepass"), "<u4"), return_inverse=True, return_counts=True)
    known = [chr(c) for c in codes.tolist()]
    kind = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in known], np.int8)
    alpha = np.array([c.isalpha() for c in known])
    vowel = np.array([c.lower() in _VOWEL for c in known])
    kinds = kind[place]
    of_kind = np.bincount(kind, counts, minlength=4)
    one, two = kinds[:-1], kinds[1:]
    letters = place[alpha[place]]
    vowels = vowel[letters]
    low = candidate.lower()
    share = counts / n
    left = [w.lower() for w in _WORDS.findall(before)][-4:]
    right = [w.lower() for w in _WORDS.findall(after)][:3]
    parts = {p for w in left for p in re.split(r"[_-]", w)}
    stem = before.rstrip(" \"'`\t\r\n\v\f")
    glue = "=" if stem.endswith("=>") else stem[-1:]
    steps, pairs = max(1, n - 1), max(1, len(letters) - 1)
    return [
        n,
        math.log2(n),
        of_kind[0] / n,
        of_kind[1] / n,
        of_kind[2] / n,
        of_kind[3] / n,
        -float((share * np.log2(share)).sum()),
        int((one != two).sum()) / steps,
        int((((one == 0) & ((two == 1) | (two == 2))) | ((two == 0) & ((one == 1) | (one == 2)))).sum()) / steps,
        int(((one == 2) & (two == 1)).sum()) / steps,
        int((vowels[1:] != vowels[:-1]).sum()) / pairs,
        int(vowels.sum()) / max(1, len(letters)),
        max((len(m[0]) for m in _CONSONANTS.finditer(low)), default=0),
        sum(len(m[0]) for m in _COVER.finditer(low)) / n,
        candidate.count("-"),
        candidate.count("/"),
        float(re.fullmatch(r"[0-9a-fA-F]+", candidate) is not None),
        float(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", candidate) is not None),
        int(sum(k for c, k in zip(known, counts.tolist(), strict=True) if c.isspace())) / n,
        float(glue in ("=", ":") and glue != ""),
        float(bool(parts & SECRET_WORDS)),
        float(bool(left) and bool(set(re.split(r"[_-]", left[-1])) & SECRET_WORDS)),
        float(bool(parts & PLAIN_WORDS)),
        float(bool(set(right) & SECRET_WORDS)) - float(bool(set(right) & PLAIN_WORDS)),
        float(TEST_PATH.search(path) is not None),
    ]


class Forest:
    """A random forest of binary trees, as arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = TREE_DEPTH, leaf: int = LEAF, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []  # feature, cut, left, right, value
            self._grow(nodes, x[rows], y[rows], depth, leaf, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean())])
        if depth == 0 or len(y) < 2 * leaf or y.min() == y.max():
            return me
        best = (0.0, -1, 0.0)
        whole = y.mean() * (1 - y.mean())
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            ok = np.flatnonzero((v[:-1] < v[1:]) & (n[:-1] >= leaf) & (len(y) - n[:-1] >= leaf))
            if not len(ok):
                continue
            left, right = ones[ok] / n[ok], (ones[-1] - ones[ok]) / (len(y) - n[ok])
            gain = whole - (n[ok] * left * (1 - left) + (len(y) - n[ok]) * right * (1 - right)) / len(y)
            k = gain.argmax()
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[ok[k]] + v[ok[k] + 1]) / 2))
        if best[1] < 0:
            return me
        side = x[:, best[1]] <= best[2]
        nodes[me][:2] = best[1:]
        nodes[me][2] = self._grow(nodes, x[side], y[side], depth - 1, leaf, rng)
        nodes[me][3] = self._grow(nodes, x[~side], y[~side], depth - 1, leaf, rng)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(TREE_DEPTH + 1):
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(goes, t[at, 2], t[at, 3]).astype(np.int64), at)
            total += t[at, 4]
        return total / len(self.trees)


def train(findings: DataFrame | None = None) -> Forest:
    """A forest from labelled findings (candidate, path, before, after, is_secret), or from the generated ones."""
    if findings is None:
        rows = labelled_findings(DICTIONARY)
    else:
        rows = [tuple(r) for r in findings.select("candidate", "path", "before", "after", "is_secret").orderBy(F.xxhash64("candidate", "path", "before", "after")).limit(MAX_FINDINGS).collect()]
    x = np.array([features(c, p or "", b or "", a or "") for c, p, b, a, _ in rows])
    return Forest(x, np.array([float(bool(r[4])) for r in rows]))


def _outermost(spans: list[tuple[int, int, int] | None]) -> list[bool]:
    """Which spans (text, start, end) are there and not inside another of their text."""
    out, last = [False] * len(spans), (-1, 0, 0)
    for x, k in sorted(((x, k) for k, x in enumerate(spans) if x), key=lambda y: (y[0][0], y[0][1], -y[0][2])):
        out[k] = x[0] != last[0] or x[2] > last[2]
        last = x if out[k] else last
    return out


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each finding, as in RESULT."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def each(batches):
        for batch in batches:
            data, offsets = tb.column_bytes(batch.column(1))
            ids, paths = batch.column(0).to_pylist(), batch.column(2)
            found, rows = [], []
            for i, j in tb.chunks(offsets):
                raw, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                whole = raw.tobytes()
                for a, b in found_in(raw, own):
                    d = int(np.searchsorted(own, a, side="right")) - 1
                    lo, hi = int(own[d]), int(own[d + 1])
                    if b > hi:
                        continue
                    text = whole[a:b].decode()
                    found.append((i + d, ids[i + d], a - lo, b - a, text))
                    rows.append(features(text, paths[i + d].as_py() or "", whole[max(lo, a - AROUND) : a].decode(errors="ignore"), whole[b : min(hi, b + AROUND)].decode(errors="ignore")))
            score = sent.value.predict(np.array(rows)) if rows else np.zeros(0)
            take = _outermost([(k, a, a + n) if s >= threshold else None for (k, _, a, n, _), s in zip(found, score, strict=True)])
            out = [(doc, a, n, kind_of(text), hashlib.sha256(text.encode()).hexdigest(), float(s)) for (_, doc, a, n, text), s, t in zip(found, score, take, strict=True) if t]
            c = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=["doc_id", "start", "length", "kind", "sha256", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(path_col).cast("string").alias("path")).mapInArrow(each, RESULT)
