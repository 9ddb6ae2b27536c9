"""Secret scans: fixed patterns, and a battery of randomness tests for strings of no known form.

Method: a candidate is a run of at least ``least`` characters ``[A-Za-z0-9+/_=-]``.  Its encoding (digits, hexadecimal, base
32, base 36, letters, alphanumeric, base 64) is inferred from the characters it uses, and three properties are tested:
uniformity of the alphabet (chi-squared), runs, and serial correlation.  Each test is judged twice:

* against *randomness*: chi-squared over eight cells of the encoding's alphabet, the runs test about the alphabet's middle,
  lag-1 serial correlation of the places.  A candidate whose least p-value, times three, is under ``alpha`` isn't random.
* against *text of the same encoding*: chi-squared of its letters is compared with what the letters of the whole corpus would
  give (a noncentral chi-squared), the runs of character classes with the change rate of text (a binomial tail), and the serial
  dependence, the mean log-probability of neighbouring letters under the corpus's letter pairs, with its mean and variance in
  text.  Three times the least of the three is the candidate's p-value.  Pair counts come from a scan of all texts, case
  folded, and are restricted to the encoding's letters.

A second scan counts the p-values by length class (a table of fixed size); in each length class the Benjamini-Hochberg
threshold at false-discovery rate ``q`` follows from the counts, so a longer string, with more evidence and fewer rivals, is
judged by its own class.  The last scan applies the thresholds.  A string of digits alone has neither letters nor changes of
class, so nothing tells it from a number and it isn't reported (the fixed pattern takes digits from 32 on).

Spans are code points of the text, end exclusive.  Spans of the base patterns always stay; a random string that
overlaps one isn't reported again.

Defined cases: null texts count as empty and have no spans; rows without a doc_id keep a null doc_id and are scanned and
redacted like others; repeated rows and rows of one id with other texts are each judged by their own text; an empty table
gives an empty result; extra columns are ignored, and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._words import LOWER, chunks, record_batch, words

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *map(ord, "+/_=-")]] = False
_NOT_HEX = np.ones(256, bool)
_NOT_HEX[[*range(48, 58), *range(97, 103)]] = False

#: Lower ends of the length classes.
LENGTHS = (20, 28, 40, 64, 128)
#: p-values are counted in steps of a quarter of a power of ten.
STEP, BINS = 4, 200
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Of the known encodings, smaller ones first.
_ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _DIGITS + _LOWER, _DIGITS + _UPPER,
    _UPPER + _LOWER, _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
)


def base_spans(text: str, maybe_assign: bool = True, maybe_access: bool = True, maybe_hex: bool = True) -> list[tuple[int, int, str]]:
    found = []
    if maybe_assign:
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if maybe_access:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if maybe_hex:
        found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def alphabet(s: str) -> str:
    """The smallest alphabet of the known encodings that holds every character; padding at the end doesn't count."""
    used = set(s)
    for a in _ALPHABETS:
        if used <= set(a):
            return a
    return _UPPER + _LOWER + _DIGITS + "+/-_="


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of the chi-squared distribution for odd ``df``."""
    term, total = math.sqrt(2 * x / math.pi) * math.exp(-x / 2), 0.0
    for j in range(1, df, 2):
        total += term
        term *= x / (j + 2)
    return min(1.0, math.erfc(math.sqrt(x / 2)) + total)


def battery(s: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for a string's places in its inferred alphabet."""
    s = s.rstrip("=") or s
    a = alphabet(s)
    size, n = len(a), len(s)
    place = np.array([a.index(c) for c in s], float)
    cell = np.bincount((place * 8 // size).astype(int), minlength=8)
    share = np.bincount(np.arange(size) * 8 // size, minlength=8) / size
    uniform = chi2_tail(float((((cell - n * share) ** 2) / (n * share)).sum()), 7)
    high = place >= size / 2
    n1 = int(high.sum())
    n0 = n - n1
    runs_p = 0.0
    if n0 and n1:
        mean = 1 + 2 * n0 * n1 / n
        var = (mean - 1) * (mean - 2) / max(n - 1, 1)
        runs_p = math.erfc(abs(1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(2 * var)) if var > 0 else 1.0
    sd = place.std()
    serial = 0.0
    if sd > 0:
        c = place - place.mean()
        serial = math.erfc(abs(float((c[1:] * c[:-1]).sum() / (c * c).sum())) * math.sqrt(n / 2))
    return uniform, runs_p, serial


def changes_tail(n: int, x: int, rate: float) -> float:
    """How likely ``n`` places in text with this rate of class changes have ``x`` or more: an upper binomial tail."""
    if not x:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate) for i in range(x, n + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(v - top) for v in logs))


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


class TextModel:
    """What text looks like in each encoding, from the corpus's counts of neighbouring letters (case folded, 26 x 26)."""

    def __init__(self, pairs: np.ndarray, rate: float = 0.12, spread: float = 2.0) -> None:
        self.pairs, self.rate, self.spread = pairs.reshape(26, 26).astype(float) + 0.5, rate, spread
        self.known: dict[str, tuple] = {}

    def _of(self, letters: str) -> tuple:
        """For the letters of an encoding: log-probabilities of pairs, their mean and variance, and the chi-squared shift."""
        if letters not in self.known:
            at = np.array([ord(c) - 97 for c in letters])
            sub = self.pairs[np.ix_(at, at)]
            joint = sub / sub.sum()
            logs = np.full((26, 26), 0.0)
            logs[np.ix_(at, at)] = np.log(sub / sub.sum(1, keepdims=True))
            own = logs[np.ix_(at, at)]
            mean = float((joint * own).sum())
            share = joint.sum(0)
            shift = float(len(at) * (share * share).sum() - 1)
            self.known[letters] = logs, mean, float((joint * own * own).sum() - mean * mean), shift
        return self.known[letters]

    def p_value(self, s: str) -> float:
        """Three times the least of the tests' p-values for text of the inferred encoding; ``spread`` widens the variance of pairs."""
        s = s.rstrip("=") or s
        letters = "".join(sorted({c for c in alphabet(s).lower() if "a" <= c <= "z"}))
        kind = np.array([0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in s])
        low = np.array([ord(c) - 97 if k in (1, 2) else -1 for c, k in zip(s.lower(), kind.tolist(), strict=True)])
        mixed = len({0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in alphabet(s)}) > 1
        found = [changes_tail(len(s) - 1, int((kind[1:] != kind[:-1]).sum()), self.rate)] if mixed else []
        if len(letters) > 1:
            logs, mean, var, shift = self._of(letters)
            both = (low[1:] >= 0) & (low[:-1] >= 0) & (kind[1:] == kind[:-1])
            n = int(both.sum())
            if n:
                z = (logs[low[:-1][both], low[1:][both]].sum() - n * mean) / math.sqrt(self.spread * n * var)
                found.append(_normal_tail(float(z)))
            own = low[low >= 0]
            if len(own) > 1:
                share = len(own) / len(letters)
                count = np.bincount(own, minlength=26)[[ord(c) - 97 for c in letters]]
                x, df, more = float(((count - share) ** 2 / share).sum()), len(letters) - 1, len(own) * shift
                found.append(_normal_tail((x - df - more) / math.sqrt(2 * (df + 2 * more))))
        return min(1.0, 3 * min(found, default=1.0))


def judge(s: str, alpha: float, text: TextModel) -> tuple[int, int] | None:
    """Length class and bin of the text p-value; None if the battery rejects randomness."""
    if 3 * min(battery(s)) < alpha:
        return None
    bin_ = min(BINS - 1, int(-math.log10(max(text.p_value(s), 1e-60)) * STEP))
    return max(i for i, n in enumerate(LENGTHS) if len(s) >= n), bin_


def thresholds(counts: dict[tuple[int, int], int], totals: dict[int, int], q: float) -> list[int]:
    """Per length class the least bin that is reported: the largest p with p * m / (number at p or under) <= q."""
    out = []
    for c in range(len(LENGTHS)):
        below, found = 0, BINS
        for b in range(BINS - 1, -1, -1):
            below += counts.get((c, b), 0)
            if below and 10 ** (-b / STEP) * totals.get(c, 0) / below <= q:
                found = b
        out.append(found)
    return out


def _candidates(raw: bytes, buf: np.ndarray, offs: np.ndarray, least: int):
    """Text, byte range and string of each run."""
    w = words(buf, offs, _OUTSIDE, hashes=False)
    at = np.flatnonzero(w.end - w.start >= least)
    doc = np.searchsorted(w.first, at, "right") - 1
    for d, s, e in zip(doc.tolist(), w.start[at].tolist(), w.end[at].tolist(), strict=True):
        yield d, s, e, raw[s:e].decode()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ASCII letters of all texts, case folded: a table of 676 counts."""
    schema = pa.schema([("pair", pa.int32()), ("n", pa.int64())])
    total = np.zeros(677, np.int64)
    for b in batches:
        for _, _, buf, offs in chunks(b):
            low = LOWER[buf]
            code = low - np.uint8(97)
            code = np.where(code < 26, code, np.uint8(255)).astype(np.int16)
            pair = np.where((code[:-1] < 26) & (code[1:] < 26), code[:-1] * 26 + code[1:], 676)
            edge = offs[1:-1]
            pair[edge[(edge > 0) & (edge < len(buf))] - 1] = 676  # not across two texts
            total += np.bincount(pair, minlength=677)
    at = np.flatnonzero(total[:676])
    yield record_batch(schema, pair=at.astype(np.int32), n=total[at])


def _count(least: int, alpha: float, model: TextModel):
    schema = pa.schema([("length_class", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for b in batches:
            for _, _, buf, offs in chunks(b):
                for _, _, _, s in _candidates(buf.tobytes(), buf, offs, least):
                    c = max(i for i, n in enumerate(LENGTHS) if len(s) >= n)
                    got = judge(s, alpha, model) or (c, -1)
                    seen[got] = seen.get(got, 0) + 1
        yield record_batch(schema, length_class=[k[0] for k in seen], bin=[k[1] for k in seen], n=list(seen.values()))

    return run


class Scanner:
    """Finds the spans of texts; what it holds is of fixed size."""

    def __init__(self, model: TextModel, cut: list[int], least: int, alpha: float) -> None:
        self.model, self.cut, self.least, self.alpha = model, cut, least, alpha

    def spans(self, buf: np.ndarray, offs: np.ndarray) -> Iterator[list[tuple[int, int, str]]]:
        """Per text of a chunk: (start, end, kind), by start and then kind."""
        raw = buf.tobytes()
        extra: dict[int, list[tuple[int, int]]] = {}
        for d, s, e, x in _candidates(raw, buf, offs, self.least):
            if (got := judge(x, self.alpha, self.model)) and got[1] >= self.cut[got[0]]:
                extra.setdefault(d, []).append((s, e))
        hexes = words(buf, offs, _NOT_HEX, hashes=False)
        at = np.flatnonzero(hexes.end - hexes.start >= 32)
        with_hex = set((np.searchsorted(hexes.first, at, "right") - 1).tolist())
        for i, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
            own = raw[s:e]
            low = own.lower()
            checks = any(k in low for k in _KEYS), b"AKIA" in own, i in with_hex
            found = base_spans(own.decode(), *checks) if any(checks) else []
            base = len(found)
            for x, y in extra.get(i, ()):
                first = len(raw[s:x].decode())
                x, y = first, first + y - x  # a run is ASCII
                if all(y <= f[0] or x >= f[1] for f in found[:base]):
                    found.append((x, y, "random"))
            found.sort(key=lambda f: (f[0], KINDS.index(f[2])))
            yield found


def prepare(docs: DataFrame, text: str = "text", least: int = 20, alpha: float = 0.001, rate: float = 0.12, q: float = 1e-3) -> Scanner:
    """The corpus's text model and thresholds, from two scans of all texts; only tables of fixed size are collected."""
    own = docs.select(F.col(text).cast("string").alias("text"))
    pairs = np.zeros(676, np.int64)
    for r in own.mapInArrow(_pairs, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    model = TextModel(pairs, rate)
    rows = own.mapInArrow(_count(least, alpha, model), "length_class int, bin int, n long").groupBy("length_class", "bin").agg(F.sum("n").alias("n")).collect()
    counts = {(r["length_class"], r["bin"]): r["n"] for r in rows if r["bin"] >= 0}
    totals = {c: sum(r["n"] for r in rows if r["length_class"] == c) for c in range(len(LENGTHS))}
    return Scanner(model, thresholds(counts, totals, q), least, alpha)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per row: doc_id and the spans found (starts, ends, kinds), by start and then kind; options go to ``prepare``."""
    scanner = prepare(docs, text, **options)
    schema = pa.schema([("doc_id", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in chunks(b):
                found = list(scanner.spans(buf, offs))
                starts, ends, kinds = ([[f[k] for f in own] for own in found] for k in range(3))
                yield record_batch(schema, doc_id=b.column(0).slice(lo, hi - lo), starts=starts, ends=ends, kinds=kinds)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, starts array<long>, ends array<long>, kinds array<string>")


def digest(spans: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' digest, and all spans as text."""
    joined = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda s: F.concat_ws(":", s["kinds"], s["starts"], s["ends"]))
    base = F.filter(joined, lambda s: ~s.startswith("random:"))
    n = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    return spans.select("doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join(joined, ",").alias("spans"), n("random").alias("n_random"))


def _masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    parts, at = [], 0
    for x, y, _ in spans:
        if x >= at:
            parts += [text[at:x], mark]
        at = max(at, y)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", **options) -> DataFrame:
    """``docs`` with every span replaced by ``mark``, in the pass that scans; nothing is joined or shuffled, other columns stay."""
    scanner = prepare(docs, text, **options)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(place)
            out: list[pa.Array] = []
            for lo, hi, buf, offs in chunks(pa.RecordBatch.from_arrays([own], ["text"])):
                part = own.slice(lo, hi - lo)
                found = {i: f for i, f in enumerate(scanner.spans(buf, offs)) if f}
                if found:
                    part = pa.array([_masked(t.as_py(), found[i], mark) if i in found else t.as_py() for i, t in enumerate(part)], own.type)
                out.append(part)
            columns = list(b.columns)
            columns[place] = pa.concat_arrays(out) if out else own
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
