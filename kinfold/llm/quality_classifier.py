"""Quality classifier: histogram gradient-boosted trees over statistics of a document's text.

Method: every text becomes ``len(FEATURES)`` numbers (shares of byte classes, lengths and repetition of words and
lines).  A bounded sample of labelled rows (``max_rows``, the rows whose hashed id is least) is turned into features on
the executors and binned by quantiles; trees grow level by level from gradient and hessian histograms.  The trees are
flattened into arrays (feature, threshold, children, value), and scoring walks all rows of a batch through them with
numpy, one level at a time: a single scan without a shuffle.

Defined cases: null and empty texts have all-zero features and get the score these features lead to; without labels,
or with one class only, every score is the share of label 1 (0.5 without any); rows without a doc_id are left out of
training and scored like others; several labels of one document count as the least one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import crc_mod, texts
from kinfold.llm._words import SPACE, chunks, lists, mix, record_batch, words

SYMBOLS = "!|%#$&*.,?:;\"'<>{}()[]/\\_-@=+~^`"
_CLASS = np.full(256, 4 + len(SYMBOLS) + 1, np.uint8)  # the last class: control characters
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[ord(c) for c in SYMBOLS]] = np.arange(4, 4 + len(SYMBOLS))
_CLASS[[9, 10, 11, 12, 13, 32]] = 4 + len(SYMBOLS)
CLASSES = 4 + len(SYMBOLS) + 2

FEATURES = [f"share_{i}" for i in range(CLASSES)] + ["symbols", "log_words", "mean_length", "sd_length", "max_length", "short_words", "distinct_words", "commonest_word", "same_as_last", "distinct_pairs", "caps_words", "symbol_ends", "log_lines", "line_length", "distinct_lines", "words_a_line"]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and how often the commonest occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    with np.errstate(over="ignore"):
        key = mix(h + mix(doc.astype(np.uint64) + np.uint64(99)))
    _, at, count = np.unique(key, return_index=True, return_counts=True)
    most = np.zeros(n)
    np.maximum.at(most, doc[at], count)
    return np.bincount(doc[at], minlength=n).astype(float), most


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(offs) - 1
    size = np.diff(offs)
    owner = np.repeat(np.arange(n), size)
    kind = _CLASS[buf]
    share = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES) / np.maximum(size, 1)[:, None]
    w = words(buf, offs, SPACE)
    doc, m = w.doc, np.diff(w.first)
    per = np.maximum(m, 1)
    length = (w.end - w.start).astype(float)
    total = np.bincount(doc, length, n)
    mean = total / per
    sd = np.sqrt(np.maximum(np.bincount(doc, length * length, n) / per - mean * mean, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    distinct, most = _distinct(doc, w.hash, n)
    same = np.zeros(len(doc))
    pair = np.zeros(0, np.uint64)
    inner = np.zeros(0, bool)
    if len(doc) > 1:
        inner = doc[1:] == doc[:-1]
        same[1:] = inner & (w.hash[1:] == w.hash[:-1])
        with np.errstate(over="ignore"):
            pair = (w.hash[:-1] * np.uint64(3) + w.hash[1:])[inner]
    pairs, _ = _distinct(doc[1:][inner] if len(doc) > 1 else doc, pair, n)
    firsts, lasts = kind[w.start] if len(doc) else kind[:0], kind[w.end - 1] if len(doc) else kind[:0]
    caps = (firsts == 0) & (lasts != 1) & (length > 1) if len(doc) else np.zeros(0)
    ends = ((lasts >= 4) & (buf[w.end - 1] != ord(".")) & (buf[w.end - 1] != ord(","))) if len(doc) else np.zeros(0)
    newline = np.ones(256, bool)
    newline[:] = False
    newline[10] = True
    rows = words(buf, offs, newline)
    line_doc, line_n = rows.doc, np.diff(rows.first)
    line_distinct, _ = _distinct(line_doc, rows.hash, n)
    lines = np.maximum(line_n, 1)
    more = [share[:, 4 : 4 + len(SYMBOLS)].sum(1), np.log1p(m), mean, sd, np.log1p(longest), np.bincount(doc, length <= 3, n) / per, distinct / per, most / per, np.bincount(doc, same, n) / per, pairs / np.maximum(m - 1, 1), np.bincount(doc, caps, n) / per, np.bincount(doc, ends, n) / per, np.log1p(line_n), size / lines, line_distinct / lines, m / lines]
    return np.column_stack([share, *more])


class Trees(NamedTuple):
    """Flattened trees: node arrays of shape (trees, nodes); a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        row = np.arange(len(x))
        for f, t, lo, hi, v in zip(self.feature, self.threshold, self.left, self.right, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[row, f[at]] <= t[at], lo[at], hi[at])
            total += v[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 3.0) -> Trees:
    """Boosting with the logistic loss; ``least`` is the smallest hessian sum of a child."""
    nodes = 2 ** (depth + 1) - 1
    share = float(y.mean()) if len(y) else 0.5
    flat = lambda dtype: np.zeros((0, nodes), dtype)
    if not len(y) or share in (0.0, 1.0):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Trees(flat(int), flat(float), flat(int), flat(int), flat(float), float(np.log(p / (1 - p))), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)])
    d = x.shape[1]
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    cell = binned + np.arange(d) * bins
    out = [[], [], [], [], []]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        feature, threshold = np.zeros(nodes, int), np.full(nodes, np.inf)
        left, right, value = np.arange(nodes), np.arange(nodes), np.zeros(nodes)
        at = np.zeros(len(y), int)
        for level in range(depth):
            begin, width = 2**level - 1, 2**level
            live = at >= begin  # rows whose node was split on the level above
            slot = ((at[live] - begin)[:, None] * (d * bins) + cell[live]).ravel()
            hist = [np.bincount(slot, np.repeat(v[live], d), width * d * bins).reshape(width, d, bins) for v in (g, h)]
            gl, hl = (a.cumsum(2) for a in hist)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least) | (ht - hl < least)] = 0
            for k, many in enumerate(cuts):
                gain[:, k, len(many) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for j in range(width):
                node, (f, b) = begin + j, divmod(int(best[j]), bins)
                if gain[j, f, b] > 1e-6:
                    feature[node], threshold[node], left[node], right[node] = f, cuts[f][b], 2 * node + 1, 2 * node + 2
            inner = live & (left[at] != at)
            at[inner] = np.where(x[inner, feature[at[inner]]] <= threshold[at[inner]], left[at[inner]], right[at[inner]])
        gs, hs = np.bincount(at, g, nodes), np.bincount(at, h, nodes)
        value = np.where(left == np.arange(nodes), -rate * gs / (hs + l2), 0)
        total += value[at]
        for a, b in zip(out, (feature, threshold, left, right, value), strict=True):
            a.append(b)
    return Trees(*map(np.array, out), base, depth)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("x", pa.list_(pa.float64()))])
    for b in batches:
        for lo, hi, buf, offs in chunks(b):
            x = features(buf, offs)
            yield record_batch(schema, doc_id=b.column(0).slice(lo, hi - lo), quality=b.column(2).slice(lo, hi - lo), x=lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64()))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held_out: int = 0, max_rows: int = 20_000, **options) -> Trees:
    """Learn from labelled rows outside the held-out fold; at most ``max_rows`` rows are used, chosen by hashed id."""
    docs = texts(docs, key, text)
    chosen = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("quality")).where("doc_id is not null and quality is not null")
    chosen = chosen.where(crc_mod("doc_id", folds) != held_out).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)  # bounded, so it may be broadcast
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(_featured, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    y = rows["quality"].to_numpy().astype(float)
    x = np.array(rows["x"].combine_chunks().flatten() if rows.num_rows else [], float).reshape(len(y), len(FEATURES))
    return fit(x, (y > 0).astype(float), **options)


def score_column(model: Trees, text: str = "text"):
    """A column with the score of each text."""

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            b = pa.RecordBatch.from_arrays([a], ["text"])
            found = [model.score(features(buf, offs)) for _, _, buf, offs in chunks(b)]
            yield pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())

    return score(F.col(text).cast("string"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, as they are; options go to ``train``."""
    return docs.where(score_column(train(docs, labels, key, text, **options), text) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted; options go to ``train``.  Columns of ``docs`` are not returned,
    so none can be taken for a result, whatever its name."""
    model = train(docs, labels, key, text, folds=folds, held_out=held_out, **options)
    out = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = out.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
