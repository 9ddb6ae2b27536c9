"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, one scan of the texts.

Method: texts and items are reduced to words (ASCII letters in lower case, digits, everything beyond ASCII), and an item's
words to numbers.  The automaton's patterns are *anchors*: of an item of ``window`` words or more, the runs of
(window + 1) // 2 words at every such distance.  Each window holds a whole anchor, so no occurrence is missed, and a word of
an item costs one node instead of ``window``.  A shorter item is a pattern as a whole.  Where an anchor ends in a text, the
match is extended word by word to both sides; from ``window`` words on it is a run of windows, and all its words are hit.  On
request, ranges of words are mapped to code points of the original text.

Items are dealt into blocks of at most ``block_nodes`` anchor words, so that an automaton's size is bounded (some 80 bytes
a node).  With one block, the usual case, each worker builds the automaton once.  With more, a task holds ``hold`` bytes
of texts at a time and takes the blocks' automata in turn: the texts are read once, and a row stays a row.

Defined cases: null or empty texts and items have no words and no hits; repeated items count by their id once; rows
without an id take no part; repeated rows, and rows of one id with other texts, are each judged by themselves; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import texts
from kinfold.llm._words import LOWER, PUNCT, record_batch

_TABLE = bytes(0x20 if PUNCT[b] and not 65 <= b < 91 else int(LOWER[b]) for b in range(256))
_READY: dict[str, Automaton] = {}


def normalise(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Automaton:
    """The anchors of a block of items."""

    def __init__(self, items: list[tuple[int, str | None]], window: int) -> None:
        import ahocorasick

        self.window, self.number, self.items = window, {}, []
        self.step = step = (window + 1) // 2
        patterns: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for item, text in items:
            w = tuple(self.number.setdefault(x, len(self.number) + 1) for x in normalise(text))
            own = [(0, len(w))] if len(w) < window else [(p, step) for p in range(0, len(w) - step + 1, step)]
            for p, n in own if w else ():
                patterns.setdefault(w[p : p + n], []).append((len(self.items), p))
            self.items.append((item, w))
        self.find = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for p, places in patterns.items():
            self.find.add_word(p, (len(p), places))
        if patterns:
            self.find.make_automaton()
        self.empty = not patterns

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of a text's words, and the items with an occurring window."""
        if self.empty or not words:
            return [], set()
        get = self.number.get
        ids = tuple([get(x, 0) for x in words])
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        reached: dict[tuple[int, int], int] = {}  # per item and diagonal: where the last run ended
        for last, (n, places) in self.find.iter(ids):
            first = last - n + 1
            for k, p in places:
                item, w = self.items[k]
                if len(w) < self.window:
                    spans.append((first, last + 1))
                    found.add(item)
                    continue
                way = (k, first - p)
                if reached.get(way, 0) > last:
                    continue
                lo, i, hi, j = first, p, last + 1, p + n
                while lo and i and ids[lo - 1] == w[i - 1]:
                    lo, i = lo - 1, i - 1
                while hi < len(ids) and j < len(w) and ids[hi] == w[j]:
                    hi, j = hi + 1, j + 1
                reached[way] = hi
                if hi - lo >= self.window:
                    spans.append((lo, hi))
                    found.add(item)
        return spans, found


def _automaton(shared, block: int) -> Automaton:
    """One at a time in each worker."""
    key = f"{shared.value['key']}-{block}"
    if key not in _READY:
        _READY.clear()
        _READY[key] = Automaton(shared.value["blocks"][block], shared.value["window"])
    return _READY[key]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_FOUND = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, los array<long>, his array<long>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("los", pa.list_(pa.int64())), ("his", pa.list_(pa.int64()))])


def _held(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[list[pa.RecordBatch]]:
    group, size = [], 0
    for b in batches:
        group.append(b)
        size += b.nbytes
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def _judge(shared, text: int, hold: int):
    """Spans and items of each row of some batches."""
    blocks = len(shared.value["blocks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for group in _held(batches, hold) if blocks > 1 else ([b] for b in batches):
            got = [[[0, [], set()] for _ in range(b.num_rows)] for b in group]
            for k in range(blocks):
                a = _automaton(shared, k)
                for b, rows in zip(group, got, strict=True):
                    for row, t in zip(rows, b.column(text), strict=True):
                        w = normalise(t.as_py())
                        spans, items = a.scan(w)
                        row[0] = len(w)
                        row[1] += spans
                        row[2] |= items
            yield from zip(group, got, strict=True)

    return run


def _scan(shared, hold: int):
    judge = _judge(shared, 1, hold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in judge(batches):
            out: dict[str, list] = {f.name: [] for f in _SCHEMA}
            for d, (n, spans, items) in zip(b.column(0).to_pylist(), rows, strict=True):
                spans = _merged(spans)
                ids = sorted(map(str, items))
                hit = sum(hi - lo for lo, hi in spans)
                for c, v in zip(out, (d, n, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, [x for x, _ in spans], [x for _, x in spans]), strict=True):
                    out[c].append(v)
            yield record_batch(_SCHEMA, **out)

    return run


def _share(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, window: int, block_nodes: int):
    """The items in blocks, broadcast as texts; a word has a byte and a gap at least, so bytes / 2 bounds the nodes."""
    items = texts(benchmark, item, item_text).distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // (2 * block_nodes)))
    if size > 1 << 30:
        raise ValueError(f"the benchmark has {size} bytes of text; more than 1 GB isn't sent to the executors")
    dealt = items.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    out: list[list] = [[] for _ in range(blocks)]
    for r in dealt.toLocalIterator():
        out[r["block"]].append((r["doc_id"], r["text"]))
    return docs.sparkSession.sparkContext.broadcast({"key": uuid.uuid4().hex, "window": window, "blocks": out})


def find_benchmark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_nodes: int = 4 << 20, hold: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the hit ranges of words (los, his)."""
    shared = _share(docs, benchmark, item, item_text, window, block_nodes)
    return texts(docs, key, text).mapInArrow(_scan(shared, hold), _FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = 10, block_nodes: int = 4 << 20, hold: int = 64 << 20) -> DataFrame:
    """The rows of ``docs`` without a hit, as they are, from the one scan: nothing is joined or shuffled."""
    shared = _share(docs, benchmark, item, item_text, window, block_nodes)
    judge = _judge(shared, docs.columns.index(text), hold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in judge(batches):
            keep = pa.array([not spans for _, spans, _ in rows], pa.bool_())
            yield b.filter(keep)

    return docs.mapInArrow(run, docs.schema)


def original_offsets(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of the original text for ranges of its words."""
    raw = text.encode().translate(_TABLE)
    ranges, at = [], 0
    for w in raw.split():
        at = raw.index(w, at)
        ranges.append((at, at + len(w)))
        at += len(w)
    whole = text.encode()
    return [(len(whole[: ranges[lo][0]].decode()), len(whole[: ranges[hi - 1][1]].decode())) for lo, hi in spans]
