"""Language-model scoring by Katz backoff: Good-Turing discounted bigrams over Good-Turing unigrams.

P(w | v) = d(c) c(v w) / c(v) where the bigram was seen, else alpha(v) P(w); d is Katz's Good-Turing discount for counts
to ``top``, and alpha(v) is the mass the discounts left divided by the unigram mass of the words not seen after v, so each
distribution sums to one exactly.  P(w) is discounted likewise, and what that leaves is the unknown word's.

Texts are cut into blocks of some 10 MB, which keep their words once as 64-bit hashes and their tokens as indexes.  A block
is named by the task that cut it and its place there, so equal texts in other blocks stay apart.  The counts live in tables
partitioned by ranges of the hash.  A block asks each part for what it needs, once per distinct word or bigram, in sorted
order (the differences of sorted hashes take few bytes), and the request carries the block's own training counts, so counting
and looking up share one exchange and a hot word costs one entry per block.  A bigram is owned by the first block that trains on it; owners sum the discounted and the
unigram mass per context, a second exchange adds these up and returns alpha.  Every token is then evaluated in its block.

Parts hold about ``part_rows`` entries whatever the input's size; only counts of counts reach the driver.

Defined cases: null and empty texts are one end token; rows without a doc_id take no part; repeated rows count and are
scored each; without training rows every token is unknown with probability one; a context whose followers leave no mass
gives up 1 / (c + 1); extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import crc_mod, partitions, sized, stored
from kinfold.llm._words import SPACE, chunks, mix, record_batch, seeds, trim, words

_END, _BEGIN, _L, _R = seeds(4, 31337)
WORD, PAIR, BACK = 0, 1, 2


def _zip(a: np.ndarray, kind: str = "<i8") -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a, kind).tobytes())


def _unzip(b: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), kind)


def _zip_counts(a: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs, one plane of bytes after the other; the first byte says how many."""
    width = max(1, -(-int(a.max(initial=0)).bit_length() // 8))
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip_counts(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[1:]), np.uint8).reshape(b[0], -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, : b[0]] = planes.T
    return wide.view("<i8").ravel()


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and each one's number, as np.unique, but with half the memory."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    at = np.empty(len(key), np.int32)
    at[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    del order
    return key[new], at


_BLOCK = "block long, docs binary, train binary, sizes binary, vocabulary binary, tokens binary, n_words long"


def _grouped(batches: Iterator[pa.RecordBatch], most: int = 10 << 20) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, to about ``most`` bytes: fewer blocks ask for less twice."""
    group, size = [], 0
    for b in batches:
        if b.num_rows:
            group.append(b)
            size += b.nbytes
            if size >= most:
                yield group
                group, size = [], 0
    if group:
        yield group


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens are indexes into the block's words, an end token after each text's."""
    schema = pa.schema([("block", pa.int64()), *((n, pa.binary()) for n in ("docs", "train", "sizes", "vocabulary", "tokens")), ("n_words", pa.int64())])
    task = TaskContext.get().partitionId()
    for number, group in enumerate(_grouped(batches)):
        name = int(mix(np.array([(task << 32) + number], np.uint64))[0].view(np.int64))
        ids, train = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in group]) for i in (0, 2))
        hs, ns = [], []
        for b in group:
            for _, _, buf, offs in chunks(b):
                w = words(buf, offs, SPACE, lower=True)
                hs.append(np.insert(w.hash, w.first[1:], _END))
                ns.append(np.diff(w.first))
        del group
        n = np.concatenate(ns)
        h = np.concatenate(hs)
        del hs
        vocabulary, tokens = _distinct(h)
        del h
        common = np.argsort(-np.bincount(tokens), kind="stable")  # common words get small numbers, which take less room
        vocabulary, place = vocabulary[common], np.empty(len(common), np.int32)
        place[common] = np.arange(len(common), dtype=np.int32)
        tokens = place[tokens]
        row = {"docs": _zip(ids), "train": train.astype(np.uint8).tobytes(), "sizes": _zip(n + 1), "vocabulary": vocabulary.astype("<u8").tobytes(), "tokens": _zip_counts(tokens)}
        yield record_batch(schema, block=[name], n_words=[len(vocabulary)], **{k: pa.array([v], pa.binary()) for k, v in row.items()})


class _Block:
    """A block unpacked: words, tokens, which of them train, and the distinct bigrams (context, word)."""

    def __init__(self, row: dict) -> None:
        self.docs, self.sizes = _unzip(row["docs"]), _unzip(row["sizes"])
        self.train = np.frombuffer(row["train"], np.uint8)
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.tokens = _unzip_counts(row["tokens"]).astype(np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        v = len(self.vocabulary)
        key = np.empty(len(self.tokens), np.int64)  # context and word; memory is what counts here, so nothing is kept twice
        key[1:] = self.tokens[:-1]
        key[self.first] = v  # the begin of a text is a context of its own
        key *= v + 1
        key += self.tokens
        key, self.pair = _distinct(key)
        self.context = (key // (v + 1)).astype(np.int32)
        self.word = (key % (v + 1)).astype(np.int32)
        del key
        self.contexts = np.append(self.vocabulary, _BEGIN)
        with np.errstate(over="ignore"):
            h = self.contexts[self.context]
            h *= _L | np.uint64(1)
            h += self.vocabulary[self.word] * (_R | np.uint64(1))
        self.pair_hash = mix(h)

    def counts(self, at: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(at[np.repeat(self.train, self.sizes).astype(bool)], minlength=size)


def _bounds(parts: int) -> np.ndarray:
    """Least hash of each part; parts are equal ranges."""
    return np.array([-(-(p << 64) // parts) for p in range(parts)], np.uint64)


def _deal(h: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of requests by hash, and where each part begins."""
    order = np.argsort(h)
    return order, np.append(np.searchsorted(h[order], _bounds(parts)), len(h))


_ASK = "kind int, part long, block long, keys binary, a binary, b binary"
_ASK_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
#: Low bits of a hash that requests leave out: bigrams are told apart by 56 bits.
_LEFT_OUT = {WORD: 0, PAIR: 8, BACK: 0}


def _write_keys(h: np.ndarray, least: np.uint64, kind: int) -> bytes:
    """Differences of a part's sorted hashes, in as many bytes as the largest one needs; the first byte says how many."""
    d = (h - least) >> np.uint64(_LEFT_OUT[kind])
    d[1:] -= d[:-1].copy()
    width = max(1, -(-int(d.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _read_keys(b: bytes) -> np.ndarray:
    width = b[0]
    wide = np.zeros(((len(b) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(b, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _ask(kind: int, block: int, h: np.ndarray, parts: int, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    order, cut = _deal(h, parts)
    h, a = h[order], a[order]
    b = b[order] if b is not None else None
    used = np.flatnonzero(np.diff(cut))
    least = _bounds(parts)
    each = [slice(cut[p], cut[p + 1]) for p in used]
    first = [_zip(a[s], "<f8") if kind == BACK else _zip_counts(a[s]) for s in each]
    second = [_zip(b[s], "<f8") if b is not None else None for s in each]
    keys = [_write_keys(h[s], least[p], kind) for p, s in zip(used, each, strict=True)]
    return record_batch(_ASK_SCHEMA, kind=np.full(len(used), kind, np.int32), part=used, block=np.full(len(used), block), keys=keys, a=first, b=second)


def _requests(word_parts: int, pair_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                x = _Block(row)
                yield _ask(WORD, row["block"], x.vocabulary, word_parts, x.counts(x.tokens, len(x.vocabulary)))
                yield _ask(PAIR, row["block"], x.pair_hash, pair_parts, x.counts(x.pair, len(x.context)))
                del x, row
                trim()

    return run


_REPLY = "kind int, part long, block long, a binary, b binary, stats array<long>"
_REPLY_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("stats", pa.list_(pa.int64()))])


def _count(top: int):
    """Of one part: each request's total counts, which entries it owns, and the counts of counts (in a row without a block)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        kind, part = t["kind"][0].as_py(), t["part"][0].as_py()
        keys = [_read_keys(k) for k in t["keys"].to_pylist()]
        own = np.concatenate([_unzip_counts(a) for a in t["a"].to_pylist()])
        sizes = np.array([len(k) for k in keys])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(int(at.max()) + 1, np.int64)
        np.add.at(total, at, own)
        owner = np.full(len(total), len(at))
        trained = np.flatnonzero(own > 0)
        np.minimum.at(owner, at[trained], trained)
        owns = np.zeros(len(at), np.uint8)
        owns[owner[owner < len(at)]] = 1
        cut = np.cumsum(sizes)[:-1]
        seen = total[total > 0]
        stats = [int(seen.sum()), len(seen), *(int((seen == r).sum()) for r in range(1, top + 2))]
        n = len(keys)
        return pa.table({
            "kind": pa.array([kind] * (n + 1), pa.int32()), "part": pa.array([part] * (n + 1), pa.int64()), "block": pa.array([*t["block"].to_pylist(), None], pa.int64()),
            "a": pa.array([*(_zip_counts(x) for x in np.split(total[at], cut)), None], pa.binary()), "b": pa.array([*(_zip(np.packbits(x), "u1") for x in np.split(owns, cut)), None], pa.binary()),
            "stats": pa.array([*[None] * n, stats], pa.list_(pa.int64())),
        })

    return run


def discounts(counts_of_counts: list[int], top: int) -> np.ndarray:
    """d[c] for c = 0..top (d[0] unused), 1 beyond: Katz's form of Good-Turing; (c - 1/2) / c where the counts allow none."""
    n = [0, *counts_of_counts]
    d = np.array([1.0, *((r - 0.5) / r for r in range(1, top + 1))])
    common = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0
    if common < 1:
        for r in range(1, top + 1):
            if n[r] and n[r + 1]:
                x = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
                if 0 < x < 1:
                    d[r] = x
    return d


class Model:
    """The small part of the model: totals and discounts."""

    def __init__(self, words_: list[int], pairs: list[int], top: int) -> None:
        self.top, self.total, self.distinct = top, words_[0], words_[1]
        self.word_d, self.pair_d = discounts(words_[2:], top), discounts(pairs[2:], top)
        taken = sum(self.word_d[r] * r * words_[1 + r] for r in range(1, top + 1)) + self.total - sum(r * words_[1 + r] for r in range(1, top + 1))
        self.unknown = 1 - taken / self.total if self.total else 1.0
        self.plain = self.unknown < 1e-12  # nothing left for the unknown word: one is added to each count
        if self.plain:
            self.unknown = 1 / (self.total + self.distinct + 1)

    def held(self, c: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return np.where(c <= self.top, d[np.minimum(c, self.top)], 1.0) * c

    def unigram(self, c: np.ndarray) -> np.ndarray:
        seen = (c + 1) / (self.total + self.distinct + 1) if self.plain else self.held(c, self.word_d) / max(self.total, 1)
        return np.where(c > 0, seen, self.unknown)


def _answers(replies: dict[tuple[int, int], dict], kind: int, h: np.ndarray, parts: int, column: str, dtype: str) -> np.ndarray:
    """What the parts replied, in the order of ``h``."""
    order, cut = _deal(h, parts)
    out = np.zeros(len(h), dtype)
    for p in np.flatnonzero(np.diff(cut)).tolist():
        raw, n = replies[kind, p][column].as_buffer(), cut[p + 1] - cut[p]
        got = _unzip(raw, dtype) if dtype != "<i8" and dtype != "?" else _unzip_counts(raw.to_pybytes()) if dtype == "<i8" else np.unpackbits(_unzip(raw, "u1"), count=n)
        out[order[cut[p] : cut[p + 1]]] = got
    return out


def _replies(t: pa.Table) -> dict[tuple[int, int], dict]:
    return {(k, p): {"a": a, "b": b} for k, p, a, b in zip(*(t[c].to_pylist() for c in ("kind", "part")), *(t[c] for c in ("a", "b")), strict=True)}


def _masses(m: Model, word_parts: int, pair_parts: int):
    """Per context of a block: the discounted count and the unigram mass of the bigrams it owns."""

    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        got = _replies(replies)
        out = []
        for row in block.to_pylist():
            x = _Block(row)
            c = _answers(got, WORD, x.vocabulary, word_parts, "a", "<i8")
            pc = _answers(got, PAIR, x.pair_hash, pair_parts, "a", "<i8")
            owns = _answers(got, PAIR, x.pair_hash, pair_parts, "b", "?")
            n = len(x.contexts)
            at = x.context[owns]
            mass = np.bincount(at, m.held(pc[owns], m.pair_d), n)
            seen = np.bincount(at, m.unigram(c)[x.word[owns]], n)
            known = np.append(c > 0, True)  # others have nothing to give up
            out.append(_ask(BACK, row["block"], x.contexts[known], word_parts, mass[known], seen[known]))
            del x, c, pc, owns, at
            trim()
        return pa.Table.from_batches(out, _ASK_SCHEMA)

    return run


def _alphas(t: pa.Table) -> pa.Table:
    """Of one part: summed masses by context, returned to every block that asked (b: discounted count, a: unigram mass)."""
    t = t.sort_by("block")
    keys = [_read_keys(k) for k in t["keys"].to_pylist()]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = int(at.max()) + 1
    mass, seen = (np.bincount(at, np.concatenate([_unzip(v, "<f8") for v in t[c].to_pylist()]), n)[at] for c in ("a", "b"))
    cut = np.cumsum([len(k) for k in keys])[:-1]
    r = len(keys)
    return pa.table({"kind": t["kind"], "part": t["part"], "block": t["block"], "a": pa.array([_zip(v, "<f8") for v in np.split(mass, cut)], pa.binary()), "b": pa.array([_zip(v, "<f8") for v in np.split(seen, cut)], pa.binary()), "stats": pa.nulls(r, pa.list_(pa.int64()))})


_SCORE = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(m: Model, word_parts: int, pair_parts: int, train_docs: int):
    def run(block: pa.Table, replies: pa.Table) -> pa.Table:
        got = _replies(replies)
        out = []
        for row in block.to_pylist():
            x = _Block(row)
            c = _answers(got, WORD, x.vocabulary, word_parts, "a", "<i8")
            pc = _answers(got, PAIR, x.pair_hash, pair_parts, "a", "<i8")
            known, mass, seen = np.append(c > 0, True), *np.zeros((2, len(x.contexts)))
            mass[known] = _answers(got, BACK, x.contexts[known], word_parts, "a", "<f8")
            seen[known] = _answers(got, BACK, x.contexts[known], word_parts, "b", "<f8")
            total = np.append(c, train_docs).astype(float)  # every word is followed by one token
            left = total - mass
            short = left < 1e-9 * np.maximum(total, 1)
            left, total = np.where(short, 1.0, left), np.where(short, total + 1, total)
            alpha = np.where(np.append(c, train_docs) > 0, left / np.maximum(total, 1e-300) / np.maximum(1 - seen, 1e-15), 1.0)
            low = m.unigram(c)
            p = np.empty(len(pc))
            for s in range(0, len(pc), 1 << 17):  # few values at a time
                part = slice(s, s + (1 << 17))
                v, n = x.context[part], pc[part]
                p[part] = np.log10(np.where(n > 0, m.held(n, m.pair_d) / np.maximum(total[v], 1e-300), alpha[v] * low[x.word[part]]))
            del pc
            base = np.log10((c + 1) / (m.total + m.distinct + 1))
            hits = (c > 0).astype(np.int64)
            sums = [np.add.reduceat(v[at], x.first) for v, at in ((hits, x.tokens), (base, x.tokens), (p, x.pair))]
            out.append(pa.table({"doc_id": x.docs, "n_tokens": x.sizes, "n_known": sums[0], "train_tokens": np.full(len(x.docs), m.total), "base_score": sums[1], "score": sums[2]}))
            del x, p, sums
            trim()
        schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
        return pa.concat_tables(out).cast(schema) if out else schema.empty_table()

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2, top: int = 5, part_rows: int = 600_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities)."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    many, train_docs = docs.agg(F.count("*"), F.count_if(crc_mod("doc_id", folds) != held_out)).first()
    rows = sized(docs, many).select("doc_id", "text", (crc_mod("doc_id", folds) != held_out).alias("train"))
    blocks = stored(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    size = blocks.agg(F.sum("n_words").alias("n"), F.sum(F.octet_length("tokens")).alias("m")).first()
    spread = partitions(docs.sparkSession)
    word_parts = max(spread, -(-int(size["n"] or 0) // part_rows))
    pair_parts = max(spread, -(-int(size["m"] or 0) // part_rows))  # a token takes about two bytes
    asked = blocks.mapInArrow(_requests(word_parts, pair_parts), _ASK)
    replies = stored(asked.groupBy("kind", "part").applyInArrow(_count(top), _REPLY), "counts")
    stats = {r["kind"]: [r[f"s{i}"] for i in range(top + 3)] for r in replies.where("block is null").groupBy("kind").agg(*(F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(top + 3))).collect()}
    none = [0] * (top + 3)
    m = Model(stats.get(WORD, none), stats.get(PAIR, none), top)
    counts = replies.where("block is not null")
    back = blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_masses(m, word_parts, pair_parts), _ASK)
    alphas = back.groupBy("kind", "part").applyInArrow(_alphas, _REPLY)
    scored = blocks.groupBy("block").cogroup(counts.unionByName(alphas).groupBy("block")).applyInArrow(_score(m, word_parts, pair_parts, train_docs), _SCORE)
    return scored.select("doc_id", (crc_mod("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
