"""Best-fit packing: documents become token pieces, a grouping genetic algorithm puts them into sequences.

Method: a text's ids come from a public tokenizer, followed by one end id; only what is longer than ``capacity`` is cut.
A batch's distinct units (words, parted where the tokenizer's own splitting always parts them) are tokenised once and
cached, which gives the same ids; added tokens (such as an end of text) are found first and keep their own ids.  Pieces (no ids, only their lengths and checksums) are written to a table and dealt
by hash into shards of about ``shard`` pieces.  Each shard is solved on several *islands*: a population of groupings,
begun by randomised best-fit decreasing; crossover injects the best-filled bins of one parent into another, drops the
bins that hold the same pieces, and best-fits the displaced ones.  Between epochs each island's best grouping migrates to
the next island.  A shard stops as soon as it reaches the lower bound ceil(total / capacity), and once every island of every shard has,
there is no further epoch.  The last, badly filled bins
of all shards are dissolved and packed once more together.

Defined cases: null and empty texts are one end id; rows without a doc_id take no part; repeated rows give repeated
pieces; ties are broken by doc_id and piece; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import counted, sized, stored, texts
from kinfold.llm._words import LOWER, SPACE, chunks, hash_runs, record_batch

#: Kinds of bytes, after lower-casing: the tokenizer's splitting (letters, single digits, other characters) always parts
#: ASCII letters from ASCII punctuation, but for the apostrophe, and each digit from everything.
_GAP, _LETTER, _MARK, _DIGIT, _OTHER, _ADDED = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _MARK
_KIND[48:58], _KIND[97:123], _KIND[ord("'")], _KIND[SPACE] = _DIGIT, _LETTER, _OTHER, _GAP
_PARTS = np.zeros((6, 6), bool)
_PARTS[_GAP, :] = _PARTS[_DIGIT, :] = _PARTS[:, _DIGIT] = _PARTS[_ADDED, :] = _PARTS[:, _ADDED] = True
_PARTS[_LETTER, _MARK] = _PARTS[_MARK, _LETTER] = True
#: Bytes that no text has; each stands for one of the tokenizer's added tokens.
_SPARE = bytes([*range(0xF5, 0x100)])
_KIND[0xF5:] = _ADDED
#: Letters that stay single letters when normalised and lower-cased.
_LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

_LOADED: dict[str, WordIds] = {}


class WordIds:
    """Token ids by unit, cached by a 64-bit hash in sorted arrays (some 30 bytes each); starts anew at ``most`` units."""

    def __init__(self, path: str, most: int = 1_500_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        added = self.tokenizer.get_added_tokens_decoder()
        if len(added) > len(_SPARE) or any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("the tokenizer's added tokens aren't plain strings")
        self.added = {_SPARE[k : k + 1]: i for k, i in enumerate(added)}
        self.spare = {t.content.encode(): _SPARE[k] for k, t in enumerate(added.values())}
        self.find = re.compile(b"|".join(re.escape(c) for c in sorted(self.spare, key=len, reverse=True))) if added else None
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.size, self.begin = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _add(self, new: list[bytes], keys: np.ndarray) -> None:
        """Tokenise units: those of plain letters many at a time (each ends with one word-end token), the others singly."""
        texts_ = ["" if w in self.added else w.decode() for w in new]
        plain = np.fromiter((_LETTERS.fullmatch(t) is not None for t in texts_), bool, len(new))
        easy = [t for t, p in zip(texts_, plain.tolist(), strict=True) if p]
        joined = self.tokenizer.encode_batch_fast([" ".join(easy[i : i + 256]) for i in range(0, len(easy), 256)], add_special_tokens=False)
        ids = np.fromiter((i for e in joined for i in e.ids), np.uint32)
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) != len(easy) or (len(stop) and stop[-1] != len(ids)):
            raise ValueError("the tokenizer doesn't mark word ends as expected")
        others = [w for w, p in zip(new, plain.tolist(), strict=True) if not p]
        coded = iter(self.tokenizer.encode_batch_fast([w.decode() for w in others if w not in self.added], add_special_tokens=False))
        rest = [[self.added[w]] if w in self.added else next(coded).ids for w in others]
        keys = np.concatenate([keys[plain], keys[~plain]])
        sizes = np.concatenate([np.diff(stop, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))])
        ids = np.concatenate([ids, np.fromiter((i for x in rest for i in x), np.uint32)])
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(self.used, len(ids)), np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        begin = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.size, self.begin = (np.insert(old, at, v[order].astype(old.dtype)) for old, v in ((self.keys, keys), (self.size, sizes), (self.begin, begin)))

    def ids(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, and where each text's begin."""
        spots = [m.span() for m in self.find.finditer(buf.tobytes())] if self.find else []
        low = LOWER[buf]
        kind = _KIND[low]
        for s, e in spots:
            if np.searchsorted(offs, s, "right") == np.searchsorted(offs, e - 1, "right"):  # not across two texts
                low[s] = self.spare[buf[s:e].tobytes()]
                kind[s], kind[s + 1 : e] = _ADDED, _GAP
        buf = low
        inside = kind != _GAP
        if not inside.any():
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        begins = inside.copy()  # a unit begins after a gap, at a text's begin, and where the kinds surely part
        begins[1:] &= _PARTS[kind[:-1], kind[1:]]
        at_text = offs[:-1][offs[:-1] < len(buf)]
        begins[at_text] = inside[at_text]
        start = np.flatnonzero(begins)
        first = np.searchsorted(start, offs)
        dense = buf[inside]
        at = np.append(np.cumsum(inside, dtype=np.int64)[start] - 1, len(dense))
        distinct, where, inverse = np.unique(hash_runs(dense, at), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        known = self.keys[place] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            raw, new = dense.tobytes(), where[~known]
            self._add([raw[x:y] for x, y in zip(at[new].tolist(), at[new + 1].tolist(), strict=True)], distinct[~known])
            place = np.searchsorted(self.keys, distinct)
        place = place[inverse]
        size = self.size[place].astype(np.int64)
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(self.begin[place] - stop + size, size) + np.arange(stop[-1])]
        return ids, np.concatenate([[0], stop])[first]


def _word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def _pieces(path: str, capacity: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _word_ids(path)
        end = np.array([end_id], "<u4")
        for b in batches:
            for lo, hi, buf, offs in chunks(b, limit=1 << 20):
                ids, at = coder.ids(buf, offs)
                out: dict[str, list] = {f.name: [] for f in schema}
                for i, d in enumerate(b.column(0).slice(lo, hi - lo).to_pylist()):
                    own = np.concatenate([ids[at[i] : at[i + 1]].astype("<u4"), end])
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        for c, v in zip(out, (d, p, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                            out[c].append(v)
                yield record_batch(schema, **out)

    return run


class _Shard:
    """The pieces of a shard and the operations on groupings; a grouping is a list of lists of piece numbers."""

    def __init__(self, length: np.ndarray, capacity: int, seed: int) -> None:
        self.length, self.capacity = length.tolist(), capacity
        self.array, self.rng = length, np.random.default_rng(seed)
        self.bound = -(-int(length.sum()) // capacity)

    def place(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Best fit: each piece goes where least room is left after it."""
        length, cap = self.length, self.capacity
        room = sorted((cap - sum(length[i] for i in b), k) for k, b in enumerate(bins))
        for i in items:
            n = length[i]
            at = bisect_left(room, (n, -1))
            if at < len(room):
                left, k = room.pop(at)
                bins[k].append(i)
            else:
                left, k = cap, len(bins)
                bins.append([i])
            if left > n:
                insort(room, (left - n, k))
        return bins

    def begin(self, noise: float) -> list[list[int]]:
        key = self.array * (1 + noise * self.rng.random(len(self.array)))
        return self.place([], np.argsort(-key, kind="stable").tolist())

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones: the mean square of the fill, negated."""
        fill = np.array([sum(self.length[i] for i in b) for b in bins], float) / self.capacity
        return len(bins), -float((fill * fill).mean()) if len(bins) else 0.0

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        fill = np.array([sum(self.length[i] for i in x) for x in b])
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        chosen = [b[k] for k in good[self.rng.random(len(good)) < 0.5].tolist()]
        inside = {i for x in chosen for i in x}
        kept, displaced = [list(x) for x in chosen], []
        for x in a:
            if inside.isdisjoint(x):
                kept.append(list(x))
            else:
                displaced += [i for i in x if i not in inside]
        displaced.sort(key=lambda i: -self.length[i])
        return self.place(kept, displaced)

    def evolve(self, start: list[list[list[int]]], population: int, generations: int) -> list[list[int]]:
        pool = [*start]
        while len(pool) < max(population, 2):
            pool.append(self.begin(0.0 if not pool else 0.05 * len(pool)))
            if len(pool[-1]) <= self.bound:
                return pool[-1]
        scored = sorted(((self.fitness(x), k, x) for k, x in enumerate(pool)), key=lambda s: s[:2])
        count = len(scored)
        for _ in range(generations):
            if scored[0][0][0] <= self.bound:
                break
            i, j = sorted(self.rng.choice(len(scored), 2, replace=False).tolist())
            child = self.cross(scored[j][2], scored[i][2])
            entry = (self.fitness(child), count, child)
            count += 1
            if entry[0] < scored[-1][0] and all(entry[0] != s[0] for s in scored):
                scored = sorted([*scored[:-1], entry], key=lambda s: s[:2])
        return scored[0][2]


def _labels(bins: list[list[int]], n: int) -> bytes:
    out = np.zeros(n, "<i4")
    for k, b in enumerate(bins):
        out[b] = k
    return out.tobytes()


def _unlabel(blob: bytes) -> list[list[int]]:
    lab = np.frombuffer(blob, "<i4")
    order = np.argsort(lab, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(lab[order])) + 1)] if len(lab) else []


_ELITE = "shard long, island int, n_bins int, bound int, fit double, grouping binary"


def _island(capacity: int, population: int, generations: int, epoch: int):
    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        items = items.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        shard, island = (items[c][0].as_py() for c in ("shard", "island")) if items.num_rows else (0, 0)
        s = _Shard(items["length"].to_numpy(), capacity, hash((shard, island, epoch)) & 0x7FFFFFFF)
        start = [_unlabel(x) for x in elites["grouping"].to_pylist()]
        best = s.evolve(start, population, generations) if items.num_rows else []
        n, fit = s.fitness(best) if best else (0, 0.0)
        return pa.table({"shard": pa.array([shard], pa.int64()), "island": pa.array([island], pa.int32()), "n_bins": pa.array([n], pa.int32()), "bound": pa.array([s.bound], pa.int32()), "fit": pa.array([fit], pa.float64()), "grouping": pa.array([_labels(best, items.num_rows)], pa.binary())})

    return run


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def _lay_out(level: int):
    def run(items: pa.Table, elites: pa.Table) -> pa.Table:
        items = items.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        best = elites.sort_by([("n_bins", "ascending"), ("fit", "ascending"), ("island", "ascending")])
        lab = np.frombuffer(best["grouping"][0].as_py(), "<i4").astype(np.int64) if items.num_rows else np.zeros(0, np.int64)
        length = items["length"].to_numpy()
        order = np.argsort(lab, kind="stable")
        run_total = np.cumsum(length[order]) - length[order]
        first = np.searchsorted(lab[order], lab[order])
        offset = np.empty(len(lab), np.int64)
        offset[order] = run_total - run_total[first]
        fill = np.bincount(lab, length, int(lab.max()) + 1 if len(lab) else 0).astype(np.int64)[lab]
        shard = items["shard"].to_numpy()
        t = items.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        for name, v in (("sequence_id", (level << 58) + (shard << 20) + lab), ("offset", offset), ("fill", fill)):
            t = t.append_column(name, pa.array(v, pa.int64()))
        return t

    return run


def pack_pieces(pieces: DataFrame, capacity: int, shard: int, islands: int, epochs: int, population: int, generations: int, level: int = 0) -> DataFrame:
    """One level of packing; ``fill`` is the number of tokens in a piece's sequence."""
    n = pieces.count()
    items = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", F.lit(level)), F.lit(max(1, -(-n // shard)))))
    spread = items.select("doc_id", "piece", "length", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    elites = pieces.sparkSession.createDataFrame([], _ELITE)
    for epoch in range(epochs):
        if epoch:
            moved = elites.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
            elites = elites.unionByName(moved) if islands > 1 else elites
        elites = spread.groupBy("shard", "island").cogroup(elites.groupBy("shard", "island")).applyInArrow(_island(capacity, population, generations, epoch), _ELITE)
        elites, seen = counted(sized(elites, n), "elites", open=F.count_if(F.col("n_bins") > F.col("bound")))
        if not seen["open"]:
            break
    return items.groupBy("shard").cogroup(elites.groupBy("shard")).applyInArrow(_lay_out(level), _OUT)


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end_id: int = 1, shard: int = 8192, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 24, poor: float = 0.97) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    docs = texts(docs, key, text)
    pieces = stored(docs.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    options = {"capacity": capacity, "shard": shard, "islands": islands, "epochs": epochs, "population": population, "generations": generations}
    out = stored(sized(pack_pieces(pieces, **options), pieces.count()), "packed")
    bad = F.col("fill") < poor * capacity
    again = pack_pieces(out.where(bad).drop("sequence_id", "offset", "fill"), **options, level=1)
    return out.where(~bad).unionByName(again).drop("fill")
