"""Substring dedup: exact removal of long passages that an earlier document already holds.

Method: prefix-partitioned suffix trees.  A suffix (a place of a document with ``window`` more words) goes to the
group named by a *variable-length prefix*: its words up to the end of the least ``k``-gram of its window.  Suffixes
that agree on ``window`` words agree on that prefix, so every repeat of that length meets in one group; neighbouring
suffixes share their least k-gram and travel as one record with their joint words.

1. One scan of the texts gives each document's digest and the prefixes (64 bits each) it has suffixes for.
   Documents with the same words as one of smaller id are settled here; only first copies go on.
2. Prefixes of a single document have no inner node below them; one aggregate finds and drops them.
3. For the others the words are fetched.  Equal records are merged, with their least id, before they are dealt out.
4. Each group builds the deep part of its suffix tree: suffixes are ordered by prefix doubling, and neighbours that share
   ``window`` words or more form an internal node, whose depth is the length of a maximal repeat of its members.  A node's
   least doc_id is known exactly, since words and not hashes are compared.
5. A prefix with more than ``group_limit`` documents, whose records of 92 words at most would take some 100 MB, is
   lengthened, in one step, to the whole window: its suffixes are leaves, known by two 64-bit fingerprints, and an aggregate
   with map-side combine finds the least id, so a group that any number of documents share is never held by one task.
6. The answers return to the places by join, the marks are gathered by document, and the words left are joined.
   ``maximal_repeats`` lists the marked spans instead.

No step holds more than a batch of records in a task; no group of copies is expanded into pairs.

Defined cases: null or empty texts have no words; rows without a doc_id take no part and are not returned; repeated
rows of one document give repeated rows; rows of one id with other texts are each judged by their own, and never by each other; windows repeated inside one document only are kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import counted, partitions, sized, stored, texts
from kinfold.llm._words import SPACE, chunks, grams, lists, record_batch, sliding_min, words

#: Low bits of a packed value hold a place in the chunk, the others the k-gram's hash.
_PLACE = np.uint64((1 << 28) - 1)


def _runs(w, window: int, k: int):
    """For each run of windows with the same least k-gram: text, first and last window, place of the k-gram, its hash."""
    n = len(w.hash)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none, np.zeros(0, np.uint64)
    g = grams(w.hash, k)
    least = sliding_min((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), window - k + 1)
    at = (least & _PLACE).astype(np.int64)[: n - window + 1]
    doc = w.doc
    inside = doc[: n - window + 1] == doc[window - 1 :]
    where = np.flatnonzero(inside)
    if not len(where):
        return none, none, none, none, np.zeros(0, np.uint64)
    new = np.ones(len(where), bool)
    new[1:] = (np.diff(at[where]) != 0) | (np.diff(where) != 1) | (np.diff(doc[where]) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(where)) - 1
    lo, hi = where[first], where[last]
    return doc[lo], lo, hi, at[lo], g[at[lo]]


def _scan(window: int, k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("sha", pa.binary()), ("kept_sha256", pa.string()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, buf, offs in chunks(b):
                w = words(buf, offs, SPACE)
                doc, *_, key = _runs(w, window, k)
                pair = np.unique(np.rec.fromarrays([doc, key.view(np.int64)])) if len(doc) else np.rec.fromarrays([doc, key.view(np.int64)])
                raw = buf.tobytes()
                sha = [hashlib.sha256(b" ".join(raw[s:e].split())).digest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                keys = lists(pair.f1, np.bincount(pair.f0, minlength=hi - lo), pa.int64())
                yield record_batch(schema, doc_id=ids.slice(lo, hi - lo), row=b.column(2).slice(lo, hi - lo), n_words=np.diff(w.first), sha=sha, kept_sha256=[x.hex() for x in sha], keys=keys)

    return run, "doc_id long, row long, n_words long, sha binary, kept_sha256 string, keys array<long>"


def _records(window: int, k: int):
    """The wanted runs of a document: their joint words where the group is small, fingerprints of each suffix where it is large."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("lead", pa.int32()), ("n", pa.int32()), ("ctx", pa.binary()), ("one", pa.int64()), ("two", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            small, large, rows = b.column(2), b.column(3), b.column(4)
            for lo, hi, buf, offs in chunks(b):
                w = words(buf, offs, SPACE)
                doc, first, last, at, key = _runs(w, window, k)
                raw = buf.tobytes()
                key = key.view(np.int64)
                out: dict[str, list] = {f.name: [] for f in schema}
                at_doc = np.searchsorted(doc, np.arange(hi - lo + 1))
                hot_key, hot_doc, hot_row, hot_at = [], [], [], []
                for i in range(hi - lo):
                    x = slice(at_doc[i], at_doc[i + 1])
                    if x.start == x.stop:
                        continue
                    d, row, base = ids[lo + i].as_py(), rows[lo + i].as_py(), int(w.first[i])
                    wanted = small[lo + i].values.to_numpy(zero_copy_only=False) if small[lo + i].is_valid else ()
                    if len(wanted):
                        for j in (np.flatnonzero(np.isin(key[x], wanted)) + x.start).tolist():
                            f, t = int(first[j]), int(last[j])
                            out["doc_id"].append(d)
                            out["row"].append(row)
                            out["key"].append(int(key[j]))
                            out["start"].append(f - base)
                            out["lead"].append(int(at[j]) - f)
                            out["n"].append(t - f + 1)
                            out["ctx"].append(b" ".join(raw[w.start[f] : w.end[t + window - 1]].split()))
                            out["one"].append(0)
                            out["two"].append(0)
                    wanted = large[lo + i].values.to_numpy(zero_copy_only=False) if large[lo + i].is_valid else ()
                    if len(wanted):
                        for j in (np.flatnonzero(np.isin(key[x], wanted)) + x.start).tolist():
                            places = np.arange(first[j], last[j] + 1)
                            hot_at.append(places)
                            hot_doc.append(np.full(len(places), d))
                            hot_row.append(np.full(len(places), row))
                            hot_key.append(places - base)
                if out["doc_id"]:
                    yield record_batch(schema, **{c: pa.array(v, schema.field(c).type) for c, v in out.items()})
                if hot_at:
                    places = np.concatenate(hot_at)
                    one, two = (grams(w.hash, window, salt)[places].view(np.int64) for salt in (101, 202))
                    m = len(places)
                    yield record_batch(schema, doc_id=np.concatenate(hot_doc), row=np.concatenate(hot_row), key=pa.nulls(m, pa.int64()), start=np.concatenate(hot_key).astype(np.int32), lead=np.zeros(m, np.int32), n=np.ones(m, np.int32), ctx=pa.nulls(m, pa.binary()), one=one, two=two)

    return run, "doc_id long, row long, key long, start int, lead int, n int, ctx binary, one long, two long"


def _tree(ctx: list[bytes], n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The deep internal nodes of many groups' suffix trees at once: node and record of each suffix, and each node's depth.

    Words become ranks, ranks of 2, 4, 8, ... words follow by doubling.  They order the suffixes, and give the words that
    neighbours in that order share.  A node is a run of neighbours that share ``window`` words or more; its depth, the fewest
    that two neighbours share, is the length of a repeat that can't be prolonged to the right for all of them within their
    records.  A suffix alone is a leaf: a node of its own, as deep as its record goes.
    """
    flat: list[bytes] = []
    sizes = np.empty(len(ctx), np.int64)
    for i, c in enumerate(ctx):
        x = c.split(b" ")
        sizes[i] = len(x)
        flat += x
    _, rank = np.unique(pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy(), return_inverse=True)
    end = np.cumsum(sizes)
    record = np.repeat(np.arange(len(ctx)), n)
    place = (end - sizes)[record] + np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    levels = [rank.astype(np.int64)]  # ranks of 1, 2, 4, ... words; a rank reaches beyond its record only where none is asked for
    while len(levels[-1]) and 2 << (len(levels) - 1) <= window:
        size, r = 1 << (len(levels) - 1), levels[-1]
        far = np.zeros(len(r), np.int64)
        far[: len(r) - size] = r[size:] + 1
        levels.append(np.unique(r * (len(r) + 2) + far, return_inverse=True)[1])
    size, top = 1 << (len(levels) - 1), levels[-1]
    order = np.lexsort((top[place + window - size], top[place]))
    at, room = place[order], end[record[order]] - place[order]
    shared = np.zeros(max(len(at) - 1, 0), np.int64)
    most = np.minimum(room[1:], room[:-1])
    for k in [*[len(levels) - 1] * (int(room.max(initial=0)) >> (len(levels) - 1)), *range(len(levels) - 2, -1, -1)]:
        step = 1 << k
        more = np.flatnonzero(shared + step <= most)
        x, y = at[more] + shared[more], at[more + 1] + shared[more]
        shared[more[levels[k][x] == levels[k][y]]] += step
    new = np.ones(len(at), bool)
    new[1:] = shared < window
    of = np.cumsum(new) - 1
    depth = np.full(int(of[-1]) + 1 if len(of) else 0, np.iinfo(np.int64).max)
    np.minimum.at(depth, of[1:][~new[1:]], shared[~new[1:]])
    alone = depth == np.iinfo(np.int64).max
    depth[alone] = room[new][alone]
    node = np.empty(len(of), np.int64)
    node[order] = of
    return node, record, depth


def _trees(window: int, batch_rows: int):
    """Over records sorted by prefix: each record's least doc_id for each of its suffixes."""
    schema = pa.schema([("key", pa.int64()), ("lead", pa.int32()), ("n", pa.int32()), ("cid", pa.int64()), ("cid2", pa.int32()), ("least", pa.list_(pa.int64()))])

    def solve(t: pa.Table) -> pa.RecordBatch:
        n = t["n"].to_numpy().astype(np.int64)
        doc = t["doc"].to_numpy()
        node, record, _ = _tree(t["ctx"].to_pylist(), n, window)
        least = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[record])
        t = t.combine_chunks()
        return record_batch(schema, **{c: t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in ("key", "lead", "n", "cid", "cid2")}, least=lists(least[node], n, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < batch_rows:
                continue
            t = pa.Table.from_batches(held)
            key = t["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield solve(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                rows = t.num_rows - cut
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run, "key long, lead int, n int, cid long, cid2 int, least array<long>"


def _finish(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for d, text, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                w = (text.as_py() or "").encode().split()
                cover = np.zeros(len(w) + 1, np.int64)
                starts = np.unique(np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in marks.values]))
                np.add.at(cover, starts, 1)
                np.add.at(cover, starts + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                left = b" ".join([x for x, y in zip(w, keep.tolist(), strict=True) if y])
                out["doc_id"].append(d)
                out["n_words"].append(len(w))
                out["n_removed"].append(int(len(w) - keep.sum()))
                out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
                out["kept_text"].append(left.decode())
            yield record_batch(schema, **out)

    return run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


#: Groups of exact copies that are broadcast up to this number (some 20 MB); more are joined by salted shuffle.
FEW_GROUPS, SALTS = 200_000, 16


def _with_first(base: DataFrame, many: int) -> DataFrame:
    """``rep``: the least doc_id of the documents with the same words, for rows that have such copies."""
    dup = base.where("has_window").groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").select("sha", "rep")
    dup, seen = counted(sized(dup, many), "copies")
    if seen["n"] <= FEW_GROUPS:
        return base.join(F.broadcast(dup), "sha", "left")
    salted = dup.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "row"), F.lit(SALTS)).cast("int")
    return base.withColumn("salt", salt).join(salted, ["sha", "salt"], "left").drop("salt")


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, text, and ``row``, which tells rows of one id apart by their texts."""
    docs = texts(docs, key, text)
    return sized(docs, docs.count()).withColumn("row", F.xxhash64("text"))  # counted from the files' footers


def _marks(docs: DataFrame, window: int, k: int, group_limit: int) -> tuple[DataFrame, DataFrame]:
    """Every row with its digest and whether it is a copy; and for rows with repeats the starts of their windows (marks)."""
    spark = docs.sparkSession
    fn, ddl = _scan(window, k)
    base, seen = counted(docs.mapInArrow(fn, ddl).withColumn("has_window", F.col("n_words") >= window), "suffixes")
    many = seen["n"]
    named = _with_first(base, many).withColumn("copy", F.coalesce(F.col("rep") < F.col("doc_id"), F.lit(False)))
    named = stored(named.select("doc_id", "row", "n_words", "kept_sha256", "copy", F.when(~F.col("copy"), F.col("keys")).alias("keys")), "first-copies")

    at = named.where(~F.col("copy")).select("doc_id", "row", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("m")).where("a < b")
    shared = shared.select("key", (F.col("m") > group_limit).alias("large"))
    wanted = at.join(shared, "key").groupBy("doc_id", "row").agg(F.collect_list(F.when(~F.col("large"), F.col("key"))).alias("small"), F.collect_list(F.when(F.col("large"), F.col("key"))).alias("large"))

    fn, ddl = _records(window, k)
    found = docs.join(wanted, ["doc_id", "row"]).select("doc_id", "text", "small", "large", "row").mapInArrow(fn, ddl)
    found = found.withColumn("cid", F.xxhash64("key", "lead", "n", "ctx")).withColumn("cid2", F.hash("ctx", "key", "n"))
    found = stored(sized(found, many), "records")

    plain = found.where("key is not null")
    merged = plain.groupBy("key", "lead", "n", "cid", "cid2", "ctx").agg(F.min("doc_id").alias("doc"))
    fn, ddl = _trees(window, batch_rows=4096)
    answers = merged.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(fn, ddl)
    answers = answers.withColumnRenamed("key", "k2")
    same = ["cid", "cid2", "lead", "n"]
    hits = plain.select("doc_id", "row", "start", "key", *same).join(answers, same).where("key = k2")
    starts = F.filter(F.transform("least", lambda m, i: F.when(m < F.col("doc_id"), F.col("start") + i)), lambda s: s.isNotNull())
    hits = hits.select("doc_id", "row", starts.alias("at"))

    hot = found.where("key is null").select("doc_id", "row", "start", "one", "two")
    least = hot.groupBy("one", "two").agg(F.min("doc_id").alias("least"))
    hot_hits = hot.join(least, ["one", "two"]).where("least < doc_id").groupBy("doc_id", "row").agg(F.collect_list("start").alias("at"))
    marks = hits.where(F.size("at") > 0).unionByName(hot_hits).groupBy("doc_id", "row").agg(F.collect_list("at").alias("marks"))
    marks = stored(sized(marks, many), "marks")
    return named, marks


def maximal_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, k: int = 8, group_limit: int = 16_384) -> DataFrame:
    """doc_id, start, end (word places, exclusive): the longest spans whose every window also starts in a document of smaller id.

    A document all of whose words an earlier one has is one span.
    """
    docs = _rows(docs, key, text)
    named, marks = _marks(docs, window, k, group_limit)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int]] = []
            for d, own in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                at = np.unique(np.concatenate([x.values.to_numpy(zero_copy_only=False) for x in own.values]))
                cut = np.flatnonzero(np.diff(at) > window)  # spans that touch are one
                first, last = np.append(0, cut + 1), np.append(cut, len(at) - 1)
                out += [(d, int(at[i]), int(at[j]) + window) for i, j in zip(first, last, strict=True)]
            yield record_batch(schema, **{f.name: [r[i] for r in out] for i, f in enumerate(schema)})

    spans = marks.select("doc_id", "marks").mapInArrow(run, "doc_id long, start long, end long")
    return spans.unionByName(named.where("copy").select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, k: int = 8, group_limit: int = 16_384, with_text: bool = False) -> DataFrame:
    """Words covered by a window that also starts in a document of smaller id are removed.

    Returns doc_id, n_words, n_removed, kept_sha256; ``with_text`` adds ``kept_text``, the words left joined by one space.
    """
    docs = _rows(docs, key, text)
    named, marks = _marks(docs, window, k, group_limit)
    fn, ddl = _finish(window)
    cut = docs.join(marks, ["doc_id", "row"]).select("doc_id", "text", "marks").mapInArrow(fn, ddl)
    whole = named.join(marks.select("doc_id", "row"), ["doc_id", "row"], "left_anti")
    empty = hashlib.sha256(b"").hexdigest()
    whole = whole.select("doc_id", "row", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.lit(0)).cast("long").alias("n_removed"), F.when(F.col("copy"), F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"))
    if not with_text:
        return whole.drop("row").unionByName(cut.drop("kept_text"))
    kept = docs.dropDuplicates(["doc_id", "row"]).join(whole, ["doc_id", "row"]).withColumn("kept_text", F.when(F.col("n_removed") > 0, F.lit("")).otherwise(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")))).drop("text", "row")
    return kept.unionByName(cut)
