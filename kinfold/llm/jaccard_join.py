"""N-gram Jaccard join by PartEnum signatures: exact links of documents whose shingle sets are at least 0.8 alike.

Method: sets of equal content are merged first, by a 128-bit digest, and only first copies go on.  Sets are put into size
bands whose ends differ by 1/0.8, so linked sets lie in the same or neighbouring bands; an *instance* serves one band and
the next.  Linked sets of an instance differ in at most K elements.  The feature domain is partitioned, by hash, into more
than K / 2 parts, and each part into three.  Of linked sets some part holds at most one difference, which lies in one of its
three, so the other two agree: a part's signatures are its elements in each two of the three, hashed.  Signatures of a single
element or none say little; a set does without them where it has enough parts whose signatures all have two elements (counted
exactly: more than K / 2), else without empty ones where enough have one, else it emits all, so every link is covered.

Signatures travel as compressed blobs, a row for each batch of texts and part of the signature space, sized so that a part
holds about ``part_rows`` of them.  A bucket of equal signatures yields a star of candidates around its least document, not
all pairs.  Stars are pruned by an exact lower bound of the difference (2,048-bit parity sketches), the rest are verified on
the whole texts, and components follow.  Then only buckets that still hold several components are looked at again: their
pairs across components, pruned by the same bound, are verified too, which completes the components exactly.

Defined cases: null and empty texts have no shingles and form components of their own; texts of fewer than five words have
one shingle, the whole sequence; rows without a doc_id take no part; repeated rows of one document count once, and of rows
of one id with other texts the one whose text has the least hash (xxhash64) speaks for the document; ties need no rule, since a component's id is its least doc_id; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import counted, sized, stored, texts
from kinfold.llm._components import components
from kinfold.llm._words import SPACE, chunks, grams, lists, mix, record_batch, seeds, words

#: Longs of a parity sketch, of 64 bits each.
LONGS = 32
#: Ids of exact copies are broadcast up to this number (some 10 MB), else joined by shuffle.
FEW_IDS = 500_000
SALTS = 16
_K = seeds(8, 4242)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text numbers and hashes, sorted by text; and the set sizes."""
    w = words(buf, offs, SPACE, lower=True)
    n, doc = np.diff(w.first), w.doc
    g = grams(w.hash, size)
    ok = doc[: len(g)] == doc[size - 1 : size - 1 + len(g)]
    owner, h = doc[: len(g)][ok], g[ok]
    for short in range(1, size):  # a short text is one shingle
        at = w.first[:-1][n == short]
        if len(at):
            c = seeds(short, 900 + short) | np.uint64(1)
            with np.errstate(over="ignore"):
                own = sum((w.hash[at + j] * c[j] for j in range(short)), np.zeros(len(at), np.uint64))
            owner, h = np.concatenate([owner, np.flatnonzero(n == short)]), np.concatenate([h, mix(own)])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        owner, h = owner[new], h[new]
    return owner, h, np.bincount(owner, minlength=len(offs) - 1)


def bands(most: int, percent: int) -> np.ndarray:
    """Lower ends of the size bands, up to beyond ``most``."""
    ends = [1, 2]
    while ends[-1] <= most:
        ends.append(max(ends[-1] + 1, (ends[-1] - 1) * 100 // percent + 1))
    return np.array([*ends, max(ends[-1] + 1, (ends[-1] - 1) * 100 // percent + 1)])


def _differ(total: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Sets that are linked and have ``total`` elements together differ in this many at most."""
    return total * (100 - percent) // (100 + percent)


#: A first-level part is split into this many; signatures leave one of them out.
SPLIT = 3


def signatures(owner: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers and signatures of the sets in both instances that each belongs to."""
    ends = bands(int(size.max()) if len(size) else 1, percent)
    band = np.searchsorted(ends, size, "right") - 1
    docs, sigs = [], []
    for back in (0, 1):
        inst = band - back
        top = ends[np.clip(inst + 1, 0, len(ends) - 1)] - 1  # the largest size of the instance's lower band
        most = _differ(top + top * 100 // percent, percent)
        parts = np.where((inst >= 0) & (most > 0) & (size > 0), (most // 2 + 1) * 144 // 100, 0)
        begin = np.cumsum(parts) - parts
        use = parts[owner] > 0
        o, x = owner[use], h[use]
        cell = (begin[o] + (mix(x ^ _K[0]) % parts[o].astype(np.uint64)).astype(np.int64)) * SPLIT + (mix(x ^ _K[6]) % np.uint64(SPLIT)).astype(np.int64)
        total = int(parts.sum())
        acc = np.zeros(total * SPLIT, np.uint64)
        with np.errstate(over="ignore"):
            np.add.at(acc, cell, mix(x ^ _K[1]))
            acc = acc.reshape(total, SPLIT)
            count = np.bincount(cell, minlength=total * SPLIT).reshape(total, SPLIT)
            doc = np.repeat(np.arange(len(size)), parts)
            part = np.arange(total) - np.repeat(begin, parts)
            # All elements of a part but those of one of the three.
            rest, left = acc.sum(1, keepdims=True) - acc, count.sum(1, keepdims=True) - count
            place = part[:, None] * SPLIT + np.arange(SPLIT)
            sig = mix((rest + mix(inst[doc].astype(np.uint64) * _K[2])[:, None] + mix(place.astype(np.uint64).ravel()).reshape(place.shape)).ravel()).reshape(place.shape)
        # A link of a set of the lower band reaches up to size / percent, one of the upper band down to the lower band's top.
        apart = _differ(size + np.where(back, top, size * 100 // percent), percent)
        fewest = left.min(1)
        least = np.zeros(len(size), np.int64)  # elements a signature must have
        for need in (1, 2):
            enough = np.bincount(doc, fewest >= need, len(size)) > apart // 2
            least = np.where(enough, need, least)
        keep = left >= least[doc][:, None]
        docs.append(np.broadcast_to(doc[:, None], keep.shape)[keep])
        sigs.append(sig[keep])
    return np.concatenate(docs), np.concatenate(sigs)


def _describe(size: int):
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in chunks(b):
                owner, h, n = shingles(buf, offs, size)
                m = hi - lo
                sums = []
                with np.errstate(over="ignore"):
                    for k in (3, 4):
                        acc = np.zeros(m, np.uint64)
                        np.add.at(acc, owner, mix(h ^ _K[k]))
                        sums.append(mix(acc).view(np.int64))
                bit = (mix(h ^ _K[5]) & np.uint64(64 * LONGS - 1)).astype(np.int64)
                sketch = np.zeros((m, LONGS), "<i8")
                for at in range(0, m, 256):  # short texts come by the thousand
                    x, y = np.searchsorted(owner, (at, at + 256))
                    k = min(256, m - at)
                    odd = np.bincount((owner[x:y] - at) * (64 * LONGS) + bit[x:y], minlength=k * 64 * LONGS).reshape(k, -1) & 1
                    sketch[at : at + k] = np.packbits(odd.astype(np.uint8), axis=1).view("<i8")
                yield record_batch(schema, doc_id=b.column(0).slice(lo, m), row=b.column(2).slice(lo, m), n=n, one=sums[0], two=sums[1], sketch=lists(sketch.ravel(), np.full(m, LONGS), pa.int64()))

    return run, "doc_id long, row long, n long, one long, two long, sketch array<long>"


def _emit(size: int, percent: int, parts: int):
    """Signatures of a batch, dealt by part of the signature space: five bytes each, and the documents."""
    schema = pa.schema([("part", pa.int64()), ("sigs", pa.binary()), ("docs", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            docs, sigs = [], []
            for lo, _, buf, offs in chunks(b):
                d, s = signatures(*shingles(buf, offs, size), percent)
                docs.append(ids[lo + d])
                sigs.append(s)
            if not docs:
                continue
            docs, sigs = np.concatenate(docs), np.concatenate(sigs)
            part = (sigs % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((docs, part))
            docs, part = docs[order], part[order]
            tail = (sigs[order] // np.uint64(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            cut = np.flatnonzero(np.append(True, np.diff(part) != 0)) if len(part) else []
            stop = np.append(cut[1:], len(part)) if len(part) else []
            yield record_batch(schema, part=part[cut] if len(part) else part, sigs=[tail[s:e].tobytes() for s, e in zip(cut, stop, strict=True)], docs=[pack.compress(np.diff(docs[s:e], prepend=0).astype("<i8").tobytes()) for s, e in zip(cut, stop, strict=True)])

    return run, "part long, sigs binary, docs binary"


def _buckets(t: pa.Table) -> pa.Table:
    """Of one part: the distinct pairs of a bucket's least document and each other one."""
    unpack = zstandard.ZstdDecompressor()
    raw = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 5) for x in t["sigs"].to_pylist()])
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :5] = raw
    sig = wide.view("<u8").ravel()
    doc = np.concatenate([np.cumsum(np.frombuffer(unpack.decompress(x), "<i8")) for x in t["docs"].to_pylist()])
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    center = np.repeat(doc[first], np.diff(np.append(first, len(sig))))
    other = center != doc
    center, doc = center[other], doc[other]
    order = np.lexsort((doc, center))
    center, doc = center[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (center[1:] != center[:-1]) | (doc[1:] != doc[:-1])
    return pa.table({"center": pa.array(center[new]), "doc": pa.array(doc[new])})


def _verify(size: int, percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                sets = []
                for name in ("text_a", "text_b"):
                    own, hs, ns, at = [], [], [], 0
                    for x, y, buf, offs in chunks(part, name):
                        o, h, n = shingles(buf, offs, size)
                        own.append(o + at)
                        hs.append(h)
                        ns.append(n)
                        at += y - x
                    own, h = np.concatenate(own), np.concatenate(hs)
                    with np.errstate(over="ignore"):
                        sets.append((own, mix(h + mix(own.astype(np.uint64) + np.uint64(5))), np.concatenate(ns)))
                (oa, ka, na), (_, kb, nb) = sets
                common = np.bincount(oa[np.isin(ka, kb)], minlength=part.num_rows)
                yield record_batch(schema, a=part.column(0), b=part.column(1), linked=(100 * common >= percent * (na + nb - common)) & (common > 0))

    return run, "a long, b long, linked boolean"


def _close(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parity sketches allow a link; never false for a link."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.get(f"{a}.sketch", F.lit(i)).bitwiseXOR(F.get(f"{b}.sketch", F.lit(i)))) for i in range(LONGS)), F.lit(0))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (apart * (100 + percent) <= (na + nb) * (100 - percent))


def _links(pairs: DataFrame, docs: DataFrame, size: int, percent: int, few: int = 2000) -> DataFrame:
    """The pairs (a, b) that are linked, by their whole texts.

    Up to ``few`` pairs, counted, are broadcast to where the texts are; more are joined by shuffle, both ends by one
    partitioning of the texts.
    """
    a = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    fn, ddl = _verify(size, percent)
    if pairs.count() <= few:
        both = b.join(F.broadcast(pairs), "b").join(a.join(F.broadcast(pairs), "a"), ["a", "b"])
    else:
        both = pairs.hint("merge").join(b, "b").hint("merge").join(a, "a")
    both = both.select("a", "b", "text_a", "text_b")
    return both.mapInArrow(fn, ddl).where("linked").select("a", "b")


def _with_first(sets: DataFrame, many: int) -> DataFrame:
    """``rep``: the least doc_id of the documents with an equal set, for those that have one.

    Groups of copies are aggregated before they are met again: few are broadcast, more are joined with the documents dealt
    by salt, so that a large group of copies doesn't land in one task.
    """
    same = ["n", "one", "two"]
    groups, seen = counted(sized(sets.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m"), many), "copies")
    if seen["n"] <= FEW_IDS // 4:
        return sets.join(F.broadcast(groups), same, "left")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, [*same, "salt"], "left").drop("salt")


def _some(df: DataFrame) -> DataFrame:
    """A table of ids for a join: broadcast up to FEW_IDS rows, counted, else joined by sorting."""
    return F.broadcast(df) if df.count() <= FEW_IDS else df.hint("merge")


def _speaking(docs: DataFrame, several: DataFrame) -> DataFrame:
    """``docs`` without the texts that don't speak for their id; ``several`` holds the ids with more than one text."""
    several = stored(several, "several")
    if several.isEmpty():
        return docs
    return docs.join(_some(several), "doc_id", "left").where("own is null or own = row").drop("own")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, part_rows: int = 400_000) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    docs = texts(docs, key, text)
    many = docs.count()  # from the files' footers
    docs = sized(docs, many).withColumn("row", F.xxhash64("text"))
    fn, ddl = _describe(size)
    sets = docs.mapInArrow(fn, ddl).groupBy("doc_id").agg(F.min_by(F.struct("n", "one", "two", "sketch"), "row").alias("s"), F.min("row").alias("row"), F.max("row").alias("most"))
    base = stored(sized(sets.select("doc_id", "row", "most", "s.*"), many), "sets")
    docs = _speaking(docs, sized(base.where("row < most").select("doc_id", F.col("row").alias("own")), many)).select("doc_id", "text")
    named = stored(_with_first(base.select("doc_id", "n", "one", "two"), many).select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")), "first-copies")
    total = base.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-int(total) // part_rows))  # about a signature a shingle
    fn, ddl = _emit(size, percent, parts)
    copies = stored(named.where("rep != doc_id").select("doc_id"), "copies")  # they have nothing more to find
    ours = docs.join(_some(copies), "doc_id", "left_anti")
    stars = stored(sized(ours.mapInArrow(fn, ddl).groupBy("part").applyInArrow(_buckets, "center long, doc long").distinct(), many), "stars")

    known = base.select(F.col("doc_id"), "n", "sketch")
    near = stars.select(F.least("center", "doc").alias("a"), F.greatest("center", "doc").alias("b")).distinct()
    near = near.join(known.alias("y"), F.col("b") == F.col("y.doc_id")).join(known.alias("x"), F.col("a") == F.col("x.doc_id"))
    near = stored(sized(near.where(_close("x", "y", percent)).select("a", "b"), many), "candidates")
    links = stored(sized(_links(near, docs, size, percent), many), "verified")
    roots = stored(sized(components(links), many), "roots")

    # Documents that share a bucket share its center, so the pairs left to look at meet under a center.
    of = stars.unionByName(stars.select("center", F.col("center").alias("doc")).distinct())
    of = of.join(roots, F.col("doc") == F.col("node"), "left").select("center", "doc", F.coalesce("root", "doc").alias("root"))
    mixed = stored(sized(of.groupBy("center").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("center"), many), "mixed")
    open_ = of.join(_some(mixed), "center", "left_semi").join(known, F.col("doc") == F.col("doc_id")).select("center", "doc", "root", "n", "sketch")
    open_ = stored(sized(open_, many), "open")
    pairs = open_.alias("x").join(open_.alias("y"), (F.col("x.center") == F.col("y.center")) & (F.col("x.doc") < F.col("y.doc")) & (F.col("x.root") != F.col("y.root")) & _close("x", "y", percent))
    pairs = stored(sized(pairs.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b")).distinct().join(near, ["a", "b"], "left_anti"), many), "pairs")
    more = stored(sized(_links(pairs, docs, size, percent), many), "verified")
    if not more.isEmpty():
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    return named.join(roots, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "rep").alias("component_id"))
