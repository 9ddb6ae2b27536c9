"""Nearest neighbours by inner product: a block matrix join of int8 tiles.

Method: vectors are gathered into blocks of about ``block`` rows, each vector also as int8 with its own scale.  Query
blocks, four times as many rows where memory allows, meet candidate blocks on a tile key; with n rows and a share of queries
of 1 / ``every`` the candidates are copied n / (4 every block) times, which grows with the square of the rows, as any exact
search does.  A tile multiplies the int8 matrices, 1,024 dimensions at a time in float32 (which holds those whole numbers
exactly) and adds the slices in double precision; |q.c - q'.c'| <= |q| |c - c'| + |q - q'| |c'| bounds the quantisation error of every product.
A candidate survives if its upper bound reaches the tile's k-th largest lower bound; survivors are recomputed from the
original vectors in double precision, so nothing is lost.  Each tile returns k rows a query, which are merged by heaps
over rows sorted by query.  The queries are a stated set against all rows, in blocks.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most
vectors take no part; rows without an id take no part; of rows with the same id the least vector counts; ties go to the
smaller id; with fewer candidates than ``k`` all are returned; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._base import partitions
from kinfold.llm._words import record_batch

_BLOCK = "block int, ids binary, x binary, q binary, scale binary, norm binary, error binary, hat binary"


def _pack(t: pa.Table) -> pa.Table:
    """The rows of a block as matrices: vectors, int8 values, scales, norms of vector, error and approximation."""
    t = t.sort_by("vec_id")
    ids = t["vec_id"].to_numpy()
    x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(len(ids), -1)
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    hat = q * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(1)) * (1 + 1e-9)
    cols = [ids.astype("<i8"), x, q, scale, norm(x), norm(x - hat), norm(hat)]
    return pa.table({"block": pa.array([t["block"][0].as_py()], pa.int32())} | {n: pa.array([a.tobytes()], pa.binary()) for n, a in zip(("ids", "x", "q", "scale", "norm", "error", "hat"), cols, strict=True)})


class _Side:
    def __init__(self, t: pa.Table) -> None:
        get = lambda c, kind: np.frombuffer(t[c][0].as_py(), kind)
        self.ids, self.scale, self.norm, self.error, self.hat = get("ids", "<i8"), *(get(c, "<f8") for c in ("scale", "norm", "error", "hat"))
        self.x = get("x", "<f8").reshape(len(self.ids), -1)
        self.q = get("q", np.int8).reshape(self.x.shape).astype(np.float32)


def _tile(k: int, step: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {f.name: [] for f in schema}
        if left.num_rows and right.num_rows:
            a, b = _Side(left), _Side(right)
            for lo in range(0, len(a.ids), step):
                part = slice(lo, lo + step)
                about = sum((a.q[part, d : d + 1024] @ b.q[:, d : d + 1024].T).astype(float) for d in range(0, a.q.shape[1], 1024)) * (a.scale[part, None] * b.scale)
                slack = a.norm[part, None] * b.error + a.error[part, None] * b.hat
                slack = slack * (1 + 1e-9) + 1e-12 * a.norm[part, None] * b.norm
                low = about - slack
                own = a.ids[part, None] == b.ids
                low[own] = -np.inf
                keep = min(k, low.shape[1])
                bar = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep]
                alive = (about + slack >= bar[:, None]) & ~own
                row, col = np.nonzero(alive)
                exact = np.zeros(len(row))
                for s in range(0, len(row), 1 << 15):  # summed from left to right, in double precision
                    p = slice(s, s + (1 << 15))
                    exact[p] = np.cumsum(a.x[part][row[p]] * b.x[col[p]], axis=1)[:, -1]
                order = np.lexsort((b.ids[col], -exact, row))
                row, col, exact = row[order], col[order], exact[order]
                begin = np.searchsorted(row, np.arange(len(about) + 1))
                for i in range(len(about)):
                    p = slice(begin[i], min(begin[i + 1], begin[i] + k))
                    out["query_id"].append(int(a.ids[lo + i]))
                    out["vec_ids"].append(b.ids[col[p]])
                    out["scores"].append(exact[p])
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema})

    return run


def _merge(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def finish(query: int, tiles: list) -> list[tuple]:
        best = heapq.merge(*tiles)
        return [(query, i + 1, v, -s) for i, (s, v) in zip(range(k), best, strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, tiles = None, []
        for b in batches:
            rows: list[tuple] = []
            for q, v, s in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if q != query:
                    rows += finish(query, tiles) if tiles else []
                    query, tiles = q, []
                tiles.append([(-x, y) for x, y in zip(s, v, strict=True)])
                if len(tiles) > 64:  # what is held stays small, however many tiles there are
                    tiles = [[x for x, _ in zip(heapq.merge(*tiles), range(k), strict=False)]]
            yield record_batch(schema, **{f.name: [r[i] for r in rows] for i, f in enumerate(schema)})
        if tiles:
            rows = finish(query, tiles)
            yield record_batch(schema, **{f.name: [r[i] for r in rows] for i, f in enumerate(schema)})

    return run


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id and vec of the rows that take part; the length is that of most of them."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(~bad).where(F.exists("vec", lambda c: c != 0))
    size = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("vec") == (size["d"] if size else 0))
    return rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, block: int = 4096, block_bytes: int = 24 << 20, step: int = 256) -> DataFrame:
    """Each query's k nearest: query_id, rank, vec_id, score; queries are the rows whose id is divisible by ``every``."""
    rows = usable(vectors, key, vector)
    spark = rows.sparkSession
    n, n_q, d = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("vec"))).first()
    block = max(1, min(block, block_bytes // (8 * max(d or 1, 1))))
    c_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // (4 * block)))

    def blocks(df: DataFrame, count: int) -> DataFrame:
        df = df.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int"))
        return df.groupBy("block").applyInArrow(_pack, _BLOCK)

    left = blocks(rows.where(F.col("vec_id") % every == 0), q_blocks).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1)))).withColumnRenamed("block", "qb")
    right = blocks(rows, c_blocks).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))).withColumnRenamed("block", "cb")
    tiles = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInArrow(_tile(k, step), "query_id long, vec_ids array<long>, scores array<double>")
    return tiles.repartition(partitions(spark), "query_id").sortWithinPartitions("query_id").mapInArrow(_merge(k), "query_id long, rank int, vec_id long, score double")
