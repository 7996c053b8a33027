"""Exact top-k search: tiled matrix products, partial selection per tile, and tree merging of the top lists.

Vectors are packed into shards and queries into tiles of fixed size. Shards are dealt out to groups, each group gets a
copy of every tile, and each (tile, shard) pair is one matrix product. Of each product only k entries per query leave
the task. The lists of a tile are merged sixteen at a time until one is left, so no task holds more than sixteen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read_table, save

_PACKED = "part int, seq int, n int, dim int, ids binary, vectors binary"
_LISTS = "tile_part int, tile_seq int, idx long, n int, query_ids binary, vec_ids binary, scores binary"
FAN_IN = 16
_NONE = -np.iinfo(np.int64).max  # the score of an empty place in a list; its negative is still a 64-bit integer


def pack(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors of (vec_id, embedding), as floor(1024 * x) in 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, kept = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            dim = max(len(v) for v in kept)
            m = np.zeros((len(kept), dim), dtype="<i8")  # shorter vectors count as padded with zeros
            for i, v in enumerate(kept):
                m[i, : len(v)] = v
            order = np.argsort(np.array(ids, dtype="<i8"), kind="stable")
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int32()), (seq, pa.int32()), (len(ids), pa.int32()), (dim, pa.int32()))] + [pa.array([np.array(ids, dtype="<i8")[order].tobytes()], pa.binary()), pa.array([m[order].tobytes()], pa.binary())],
                names=["part", "seq", "n", "dim", "ids", "vectors"],
            )

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.asarray(v.values, dtype=np.float64)
                if not np.isfinite(x).all() or v.values.null_count:
                    continue
                ids.append(i)
                kept.append(np.floor(1024 * x).astype(np.int64))
                if len(ids) == rows:
                    yield block()
                    seq, ids, kept = seq + 1, [], []
        if ids:
            yield block()

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and embedding is not null").mapInArrow(run, _PACKED)


def _matrix(row: dict, ids: str = "ids", vectors: str = "vectors") -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(row[ids], dtype="<i8")
    return i, np.frombuffer(row[vectors], dtype="<i8").reshape(len(i), -1)


def product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where every partial sum is an integer that it holds exactly."""
    dim = max(q.shape[1], x.shape[1])
    q, x = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, x))
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(dim, 1)
    for kind, most in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < most:
            return (q.astype(kind) @ x.astype(kind).T).astype(np.int64)
    return q @ x.T


def select(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best (vec_id, score) of each row: by score, ties to the smaller id; short rows are filled up with _NONE."""
    n, m = scores.shape
    cols = np.broadcast_to(ids, scores.shape) if ids.ndim == 1 else ids
    if m > k:
        # every entry over the k-th score, and of its ties those with the smallest ids
        kth = np.partition(scores, m - k, axis=1)[:, m - k]
        r, c = np.nonzero(scores >= kth[:, None])
        s, v = scores[r, c], cols[r, c]
        order = np.lexsort((v, -s, r))
        r, s, v = r[order], s[order], v[order]
        first = np.searchsorted(r, np.arange(n))
        place = np.arange(len(r)) - first[r]
        keep = place < k
        out_v, out_s = np.zeros((n, k), dtype=np.int64), np.full((n, k), _NONE, dtype=np.int64)
        out_v[r[keep], place[keep]], out_s[r[keep], place[keep]] = v[keep], s[keep]
        return out_v, out_s
    order = np.lexsort((cols, -scores), axis=1)
    v, s = np.take_along_axis(cols, order, 1), np.take_along_axis(scores, order, 1)
    return np.pad(v, ((0, 0), (0, k - m))), np.pad(s, ((0, 0), (0, k - m)), constant_values=_NONE)


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, tile_rows: int = 1024, shard_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each query row of (vec_id, embedding).

    A row is its own by vec_id: rows that carry the query's vec_id are never its candidates; equal candidates each take
    a place. Null ids and vectors that are null, or hold a null or non-finite component, take no part. Shorter vectors
    count as padded with zeros. With fewer than k candidates all are returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    shards = save(pack(vectors, shard_rows), "shards")
    most = shards.agg(F.max("part").alias("p"), F.max("seq").alias("s"), F.count("*").alias("n")).first()
    if not most["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts, groups = most["p"] + 1, min(partitions(spark), most["n"])
    idx = F.col("seq").cast("long") * parts + F.col("part")
    dealt = shards.select(idx.alias("idx"), F.pmod(F.xxhash64("part", "seq"), F.lit(groups)).alias("g"), "ids", "vectors")
    tiles = pack(vectors.where(is_query), tile_rows).select(F.col("part").alias("tile_part"), F.col("seq").alias("tile_seq"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors"))
    tiles = tiles.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("g", F.col("g").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                qi, q = _matrix(row, "query_ids", "query_vectors")
                xi, x = _matrix(row)
                s = product(q, x)
                lo, hi = np.searchsorted(xi, qi, "left"), np.searchsorted(xi, qi, "right")
                for r in np.flatnonzero(hi > lo):
                    s[r, lo[r] : hi[r]] = _NONE
                v, s = select(s, xi, k)
                yield pa.RecordBatch.from_pylist([{"tile_part": row["tile_part"], "tile_seq": row["tile_seq"], "idx": row["idx"], "n": len(qi), "query_ids": qi.tobytes(), "vec_ids": v.tobytes(), "scores": s.tobytes()}], schema=_arrow_lists())

    lists = dealt.join(tiles.hint("merge"), "g").mapInArrow(run, _LISTS)

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        v, s = (np.hstack([np.frombuffer(x, dtype="<i8").reshape(n, k) for x in rows[c]]) for c in ("vec_ids", "scores"))
        v, s = select(s, v, k)
        return pd.DataFrame({"tile_part": rows["tile_part"].iloc[:1], "tile_seq": rows["tile_seq"].iloc[:1], "idx": rows["idx"].iloc[:1] // FAN_IN, "n": [n], "query_ids": rows["query_ids"].iloc[:1], "vec_ids": [v.tobytes()], "scores": [s.tobytes()]})

    left = (most["s"] + 1) * parts
    while left > 1:
        lists = lists.groupBy("tile_part", "tile_seq", F.floor(F.col("idx") / FAN_IN).alias("to")).applyInPandas(merge, _LISTS)
        left = -(-left // FAN_IN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q = np.frombuffer(row["query_ids"], dtype="<i8")
                v, s = (np.frombuffer(row[c], dtype="<i8").reshape(len(q), k) for c in ("vec_ids", "scores"))
                r, c = np.nonzero(s != _NONE)
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array((c + 1).astype(np.int32)), pa.array(v[r, c]), pa.array(s[r, c])], names=["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(rows, "query_id long, rank int, vec_id long, score long")


def _arrow_lists() -> pa.Schema:
    return pa.schema([("tile_part", pa.int32()), ("tile_seq", pa.int32()), ("idx", pa.int64()), ("n", pa.int32()), ("query_ids", pa.binary()), ("vec_ids", pa.binary()), ("scores", pa.binary())])


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all rows of embeddings for each row whose vec_id is divisible by 100."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
