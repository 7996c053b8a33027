"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus-wide frequency order, so common ids take one byte. A block keeps two bits
per id (data bytes less one), four ids to a control byte, apart from the data bytes. Decoding looks lengths and
offsets up by control byte in numpy tables. Blocks hold whole documents in ascending doc_id order and are rows of a
Parquet table, so any store that Spark writes can keep them and a lost task is simply written again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, new_path, partitions, release, save
from .shingles import text_slices
from .tokenization import encoder

#: For each control byte: the data bytes of its four ids, their offsets, and the sum.
SIZES = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.int8) + np.int8(1)
OFFSETS = (np.cumsum(SIZES, axis=1) - SIZES).astype(np.int8)
TOTALS = SIZES.sum(axis=1)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    width = 2 if len(values) and int(values.max()) < 1 << 16 else 4
    v = np.ascontiguousarray(values, dtype=f"<u{width}")
    code = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    for k in range(1, width):
        code[: len(v)] += v >= 1 << (8 * k)
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    keep = np.arange(width, dtype=np.uint8) <= code[: len(v), None]
    return control.tobytes(), v.view(np.uint8).reshape(-1, width)[keep].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of control and data bytes."""
    c = np.frombuffer(control, dtype=np.uint8)
    start = np.cumsum(TOTALS[c]) - TOTALS[c]
    at = (start[:, None] + OFFSETS[c]).ravel()[:n]
    size = SIZES[c].ravel()[:n]
    raw = np.frombuffer(data + b"\0" * 8, dtype=np.uint8)  # the last id of a short group reads past its end
    out = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        more = np.flatnonzero(size > k)
        out[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _staged_schema() -> str:
    return "doc_id long, part int, row long, ids binary"


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int | None, id_column: str = "doc_id", text_column: str = "text", added: bool = False) -> DataFrame:
    """(doc_id, part, row, ids): little-endian unsigned 32-bit ids of whole texts, in ascending doc_id order.

    ``part`` is a range of doc_ids, ``row`` the place in it; nulls sort first and equal doc_ids by a hash of the text. A
    null text is empty. ``added`` as in ChunkEncoder. A task's last row, of row -1, has how often it saw each id, as 64-bit integers.
    """
    n = partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).repartitionByRange(n, F.col("doc_id"), tie).sortWithinPartitions("doc_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, added=added)
        seen = np.zeros(0, dtype="<i8")
        width, end = bytes([enc.width]), np.array([end_id] if end_id is not None else [], dtype=f"<u{enc.width}").tobytes()
        for b in batches:
            for x in text_slices(b, 1, 4096, 1 << 23):
                flat, at = enc.encode_flat(x.column(1).to_pylist())
                count = np.bincount(flat, minlength=len(seen))
                count[: len(seen)] += seen
                seen, cuts = count.astype("<i8"), at.tolist()
                ids = [b"".join((width, flat[s:e].tobytes(), end)) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(range(row, row + len(ids)), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "part", "row", "ids"])
                row += len(ids)
        if end_id is not None and row:
            seen = np.pad(seen, (0, max(0, end_id + 1 - len(seen))))
            seen[end_id] += row
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([part], pa.int32()), pa.array([-1], pa.int64()), pa.array([seen.tobytes()], pa.binary())], names=["doc_id", "part", "row", "ids"])

    return ordered.mapInArrow(run, _staged_schema())


def unpack(ids: bytes) -> np.ndarray:
    """The ids of tokenize(), whose first byte is their width."""
    return np.frombuffer(ids, dtype=f"<u{ids[0]}", offset=1)


def id_counts(staged: DataFrame) -> DataFrame:
    """(id, n): occurrences of each id in the corpus, from the counts of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                total = np.frombuffer(c, dtype="<i8")
                ids = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return staged.where("row = -1").select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, block_ids: int = 1 << 18, added: bool = False) -> None:
    """Writes the ids of all documents below path: ``blocks`` (Parquet rows, each a coded block) and ``ranks``.

    The rank table has at most one row for each id of the vocabulary, which bounds what reaches the driver. A block ends
    at block_ids ids, or holds one longer document. ``added`` as in ChunkEncoder. An empty table gives no blocks.
    """
    spark = docs.sparkSession
    staged = save(tokenize(docs, tokenizer_path, end_id, added=added), "ids")
    release(spark)
    top = id_counts(staged).toPandas().sort_values(["n", "id"], ascending=[False, True])
    order = top["id"].to_numpy(dtype=np.int64)
    spark.createDataFrame([(order.astype("<u4").tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    rank = np.zeros(int(order.max(initial=0)) + 1, dtype=np.uint16 if len(order) <= 1 << 16 else np.uint32)
    rank[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size, nxt = shared.value, [], 0, None

        def block() -> pa.RecordBatch:
            got = [unpack(i) for *_, i in held]
            control, data = encode_values(table[np.concatenate(got)])
            return pa.RecordBatch.from_arrays(
                [pa.array([held[0][1]], pa.int32()), pa.array([held[0][2]], pa.int64()), pa.array([[d for d, *_ in held]], pa.list_(pa.int64())), pa.array([[len(g) for g in got]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())],
                names=["part", "row", "doc_ids", "lengths", "control", "data"],
            )

        for b in batches:
            for s in range(0, b.num_rows, 512):
                x = b.slice(s, 512)
                for d, p, r, i in zip(*(x.column(k).to_pylist() for k in range(4)), strict=True):
                    n = (len(i) - 1) // i[0]
                    if held and ((p, r) != nxt or size + n > block_ids):
                        yield block()
                        held, size = [], 0
                    held.append((d, p, r, i))
                    size, nxt = size + n, (p, r + 1)
        if held:
            yield block()

    schema = "part int, row long, doc_ids array<long>, lengths array<long>, control binary, data binary"
    staged.where("row >= 0").select("doc_id", "part", "row", "ids").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    shared.unpersist()
    drop(staged)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, row, ids): decoded documents; ids are little-endian unsigned 32-bit."""
    return _decoded(spark, path, "doc_id long, part int, row long, ids binary", lambda ids: ids.tobytes(), pa.binary(), ["ids"])


def digest_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents in the files."""
    rows = save(_decoded(spark, path, "doc_id long, part int, row long, n_tokens long, ids_crc32 long", lambda ids: (len(ids), zlib.crc32(ids)), pa.int64(), ["n_tokens", "ids_crc32"]), "digest")
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per part
    offset = totals.select("part", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("own", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(F.broadcast(offset), "part").select("doc_id", (F.col("own") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def _decoded(spark: SparkSession, path: str, schema: str, of, kind, names: list[str]) -> DataFrame:
    first = spark.read.parquet(f"{path}/ranks").first()
    shared = spark.sparkContext.broadcast(np.frombuffer(first[0], dtype="<u4"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n = np.array(r["lengths"], dtype=np.int64)
                ids = shared.value[decode_values(r["control"], r["data"], int(n.sum()))]
                ends = np.cumsum(n)
                got = [of(ids[e - k : e]) for e, k in zip(ends, n, strict=True)]
                cols = list(zip(*got, strict=True)) if len(names) > 1 else [got]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array([r["part"]] * len(n), pa.int32()), pa.array(range(r["row"], r["row"] + len(n)), pa.int64()), *(pa.array(c, kind) for c in cols)], names=["doc_id", "part", "row", *names])

    return spark.read.parquet(f"{path}/blocks").mapInArrow(run, schema)


def op2_token_ids(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Digest per document, from the files that the operator wrote: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    from .common import read_table

    path = new_path(spark, "token-files")
    write_ids(read_table(spark, sf_dir, "documents"), path, tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), added=True)
    return digest_ids(spark, path)
