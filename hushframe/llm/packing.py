"""Packing by shortest-pack-first over the length histogram.

Documents are cut into pieces of at most a sequence's length. Lengths are placed longest first, each into the open packs
with the most room left; all packs that look alike are one pattern with a count, so the plan depends on the histogram
alone, whatever the number of documents. Pieces then find their pattern by their rank among pieces of their length.

One document in ``sand_every`` has the rest of its tokens cut into powers of two; these fill the gaps that others leave.
"""

from __future__ import annotations

import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, save
from .shingles import text_slices
from .tokenization import encoder

SEQUENCE = 2048
SAND_EVERY = 10
#: Bytes of text that are encoded at once, and pieces of chunks in a generation of the encoder's cache.
AT_ONCE, CACHED = 1 << 21, 200_000
_PIECES = "doc_id long, part int, row long, start long, length long, ids_crc32 long, doc_tokens long"


def cut(n: int, size: int, sand: bool) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the rest, in powers of two if it is sand."""
    rest = n % size
    parts = [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if sand else [rest] * (rest > 0)
    return [size] * (n // size) + parts


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, size: int = SEQUENCE, sand_every: int = SAND_EVERY, added: bool = False) -> DataFrame:
    """Rows of _PIECES for whole texts of (doc_id, text): ids of each document with the end id, cut and digested.

    ``part`` and ``row`` number the pieces of a task. ``added`` as in ChunkEncoder. A task encodes AT_ONCE bytes of text at a
    time (or one longer text) and leaves no cached pieces in its worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path, CACHED, added)
        end = np.array([end_id] if end_id is not None else [], dtype=f"<u{enc.width}").tobytes()
        for b in batches:
            for x in text_slices(b, 1, 4096, AT_ONCE):
                out = []
                for d, ids in zip(x.column(0).to_pylist(), enc.encode(x.column(1).to_pylist()), strict=True):
                    raw = np.frombuffer(ids + end, dtype=f"<u{enc.width}").astype("<u4").tobytes()
                    n, at = len(raw) // 4, 0
                    for k in cut(n, size, zlib.crc32(str(d).encode()) % sand_every == 0):
                        out.append((d, at, k, zlib.crc32(memoryview(raw)[4 * at : 4 * (at + k)]), n))
                        at += k
                doc, start, length, crc, total = zip(*out, strict=True) if out else ((),) * 5
                rows = np.arange(row, row + len(out))
                row += len(out)
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array([part] * len(out), pa.int32()), pa.array(rows, pa.int64()), *(pa.array(c, pa.int64()) for c in (start, length, crc, total))], names=["doc_id", "part", "row", "start", "length", "ids_crc32", "doc_tokens"])
        enc.forget()  # workers outlive their task, and later stages need the memory

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECES)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of each pattern.

    A step uses up a length or a pattern, or opens at most two, so there are at most three patterns for each length.
    """
    room: dict[int, list[list]] = {}  # space left: patterns of [count, lengths]
    heap: list[int] = []

    def put(space: int, count: int, lengths: tuple) -> None:
        if space not in room:
            room[space] = []
            heapq.heappush(heap, -space)
        room[space].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            while heap and not room[-heap[0]]:
                del room[-heapq.heappop(heap)]
            space = -heap[0] if heap else -1
            if space < length:  # new packs take as many of this length as fit, as they have the most room from then on
                fit = size // length
                if left >= fit:
                    put(size - fit * length, left // fit, (length,) * fit)
                if left % fit:
                    put(size - left % fit * length, 1, (length,) * (left % fit))
                break
            count, lengths = room[space].pop()
            n = min(count, left)
            if count > n:
                room[space].append([count - n, lengths])
            put(space - length, n, (*lengths, length))
            left -= n
    return [(c, p) for entries in room.values() for c, p in entries]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset, count), sorted: where pieces of a length go, by rank.

    A row stands for all places of one length in a pattern: rank by rank through its ``count`` sequences, then again at the
    next offset. A pattern has at most as many rows as different lengths fit in a sequence (63 for 2048), and there are
    at most three patterns a length, so the table is bounded whatever the number of documents.
    """
    out, taken, sequence = [], {}, 0
    for count, lengths in patterns:
        offset = 0
        for k, same in itertools.groupby(lengths):
            n = sum(1 for _ in same)
            rank = taken.get(k, 0)
            out.append((k, rank, sequence, offset, count))
            taken[k], offset = rank + n * count, offset + n * k
        sequence += count
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, size: int = SEQUENCE, sand_every: int = SAND_EVERY, added: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents in sequences.

    A sequence holds at most ``size`` ids, its pieces gapless from offset 0. A null or empty text is its end id alone,
    and nothing without one. Repeated rows are packed as often as they occur; null ids are kept. An empty table gives no
    rows. ``added`` as in ChunkEncoder.
    """
    found = save(pieces(docs, tokenizer_path, end_id, size, sand_every, added), "pieces")
    counts = save(found.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = slots(plan(histogram, size))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("part", "length").orderBy("row")
    ranked = found.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["part", "length"]).withColumn("rank", F.col("own") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            # the last slot of this length that starts at or before the rank
            at = np.empty(len(rank), dtype=np.int64)
            for k in np.unique(length):
                lo, hi = np.searchsorted(t[:, 0], [k, k + 1])
                own = length == k
                at[own] = lo + np.searchsorted(t[lo:hi, 1], rank[own], side="right") - 1
            turn, nth = np.divmod(rank - t[at, 1], t[at, 4])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(t[at, 2] + nth), pa.array(t[at, 3] + turn * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank")).mapInArrow(place, out)


def op7_packing(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), added=True)
