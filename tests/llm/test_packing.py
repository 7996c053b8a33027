import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from hushframe.llm import packing, tokenization


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=30))
def test_plan_places_every_length_once(histogram):
    patterns = packing.plan(histogram, 64)
    placed = Counter()
    for count, lengths in patterns:
        assert sum(lengths) <= 64 and count > 0
        for k in lengths:
            placed[k] += count
    assert placed == histogram and len(patterns) <= 3 * len(histogram)
    # every rank of every length has a place of its own; together they fill sequences from 0 without gaps
    table, sequences = packing.slots(patterns), defaultdict(list)
    for k, n in histogram.items():
        rows = table[table[:, 0] == k]
        for rank in range(n):
            _, first, sequence, offset, count = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1].tolist()
            turn, nth = divmod(rank - first, count)
            sequences[sequence + nth].append((offset + turn * k, k))
    for places in sequences.values():
        ends = np.cumsum([k for _, k in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert len(sequences) == sum(c for c, _ in patterns)


@given(st.integers(0, 5000), st.booleans())
def test_cut_adds_up(n, sand):
    assert sum(packing.cut(n, 2048, sand)) == n


def check(rows, got, size=2048):
    ref = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ref.encode_special_tokens = True
    want = Counter()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d in {d for d, _ in rows}:
        ids = [ref.encode(t or "", add_special_tokens=False).ids + [1] for x, t in rows if x == d]
        want = Counter((len(i), zlib.crc32(np.array(i[r.start : r.start + r.length], "<u4").tobytes())) for i in ids for r in pieces[d] if r.doc_tokens == len(i))
        assert sum(r.length for r in pieces[d]) == sum(map(len, ids))
        assert {(r.doc_tokens, r.ids_crc32) for r in pieces[d]} <= set(want)
        if len(ids) == 1:
            at = 0
            for r in sorted(pieces[d], key=lambda r: r.start):
                assert r.start == at
                at += r.length
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= size
    assert sorted(sequences) == list(range(len(sequences)))
    return len(sequences), sum(r.length for r in got)


def test_pieces_and_sequences(spark):
    r = random.Random(1)
    words = ["the", "quick", "Brown", "naïve", "fox,", "x" * 40, "12345", "日本"]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 5, 300, 900, 1500])))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (1002, "twice"), (1002, "twice"), (1003, "word " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "'x' as length").repartition(5)
    n, total = check(rows, packing.pack(docs, P.path("word_bpe_49k.json")).collect())
    assert total / (n * 2048) > 0.98
    assert packing.pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_a_task_encodes_little_at_once_and_leaves_no_cache(spark, monkeypatch):
    class Rows:
        select = lambda self, *_: self
        mapInArrow = lambda self, run, _: run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr("pyspark.TaskContext", Task)
    path, r, sizes = P.path("word_bpe_49k.json"), random.Random(3), []
    enc = tokenization.encoder(path, added=True)
    encode = enc.encode
    monkeypatch.setattr(enc, "encode", lambda texts: sizes.append([len(t) for t in texts]) or encode(texts))
    texts = ["".join(r.choices("abcdefgh ", k=1500)) * 40 for _ in range(120)] + ["long " * 600_000]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    rows = pa.Table.from_batches(packing.pieces(Rows(), path, added=True)([batch]))
    assert sum(map(len, sizes)) == len(texts) and all(len(s) == 1 or sum(s) <= 1 << 21 for s in sizes)
    assert not enc.pieces and not enc.pieces._before
    assert set(rows["doc_id"].to_pylist()) == set(range(len(texts)))
