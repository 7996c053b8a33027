"""Toxicity by multiple-instance learning: documents are bags of sentences, and only the bags have labels.

A sentence's logit is a bias plus a weight for each of its words; a word's weight is the sum over hashes of the word and
of its beginnings, so it also covers unseen forms of a stem. A document is toxic if one of its sentences is (noisy-or).
Training follows the gradient of the documents' likelihood, so it finds out which sentences are to blame.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .shingles import _BYTE, _LOWER, _SPACE, _powers, mix

#: Labelled documents that training takes at most: the bound of the sample, drawn by a hash of the id.
SAMPLE = 8_000
BITS = 18
#: Lengths in bytes of the beginnings of words that are features besides whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Hash buckets that training keeps: those whose share of toxic documents differs most from that of others.
FEATURES = 6_000
_END = np.zeros(256, dtype=bool)
_END[[ord(c) for c in ".!?"]] = True
_LETTER = ~_SPACE
_LETTER[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = False


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts in order: buckets (words x features), sentence; and each sentence's text and start byte.

    Words are runs of characters other than white space and ASCII marks, with A-Z lower-cased. A sentence ends at a
    line feed, or at . ! ? between a word and white space; those without words don't count.
    """
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_LETTER[buf], prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _powers(len(buf))
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[buf]] * power, out=total[1:])
    mask = np.uint64((1 << BITS) - 1)
    out = np.empty((len(starts), 1 + len(PREFIXES)), dtype=np.int64)
    out[:, 0] = mix((total[ends] - total[starts]) * inverse[starts] + np.uint64(1)) & mask
    for i, k in enumerate(PREFIXES):
        stop = np.minimum(starts + k, ends)
        h = mix((total[stop] - total[starts]) * inverse[starts] + np.uint64(k)) & mask
        out[:, i + 1] = np.where(ends - starts >= k, h, 1 << BITS)  # one bucket more, always of weight 0
    stop = _END[buf]
    stop[:-1] &= _SPACE[buf[1:]]
    stop[1:] &= _LETTER[buf[:-1]]
    end = np.cumsum(stop | (buf == 10))
    sentence = end[starts]
    found, first, sentence = np.unique(sentence, return_index=True, return_inverse=True)
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    return out, sentence, np.searchsorted(bounds, starts[first], side="right") - 1, starts[first]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def bag_scores(z: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Noisy-or of sentence logits per document: 1 - prod(1 - p)."""
    return -np.expm1(-np.bincount(doc, weights=_softplus(z), minlength=n))


def train(texts: list[str | None], labels: np.ndarray, rounds: int = 400, penalty: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights by bucket, and the bias. Without documents of both labels the score is the share of toxic ones."""
    n, y = len(texts), np.asarray(labels, dtype=np.float64)
    weights = np.zeros((1 << BITS) + 1)
    if not n or y.min() == y.max():
        return weights, -40.0 if not n or y.max() == 0 else 40.0
    size = (1 << BITS) + 1
    counts = np.zeros((2, size))
    for at in range(0, n, 256):
        x, s, d, _ = features(texts[at : at + 256])
        in_doc, bucket = np.divmod(np.unique(np.repeat(d[s], x.shape[1]) * size + x.ravel()), size)
        for label in (0, 1):
            counts[label] += np.bincount(bucket[y[at + in_doc] == label], minlength=size)
    share = (counts + 0.5) / (np.array([(y == 0).sum(), (y == 1).sum()])[:, None] + 1.0)
    gain = np.abs(share[1] - share[0]) / np.sqrt(share.sum(axis=0))
    gain[-1] = -1
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    cells, docs, sentences = [], [], 0
    for at in range(0, n, 256):  # once more, for the chosen buckets alone
        x, s, d, _ = features(texts[at : at + 256])
        word, feature = np.nonzero(place[x] >= 0)
        cells.append(np.unique((s[word] + sentences) * len(chosen) + place[x[word, feature]]))  # counts once in a sentence
        docs.append((d + at).astype(np.int32))
        sentences += len(d)
    row, col = (v.astype(np.int32) for v in np.divmod(np.concatenate(cells), len(chosen)))
    doc = np.concatenate(docs)
    del cells, docs
    w, b = np.zeros(len(chosen)), -5.0
    sum_w, sum_b = np.full(len(w), 1e-8), 1e-8
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        z = b + np.bincount(row, weights=w[col], minlength=sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        bag = np.clip(bag_scores(z, doc, n), 1e-9, 1 - 1e-9)
        pull = np.where(y == 1, -(1 - bag) / bag, 1.0) * balance / n
        g = p * pull[doc]
        gw = np.bincount(col, weights=g[row], minlength=len(w)) + penalty * w
        gb = g.sum()
        sum_w += gw * gw
        sum_b += gb * gb
        w -= 0.5 * gw / np.sqrt(sum_w)
        b -= 0.2 * gb / np.sqrt(sum_b)
    weights[chosen] = w
    return weights, float(b)


def _sentence_logits(texts: list[str | None], weights: np.ndarray, bias: float):
    x, s, d, at = features(texts)
    word, feature = np.nonzero(weights[x])
    # a word that occurs twice in a sentence counts once, as in training, for each of its buckets
    row, bucket = np.divmod(np.unique(s[word] * np.int64((1 << BITS) + 1) + x[word, feature]), (1 << BITS) + 1)
    return bias + np.bincount(row, weights=weights[bucket], minlength=len(d)), d, at


def held_out(doc_id: int | None) -> bool:
    """Whether labels of this document are kept from training."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The model from at most ``sample`` labelled documents whose crc32(doc_id) mod 5 is not 0.

    Labels other than 0 and 1, and null ids, teach nothing; a document with several labels is toxic if one says so.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # the documented bound
    ids = known.withColumnRenamed("doc_id", "_id")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"]).select("doc_id", "text", "toxic").toPandas().sort_values("doc_id")
    return train(rows["text"].tolist(), rows["toxic"].to_numpy())


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences) for each row of (doc_id, text).

    ``sentences`` are those that score 0.5 or more by themselves, as (start, score): the code point where their first word
    starts. A text without words, null ones included, has score 0 unless all labels are 1. Repeated rows score alike;
    a null doc_id is not held out. An empty table gives no rows; without labels all scores are 0.
    """
    weights, bias = fit(docs, labels, sample)
    used = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((used, weights[used], bias))  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, b0 = shared.value
        w = np.zeros((1 << BITS) + 1)
        w[at] = value
        for b in batches:
            for s in range(0, b.num_rows, 256):
                x = b.slice(s, 256)
                ids, texts = x.column(0).to_pylist(), x.column(1).to_pylist()
                z, d, start = _sentence_logits(texts, w, b0)
                p = np.clip(bag_scores(z, d, len(ids)), 0, 1)
                bad = [[] for _ in ids]
                first = np.cumsum([0] + [len((t or "").encode()) + 1 for t in texts])
                for i in np.flatnonzero(z >= 0):
                    own = d[i]
                    bad[own].append({"start": len(texts[own].encode()[: start[i] - first[own]].decode()), "score": float(1 / (1 + np.exp(-z[i])))})
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([i is not None and held_out(i) for i in ids], pa.bool_()), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32)), pa.array(bad, pa.list_(pa.struct([("start", pa.int64()), ("score", pa.float64())])))],
                    names=["doc_id", "held_out", "score", "predicted", "sentences"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, sentences array<struct<start:long,score:double>>")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    return score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
