"""Quality classifier by co-training over two views of a document: its text, and its metadata.

Each view has its own logistic model. They start from labelled documents. In each round, each view labels every other
document of the corpus that it is sure of, for the other one to learn from: a distributed pass over the features of all
documents returns sums alone (counts by metadata cell, and the terms of a Newton step for the text), so the pool has no
bound and the driver's share doesn't grow with it. Then each view's logit is calibrated on one fold of labelled documents
that it never learned from, and the calibrated logits are combined by a last logistic model fitted on another.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, read_table, save
from .shingles import text_slices, words

#: Bound of the labelled sample, drawn by a hash of the id. All other documents are the unlabelled pool.
LABELLED = 12_000
ROUNDS = 5
#: A pseudo-label is given from this confidence on. Those of a kind weigh at most half of the labelled documents of that kind.
SURE, SHARE = 0.97, 0.5
#: Newton steps of the text's model in a round.
STEPS = 3
#: Of the labelled documents, one in FOLDS is for calibration only, and one for the combination only.
FOLDS = 6
_SOURCES, _LANGS, _SIZES = 64, 16, 32
CELLS = _SOURCES * _LANGS * _SIZES


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=np.float32)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES = [_UPPER, _table("0123456789"), _table("#$%&*@^~+=<>\\/_"), _table("|"), _table("!?"), _table(".,;:"), _table("()[]{}\"'`-"), _table("\n"), _table(" \t")]
_HIGH = np.zeros(256, dtype=np.float32)
_HIGH[128:] = 1
#: Text features: shares of the classes and of high bytes and five of words, their roots, and whether there are no words.
WIDTH = 2 * (len(_CLASSES) + 1 + 5) + 1


def content_features(texts: list[str | None]) -> np.ndarray:
    """Text statistics of each document; an empty or null text has zeros and a one in the last column."""
    if not texts:
        return np.zeros((0, WIDTH))
    raw = [(t or "").encode() for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    lengths = np.array([len(r) for r in raw])
    starts = np.cumsum([0, *(lengths[:-1] + 1)])
    size = np.maximum(lengths, 1).astype(np.float64)
    columns = []
    for t in (*_CLASSES, _HIGH):
        n = np.add.reduceat(t[buf], starts)
        if t[10]:
            n = n - 1  # the one that parts the documents
        columns.append(n / size)
    w, at = words(raw)
    n = np.diff(at).astype(np.float64)
    distinct, top, pairs = np.zeros(len(raw)), np.zeros(len(raw)), np.zeros(len(raw))
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if e > s:
            _, c = np.unique(w[s:e], return_counts=True)
            distinct[i], top[i] = len(c), c.max()
            pairs[i] = len(np.unique(w[s : e - 1] * np.uint64(31) ^ w[s + 1 : e])) if e - s > 1 else 1
    many = np.maximum(n, 1)
    columns += [lengths / many / 20, distinct / many**0.8, top / many, pairs / many, np.log1p(n) / 8]
    x = np.column_stack(columns)
    x = np.column_stack([x, np.sqrt(np.abs(x)), n == 0])
    x[n == 0, :-1] = 0
    return x.astype(np.float32).astype(np.float64)  # as the features' table keeps them


def metadata_cell(source: Column, lang: Column, n_chars: Column) -> Column:
    """Hashes of source and language and the size's order of magnitude as one number; nulls are values of their own."""
    hashed = lambda c, n: F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("\0"))), F.lit(n))
    size = n_chars.cast("double")
    order = F.least(F.lit(_SIZES - 1), 1 + F.floor(2 * F.log2(F.greatest(size, F.lit(0.0)) + 1)))
    order = F.when(size.isNull() | F.isnan(size), F.lit(0)).otherwise(order)
    return ((hashed(source, _SOURCES) * _LANGS + hashed(lang, _LANGS)) * _SIZES + order).cast("int")


def one_hot(cells: np.ndarray) -> np.ndarray:
    """The metadata view of cells: a one each for source, language and size."""
    cells = np.asarray(cells, dtype=np.int64)
    x, at = np.zeros((len(cells), _SOURCES + _LANGS + _SIZES)), np.arange(len(cells))
    x[at, cells // (_LANGS * _SIZES)] = 1
    x[at, _SOURCES + cells // _SIZES % _LANGS] = 1
    x[at, _SOURCES + _LANGS + cells % _SIZES] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _terms(z: np.ndarray, w: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-likelihood at w."""
    s = np.ones(len(z)) if weight is None else weight
    p = _sigmoid(z @ w)
    return z.T @ (s * (y - p)), (z * (s * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z


@dataclass
class Logistic:
    """A standardized logistic model with ridge penalty, fitted by Newton's method."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    penalty: float = 1.0

    @classmethod
    def start(cls, x: np.ndarray, standard: bool = True, penalty: float = 1.0) -> Logistic:
        """All weights 0; means and scales of x, or none."""
        d = x.shape[1]
        if not standard:
            return cls(np.zeros(d), np.ones(d), np.zeros(d + 1), penalty)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1
        return cls(mean, scale, np.zeros(d + 1), penalty)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, standard: bool = True, penalty: float = 1.0) -> Logistic:
        out = cls.start(x, standard, penalty)
        z = out.inputs(x)
        for _ in range(40):
            if out.step(*_terms(z, out.weights, y, weight)) < 1e-6:
                break
        return out

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)])

    def step(self, gradient: np.ndarray, hessian: np.ndarray) -> float:
        """A Newton step; its largest part."""
        ridge = np.full(len(self.weights), self.penalty)
        ridge[0] = 1e-6
        step = np.linalg.solve(hessian + np.diag(ridge), gradient - ridge * self.weights)
        size = float(np.abs(step).max())
        self.weights = self.weights + step * min(1.0, 4 / max(size, 1e-9))
        return size

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.inputs(x) @ self.weights

    def p(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x))


@dataclass
class Model:
    """Both views and their combination; ``constant`` is the score where labels allow no model."""

    content: Logistic | None = None
    metadata: np.ndarray | None = None  # logit of each cell
    calibrated: list[Logistic] = field(default_factory=list)
    combined: Logistic | None = None
    constant: float = 1.0
    taught: list[tuple[int, int]] = field(default_factory=list)  # pseudo-labels for text and for metadata by round

    def scores(self, content: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, and the calibrated scores of text and metadata."""
        if self.combined is None:
            return (np.full(len(content), self.constant),) * 3
        logits = [c.logit(z[:, None]) for c, z in zip(self.calibrated, (self.content.logit(content), self.metadata[cells]), strict=True)]
        return (self.combined.p(np.column_stack(logits)), *map(_sigmoid, logits))


@dataclass
class Teachers:
    """What a pass over the pool needs: the text's model, and each view's calibrated confidence."""

    content: Logistic
    calibration: Logistic  # of the text's logit
    metadata: np.ndarray  # calibrated p of each cell


def pool_pass(content: np.ndarray, cells: np.ndarray, t: Teachers) -> np.ndarray:
    """Sums over rows of the pool: pseudo-labels by metadata cell that the text gives (0, then 1), and of those that
    metadata gives (0, then 1) the number, gradient and Hessian of the text's model."""
    d = len(t.content.weights)
    z = t.content.inputs(content)
    p = t.calibration.p((z @ t.content.weights)[:, None])
    out = [np.bincount(cells[p <= 1 - SURE], minlength=CELLS), np.bincount(cells[p >= SURE], minlength=CELLS)]
    m = t.metadata[cells]
    for label, sure in ((0.0, m <= 1 - SURE), (1.0, m >= SURE)):
        n = int(sure.sum())
        g, h = _terms(z[sure], t.content.weights, np.full(n, label)) if n else (np.zeros(d), np.zeros((d, d)))
        out += [np.array([n]), g, h.ravel()]
    return np.concatenate(out).astype(np.float64)


def _weights(pseudo: list[float], y: np.ndarray) -> list[float]:
    """What a pseudo-label of 0 and of 1 weighs."""
    return [SHARE * min(1.0, float((y == v).sum()) / max(n, 1.0)) for v, n in enumerate(pseudo)]


def co_train(content: np.ndarray, cells: np.ndarray, y: np.ndarray, fold: np.ndarray, over_pool: Callable[[Teachers], np.ndarray], rounds: int = ROUNDS) -> Model:
    """The model of labelled documents (fold 0: calibration, 1: combination, others: learning) and an unlabelled pool.

    ``over_pool`` gives the sum of pool_pass() over the whole pool. Rounds end early once pseudo-labels no longer change.
    """
    both = lambda at: len(np.unique(y[at])) == 2
    calibrate, combine = fold == 0, fold == 1
    if not (both(calibrate) and both(combine)):
        calibrate = combine = calibrate | combine
    learn = fold > 1
    if not (both(learn) and both(calibrate)):
        return Model(constant=float(y.mean()) if len(y) else 1.0)
    x, t = content[learn], y[learn]
    text = Logistic.fit(x, t)
    z, d = text.inputs(x), x.shape[1] + 1
    every = one_hot(np.arange(CELLS))
    used = np.zeros((2, CELLS))

    def metadata(counts: np.ndarray) -> np.ndarray:
        """The logit of each cell, learned from labelled documents and pseudo-labels by cell."""
        at = [np.flatnonzero(c) for c in counts]
        share = _weights([c.sum() for c in counts], t)
        rows = np.concatenate([cells[learn], *at])
        target = np.concatenate([t, np.zeros(len(at[0])), np.ones(len(at[1]))])
        weight = np.concatenate([np.ones(len(t)), *(c[a] * w for c, a, w in zip(counts, at, share, strict=True))])
        return Logistic.fit(one_hot(rows), target, weight, standard=False).logit(every)

    meta, taught, before = metadata(used), [], None
    for _ in range(rounds):
        own = Logistic.fit(meta[cells[calibrate]][:, None], y[calibrate]).p(meta[:, None])
        for k in range(STEPS):
            calibration = Logistic.fit(text.logit(content[calibrate])[:, None], y[calibrate])
            sums = over_pool(Teachers(text, calibration, own))
            counts, rest = sums[: 2 * CELLS].reshape(2, CELLS), sums[2 * CELLS :].reshape(2, 1 + d + d * d)
            if k == 0:
                used = counts  # both views teach from the models of the round before
            if not rest[:, 0].sum():
                break
            g, h = _terms(z, text.weights, t)
            for w, r in zip(_weights(rest[:, 0].tolist(), t), rest, strict=True):
                g, h = g + w * r[1 : 1 + d], h + w * r[1 + d :].reshape(d, d)
            if text.step(g, h) < 1e-4:
                break
        meta = metadata(used)
        taught.append((int(rest[:, 0].sum()), int(used.sum())))
        now = (rest[:, 0].tolist(), used.tobytes())
        if now == before:
            break
        before = now
    logits = [text.logit(content), meta[cells]]
    calibrated = [Logistic.fit(v[calibrate][:, None], y[calibrate]) for v in logits]
    joint = np.column_stack([c.logit(v[combine][:, None]) for c, v in zip(calibrated, logits, strict=True)])
    return Model(text, meta, calibrated, Logistic.fit(joint, y[combine]), taught=taught)


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, content, cell) for each row of documents: text features as 32-bit floats, and the metadata's cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in text_slices(b, 1):
                rows = content_features(x.column(1).to_pylist()).astype("<f4")
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), x.column(2)], names=["doc_id", "content", "cell"])

    cell = metadata_cell(F.col("source"), F.col("lang"), F.col("n_chars"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), cell.alias("cell")).mapInArrow(run, "doc_id long, content binary, cell int")


def _read(content, cell) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(content.to_pylist()), dtype="<f4").reshape(-1, WIDTH).astype(np.float64), cell.to_numpy().astype(np.int64)


def fit(table: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """The model from a bounded sample of labelled documents and all others of a saved table of views().

    Labels other than 0 and 1, and null ids, teach nothing; a document with several labels is bad if one says so, and one
    with several rows teaches by the least of them. Labelled documents beyond the bound belong to the unlabelled pool.
    """
    spark = table.sparkSession
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select(F.col("doc_id").cast("long").alias("_id"), F.col("y").cast("int").alias("y"))  # the documented bound
    drawn = table.join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    rows = drawn.groupBy("doc_id", "y").agg(F.min(F.struct("content", "cell")).alias("v")).select("doc_id", "y", "v.content", "v.cell").toArrow().sort_by("doc_id")
    doc = rows["doc_id"].to_numpy()
    content, cells = _read(rows["content"], rows["cell"])
    fold = np.array([zlib.crc32(f"fold {d}".encode()) % FOLDS for d in doc.tolist()], dtype=np.int64)

    def over_pool(t: Teachers) -> np.ndarray:
        shared = spark.sparkContext.broadcast((t, doc))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            teachers, sample = shared.value
            total = None
            for b in batches:
                b = b.filter(pa.array(~np.isin(b.column(0).fill_null(-(2**63)).to_numpy(), sample)))
                if b.num_rows:
                    own = pool_pass(*_read(b.column(1), b.column(2)), teachers)
                    total = own if total is None else total + own
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.float64())], names=["k", "v"])

        got = table.select("doc_id", "content", "cell").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # at most a row for each sum
        shared.unpersist()
        out = np.zeros(2 * CELLS + 2 * (1 + WIDTH + 1 + (WIDTH + 1) ** 2))
        out[got["k"].to_numpy()] = got["v"].to_numpy()
        return out

    return co_train(content, cells, rows["y"].to_numpy().astype(np.float64), fold, over_pool, rounds)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """(doc_id, quality, content_quality, metadata_quality, keep) for each row of documents.

    ``quality`` is the combined score (higher: label 1 likelier), the next two those of the views alone; ``keep`` is 1
    where quality is at least ``threshold``. Null texts and metadata are values like others; repeated rows score alike.
    Where the labels don't hold both kinds, all documents get the share of good labels, and 1 without labels. An empty
    table gives no rows. Other columns are ignored.
    """
    table = save(views(docs), "views")
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = shared.value.scores(*_read(b.column(1), b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(g, pa.float64()) for g in got), pa.array((got[0] >= threshold).astype(np.int32))], names=["doc_id", "quality", "content_quality", "metadata_quality", "keep"])

    return table.mapInArrow(run, "doc_id long, quality double, content_quality double, metadata_quality double, keep int")


def filter_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of docs that classify() keeps, in their own columns, scored in passing."""
    table = save(views(docs), "views")
    shared = docs.sparkSession.sparkContext.broadcast(fit(table, labels, **options))
    drop(table)

    @F.pandas_udf("boolean")
    def good(text: pd.Series, cell: pd.Series) -> pd.Series:
        out = [np.zeros(0, dtype=bool)]
        for x in text_slices(pa.RecordBatch.from_arrays([pa.array(text, pa.string(), from_pandas=True), pa.array(cell, pa.int64())], names=["text", "cell"]), 0):
            out.append(shared.value.scores(content_features(x.column(0).to_pylist()), x.column(1).to_numpy())[0] >= threshold)
        return pd.Series(np.concatenate(out))

    return docs.where(good(F.col("text"), metadata_cell(F.col("source"), F.col("lang"), F.col("n_chars"))))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
