"""N-gram Jaccard join by vertical partitioning.

The global n-gram order is cut into fragments. Each fragment meets on its own: it finds which of its n-grams occur in
two sets or more, and how often. A set keeps only those, rarest first, and goes on only if they can reach the overlap
that a link needs. Candidate pairs share an n-gram of both prefixes. Their overlaps are counted fragment by fragment and
summed per pair.

Sets are compared as classes of equal sets, so copies never meet as pairs. Within a near-duplicate group, sets first
link to one representative each, round by round; only pairs whose two sets are still in different components are then
compared. No link between different components is left out, and no quadratic list of pairs within a group arises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, drop, partitions, read_table, release, save
from .shingles import class_key, shingle_sets, text_slices

#: Percent of the union that two sets must share.
THRESHOLD = 75
#: Vertical fragments of the overlap count.
FRAGMENTS = 4
#: Fragments of the n-gram order for each shuffle partition; a task holds one at a time, and several even out. A class's
#: key is written once for each fragment that has n-grams of it, so many fragments make much to shuffle.
PIECES = 2
#: Smallest hashes by which sets first find one to link to.
SIGNATURES = 3
#: Comparisons of sketches for each entry of the index up to which all that is left is compared at once.
COMPARED = 64
#: Sets of an n-gram's main component that the others there are held against in a round.
DRAWS = 8
#: 64-bit words of a set's parity sketch.
WORDS = 8
SKETCH = [f"k{i}" for i in range(WORDS)]
_SET = ["key", "n", "m", *SKETCH]
_H = np.uint64((1 << 40) - 1)


def _text_sets(batches: Iterator[pa.RecordBatch], column: int):
    for b in batches:
        for x in text_slices(b, column):
            yield x, shingle_sets(x.column(column).to_pylist())


def set_keys(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n): class key and size of each document's shingle set; key 0 and n 0 for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, sets in _text_sets(batches, 1):
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "key", "n"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, key long, n long")


_CELLS = pa.schema([("frag", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("low", pa.binary()), ("high", pa.binary())])


def _planes(a: np.ndarray) -> bytes:
    """An array's lowest bytes, then the next ones, and so on: bytes that are mostly equal lie together, for compression."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def _unplaned(column, kind: str) -> np.ndarray:
    """The arrays of a column of _planes(), one after the other."""
    parts = [np.frombuffer(x, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.reshape(-1) for x in column.to_pylist()]
    return np.concatenate(parts).view(kind) if parts else np.zeros(0, dtype=kind)


def _fragments(docs: DataFrame, fragments: int, flush: int = 1 << 19) -> DataFrame:
    """Rows (frag, keys, counts, low, high): for a run of documents, the part of their sets in a fragment.

    40 bits of a hash are kept besides its fragment. A task sends a class once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, sets, size = [], [], 0

        def out() -> pa.RecordBatch:
            by = np.argsort(np.array(keys, dtype=np.int64)).tolist()
            keys[:], sets[:] = [keys[i] for i in by], [sets[i] for i in by]
            h = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            frag = ((h >> np.uint64(40)) * np.uint64(fragments) >> np.uint64(24)).astype(np.uint16)
            order = np.argsort(frag, kind="stable")  # by fragment, document and hash
            frag, doc, h = frag[order], doc[order], h[order] & _H
            cell = np.flatnonzero(np.diff(frag.astype(np.int64) * len(sets) + doc, prepend=-1))
            count = np.diff(cell, append=len(doc)).astype("<u4")
            k = np.array(keys, dtype="<i8")[doc[cell]]
            steps = np.diff(k, prepend=0)  # of ascending keys, which wrap around
            low, high = (h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype(np.uint8)
            used, first = np.unique(frag, return_index=True)
            ends = np.append(first[1:], len(frag))
            c0, c1 = np.searchsorted(cell, first), np.searchsorted(cell, ends)
            rows = [pa.array(used.astype(np.int32))]
            steps[c0] = k[c0]
            rows += [pa.array([_planes(a[s:e]) for s, e in zip(c0, c1, strict=True)], pa.binary()) for a in (steps, count)]
            rows += [pa.array([a[s:e].tobytes() for s, e in zip(first, ends, strict=True)], pa.binary()) for a in (low, high)]
            return pa.RecordBatch.from_arrays(rows, schema=_CELLS)

        for _, got in _text_sets(batches, 0):
            for s in got:
                if len(s) and (key := class_key(s)) not in seen:
                    seen.add(key)
                    keys.append(key)
                    sets.append(s)
                    size += len(s)
            if size > flush:
                yield out()
                keys, sets, size = [], [], 0
        if sets:
            yield out()

    return docs.select("text").mapInArrow(run, "frag int, keys binary, counts binary, low binary, high binary")


def _joined(column, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


_SHARED = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary())])


def _shared(cells: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, keys, ids): the n-grams of a fragment that two classes or more have, dealt by class.

    An id orders n-grams by how many classes have them, roughly, then by fragment and hash.
    """

    def run(t: pa.Table) -> pa.Table:
        frag = t["frag"][0].as_py()
        keys = [np.cumsum(_unplaned(pa.array([x]), "<i8")) for x in t["keys"].to_pylist()]
        key = np.repeat(np.concatenate(keys), _unplaned(t["counts"], "<u4"))
        h = _joined(t["low"], "<u4").astype(np.int64) | (_joined(t["high"], np.uint8).astype(np.int64) << 32)
        order = np.argsort(h)
        h, key = h[order], key[order]
        same = h[1:] == h[:-1]
        keep = np.flatnonzero(np.append(same, False) | np.append(False, same))
        h, key = h[keep], key[keep]
        order = np.lexsort((key, h))
        h, key = h[order], key[order]
        once = np.append(True, (h[1:] != h[:-1]) | (key[1:] != key[:-1]))[: len(h)]  # a class may come from several tasks
        h, key = h[once], key[once]
        first = np.flatnonzero(np.diff(h, prepend=-1))
        df = np.diff(first, append=len(h))
        often = np.minimum(127, (6 * np.log2(df)).astype(np.int64)) if len(df) else df
        df, often = np.repeat(df, df), np.repeat(often, df)
        h, key, often = h[df > 1], key[df > 1], often[df > 1]
        ids = (often << 56) | (frag << 40) | h
        bucket = key % buckets
        order = np.lexsort((key, bucket))
        used, at = np.unique(bucket[order], return_index=True)
        ends = np.append(at, len(order))[1:]
        return pa.table([pa.array(used.astype(np.int64))] + [pa.array([_planes(a[order[s:e]]) for s, e in zip(at, ends, strict=True)], pa.binary()) for a in (key, ids)], schema=_SHARED)

    return cells.groupBy("frag").applyInArrow(run, "bucket long, keys binary, ids binary")


def shared_sets(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, n, m, ids): each class that may have a link, with its m shared n-grams in global order."""
    n = partitions(docs.sparkSession)
    found = _shared(_fragments(docs, min(PIECES * n, 1 << 16)), n)
    classes = keys.where("n > 0").groupBy("key").agg(F.first("n").alias("n")).withColumn("bucket", F.pmod("key", F.lit(n)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, ids = _unplaned(left["keys"], "<i8"), _unplaned(left["ids"], "<i8")
        order = np.lexsort((ids, key))
        key, ids = key[order], ids[order]
        used, at = np.unique(key, return_index=True)
        m = np.diff(at, append=len(key))
        rk, rn = right["key"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(rk)
        size = rn[order][np.searchsorted(rk[order], used)] if len(used) else np.zeros(0, np.int64)
        good = np.flatnonzero(100 * m >= THRESHOLD * size)
        own = [ids[at[i] : at[i] + m[i]] for i in good]
        bits = np.array([np.packbits(np.bincount(x & (64 * WORDS - 1), minlength=64 * WORDS).astype(np.uint8) & 1) for x in own]).reshape(-1, 8 * WORDS)
        words = np.ascontiguousarray(bits).view("<i8")
        columns = [pa.array(used[good], pa.int64()), pa.array(size[good], pa.int64()), pa.array(m[good], pa.int64()), pa.array(own, pa.list_(pa.int64()))]
        return pa.table(columns + [pa.array(words[:, i], pa.int64()) for i in range(WORDS)], names=["key", "n", "m", "ids", *SKETCH])

    return found.groupBy("bucket").cogroup(classes.groupBy("bucket")).applyInArrow(run, "key long, n long, m long, ids array<long>" + "".join(f", {w} long" for w in SKETCH))


def _may_link(x: str, y: str):
    """Whether two sets, whose columns have these suffixes, may link: by size, and by a bound on what only one has.

    Each n-gram that only one of them has turns one bit of the sketches' difference, and none has partners outside the
    shared ones; so no pair that links fails.
    """
    n1, n2, m1, m2 = (F.col(c + s) for c in "nm" for s in (x, y))
    apart = n1 - m1 + n2 - m2
    for w in SKETCH:
        apart = apart + F.bit_count(F.col(w + x).bitwiseXOR(F.col(w + y)))
    return (F.least(n1, n2) * 100 >= F.greatest(n1, n2) * THRESHOLD) & (apart * (100 + THRESHOLD) <= (n1 + n2) * (100 - THRESHOLD))


def _renamed(columns: list[str], suffix: str, source: str = ""):
    return [F.col(source + c).alias(c + suffix) for c in columns]


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of class keys that link: overlaps counted per vertical fragment, then summed per pair."""

    def segment(f):
        def inside(x):
            return F.shiftrightunsigned(x, 40).bitwiseAND(F.lit(0xFFFF)) % FRAGMENTS == f

        return F.filter("ids", inside)

    parts = F.array(*(F.struct(F.lit(f).alias("f"), segment(f).alias("ids")) for f in range(FRAGMENTS)))
    segments = sets.select("key", "n", F.explode(parts).alias("s")).select("key", "n", "s.f", "s.ids").where(F.size("ids") > 0)
    left = pairs.join(segments.select(F.col("key").alias("a"), F.col("n").alias("na"), "f", F.col("ids").alias("ia")), "a")
    both = left.join(segments.select(F.col("key").alias("b"), F.col("n").alias("nb"), "f", F.col("ids").alias("ib")), ["b", "f"])
    partial = both.select("a", "b", "na", "nb", F.size(F.array_intersect("ia", "ib")).cast("long").alias("o"))
    total = partial.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("o").alias("o"))
    return total.where(F.col("o") * 100 >= THRESHOLD * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def _signatures(sets: DataFrame) -> DataFrame:
    """Each set without its n-grams, once for each of its smallest hashes (sig) of shared n-grams."""
    low = F.transform("ids", lambda x: x.bitwiseAND(F.lit((1 << 40) - 1)))
    return sets.select(*_SET, F.explode(F.slice(F.array_sort(low), 1, SIGNATURES)).alias("sig"))


def _entries(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, key, at, component): the n-grams of which a linked set must share one, and their places."""
    prefix = F.slice("ids", 1, (F.col("m") - F.ceil(F.col("n") * THRESHOLD / 100) + 1).cast("int"))
    named = sets.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    return named.select("key", "component", F.posexplode(prefix).alias("at", "id"))


def _pair(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def link_classes(sets: DataFrame, max_rounds: int = 2) -> DataFrame:
    """(node, component) over the class keys of ``sets`` that have a link."""
    spark = sets.sparkSession
    # each set to the first of those that have one of its smallest hashes too
    signed = _signatures(sets)
    # tables of their own, so that Spark can split what many sets share when these meet them again
    first = save(signed.groupBy("sig").agg(F.min(F.struct(*_SET)).alias("r"), F.count("*").alias("c")).where("c > 1").select("sig", *_renamed(_SET, "1", "r.")), "first")
    meets = signed.join(first, "sig").where((F.col("key") != F.col("key1")) & _may_link("", "1"))
    labels = save(components(verify(meets.select(*_pair("key", "key1")).distinct(), sets)), "labels")
    drop(first)
    for turn in range(max_rounds):
        entries = _entries(sets, labels)
        mixed = save(entries.groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("id"), "mixed")
        named = save(entries.join(mixed, "id").join(sets.select(*_SET), "key"), "open")
        drop(mixed)
        per = named.groupBy("id", "component").agg(F.count("*").alias("c"))
        main = save(per.groupBy("id").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"), F.max(F.struct("c", "component")).alias("most")).select("id", "s", "q", F.col("most.component").alias("main")), "main")
        rows, todo = main.agg(F.sum("s"), F.sum(F.col("s") * F.col("s") - F.col("q"))).first()
        if not rows:
            drop(named, main)
            return labels
        if todo <= COMPARED * rows or turn == max_rounds - 1:
            break
        # at each n-gram, the sets outside its main component against a few sets of that
        placed = named.join(main.select("id", "main"), "id")
        drawn = [F.min(F.struct(F.xxhash64("key", "id", F.lit(turn * DRAWS + i)).alias("o"), *_SET)) for i in range(DRAWS)]
        few = save(placed.where("component = main").groupBy("id").agg(F.array(*drawn).alias("r")).select("id", F.explode("r").alias("r")).select("id", *_renamed(_SET, "1", "r.")), "few")
        found = placed.where("component <> main").join(few, "id").where(_may_link("", "1")).groupBy("key").agg(F.min("key1").alias("lo"), F.max("key1").alias("hi"))
        pairs = found.select("key", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("key1")).select(*_pair("key", "key1")).distinct()
        labels = _merged(labels, verify(pairs, sets))
        drop(named, main, few)
        release(spark)
    # all other pairs of different components that share a prefix n-gram and can still reach the overlap
    side = [*_SET, "at", "component"]
    left, right = named.select("id", *_renamed(side, "1")), named.select("id", *_renamed(side, "2"))
    most = F.least(F.col("m1") - F.col("at1"), F.col("m2") - F.col("at2"))
    reach = most * (100 + THRESHOLD) >= THRESHOLD * (F.col("n1") + F.col("n2"))
    unlike = (F.col("key1") < F.col("key2")) & (F.col("component1") != F.col("component2"))
    pairs = left.join(right, "id").where(unlike & reach & _may_link("1", "2")).select(*_pair("key1", "key2")).distinct()
    out = _merged(labels, verify(pairs, sets))
    drop(named, main)
    return out


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of the components that these connect."""
    own = [labels.select(F.col("node").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    named = links.join(own[0], "a", "left").join(own[1], "b", "left")
    top = save(components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))), "labels")
    above = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    old = labels.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = top.join(labels.select("node"), "node", "left_anti")
    return save(old.unionByName(new.select("node", "component")), "labels")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text): groups of texts that links connect.

    A set is the distinct five-word shingles of a whole text; two link where they share at least 75 percent of their
    union. component_id is the smallest doc_id reachable. An empty or null text has n_shingles 0 and is linked with
    nothing. Repeated rows are in one group; a null doc_id is a row like others but never names a group that has
    another id. An empty table gives no rows. Sets are told apart by 64-bit keys, n-grams by at least 40 bits and their
    fragment.
    """
    keys = save(set_keys(docs), "keys")
    sets = save(shared_sets(docs, keys), "sets")
    release(docs.sparkSession)
    labels = link_classes(sets)
    release(docs.sparkSession)
    classes = keys.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = classes.join(labels.withColumnRenamed("node", "key"), "key", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    groups = save(named.join(least, "component", "left").select("key", F.coalesce("smallest", "least").alias("component_id")), "groups")
    drop(sets)
    release(docs.sparkSession)
    full = keys.where("n > 0").join(groups, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = keys.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for; rows of one id stay or go together."""
    found = near_duplicates(docs)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by five-word shingles and a similarity of 0.75 or more."""
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
