import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from hushframe.llm import ngram_join
from hushframe.llm.common import components
from hushframe.llm.shingles import shingle_sets

LOWER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows):
    out = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    return out


def brute(rows):
    s = sets_of(rows)
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            o = len(s[i][1] & s[j][1])
            if o and 100 * o >= 75 * len(s[i][1] | s[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(s):
        r = find(i)
        ids = [x for x in (least.get(r), d) if x is not None]
        least[r] = min(ids) if ids else None
    return sorted(((d is None, d, len(x), least[find(i)]) for i, (d, x) in enumerate(s)), key=str)


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("n", F.lit("x")).repartition(3)
    return sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows, n = [], 0
    passage = r.choices(vocab, k=30)
    for _ in range(25):
        base = r.choices(vocab, k=r.choice([4, 8, 40, 60, 90]))
        for _ in range(r.choice([1, 1, 2, 5, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.3:
                w = w + passage
            if r.random() < 0.2:
                w = [x.upper() for x in w]
            rows.append((n, r.choice([" ", "\n", "\t  "]).join(w)))
            n += 1
    r.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(spark, rows) == brute(rows)


def test_defined_cases(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    rows = [(1, ""), (2, None), (3, " \n\t "), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, long), (8, long + " end"), (9, long), (9, long), (None, long), (None, "alone é ß"), (10, "É x y z q"), (11, "é x y z q"), (12, "b a")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_group_of_near_copies_and_chain(spark):
    r = random.Random(9)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):  # one group whose members differ from each other more than from the base
        w = list(base)
        w[r.randrange(60)] = f"e{i}"
        rows.append((i, " ".join(w)))
    for i in range(30):  # a chain: only neighbours link
        rows.append((1000 + i, " ".join(f"c{j}" for j in range(i * 5, i * 5 + 60))))
    assert run(spark, rows) == brute(rows)


def test_shingle_hashes_follow_the_definition():
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "A B C D E", "a b c d e a b c d e a", "é\xa0x y z q w", "x" * 100 + " y z", "a\x0bb\x0cc d e"])]
    got, want = shingle_sets([t for _, t in rows]), sets_of(rows)
    assert [len(g) for g in got] == [len(w) for _, w in want]
    assert len({int(x) for g in got for x in g}) == len(set().union(*(w for _, w in want)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(80)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{200 + i: 100 for i in range(80)}, 100: 100, 299: 299, 300: 299}


def test_one_of_each_group_stays(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z"), (4, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in ngram_join.keep_representatives(docs).collect()) == [1, 3, 4]


def test_rows_of_fragments_are_small(spark):
    r = np.random.default_rng(5)
    texts = [(" ".join(f"w{x}" for x in r.integers(0, 5000, 300)),) for _ in range(200)]
    found = ngram_join._fragments(spark.createDataFrame(texts, "text string").coalesce(1), 8).toArrow()
    size = sum(len(pa.compress(x, codec="lz4_raw", asbytes=True)) for c in ("keys", "counts") for x in found[c].to_pylist())
    assert size < 9.5 * 8 * len(texts)  # a key and a count for each fragment and text
    key = [np.cumsum(ngram_join._unplaned(pa.array([x]), "<i8")) for x in found["keys"].to_pylist()]
    want = {ngram_join.class_key(s) for s in ngram_join.shingle_sets([t for t, in texts])}
    assert all(set(k.tolist()) == want for k in key)
    assert ngram_join._unplaned(found["counts"], "<u4").sum() == 200 * 296
