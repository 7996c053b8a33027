import math

import numpy as np
from pyspark.sql import functions as F

from hushframe.llm import mixing, topk


def brute(rows, k, queries):
    def vec(v):
        return [math.floor(1024 * x) for x in v]

    ok = [(i, vec(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q in queries:
            got = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(got)}
    return out


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).round(1).tolist()) for i in range(200)] + [(300 + i, [0.5] * 6) for i in range(60)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, [1.0, 2.0]), (None, [9.0] * 6), (405, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as seq", "2 as score").repartition(5)
    qs = {i for i, _ in rows if i is not None and i % 7 == 0}
    got = {tuple(x) for x in topk.top_k(df, F.col("vec_id") % 7 == 0, k=4, tile_rows=8, shard_rows=16).collect()}
    assert got == brute(rows, 4, qs)


def test_top_k_large_components_and_few_rows(spark):
    rows = [(0, [3e9, -2.0]), (1, [1e3, 5.0]), (2, [-1e3, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df, F.col("vec_id") == 0).collect()} == brute(rows, 10, {0})
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_mix_rates_and_cases(spark):
    rows = [(i, f"t{i}", "big" if i % 10 else "small") for i in range(20000)] + [(90000 + i, None, None) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("x"))
    out = mixing.mix(docs, power=0.0).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {None, "big", "small"} and all(abs(v - 22000 / 3) < 400 for v in n.values())
    assert out.columns == ["doc_id", "text", "source", "copy"]
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in mixing.mix(docs.repartition(7), power=0.0).collect()}
    only = mixing.mix(docs, weights={"small": 1.0}, budget=0.5)
    assert [r.source for r in only.select("source").distinct().collect()] == ["small"] and abs(only.count() - 11000) < 500
    assert mixing.mix(docs.limit(0)).count() == 0


def test_poisson_cdf(spark):
    a = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("a")).first().a
    want = np.cumsum([math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(len(a))])
    assert np.allclose(a, want) and a[-1] > 1 - 1e-15


def test_poisson_cdf_of_large_rates(spark):
    for rate in (740.5, 1000.0, 100000.0):
        first, a = spark.range(1).select(mixing._first(F.lit(rate)).alias("f"), mixing.poisson_cdf(F.lit(rate)).alias("a")).first()
        k = np.arange(first + len(a))
        want = np.cumsum([math.exp(-rate + i * math.log(rate) - math.lgamma(i + 1)) for i in k])
        assert np.allclose(a, want[first:], rtol=0, atol=1e-8) and a[-1] > 1 - 1e-12
        assert not first or want[first - 1] < 2**-52


def test_mix_to_large_rates(spark):
    rows = [(i, "a" if i < 20 else "b") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    for budget, rate in ((5.0, 1000), (50.0, 10000)):
        n = [r["count"] for r in mixing.mix(docs, weights={"a": 1.0}, budget=budget).groupBy("doc_id").count().collect()]
        assert len(n) == 20 and len(set(n)) > 10 and all(abs(x - rate) < 5 * rate**0.5 for x in n)


def test_mix_rows_without_id_and_clashing_names(spark):
    rows = [(None, "a", i) for i in range(3000)] + [(7, "a", 0)] * 500 + [(i, "b", i) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, _n long").selectExpr("*", "'s' as _s", "1 as _row", "2 as _cdf", "3 as _id", "4 as place")
    out = mixing.mix(docs, weights={"a": 1.0}, budget=1.0)
    assert out.columns == [*docs.columns, "copy"]
    got = out.cache()
    assert abs(got.where("doc_id is null").count() - 3000 * 3600 / 3500) < 250  # each draws on its own
    assert got.where("doc_id is null").select("_n").distinct().count() > 1500
    assert len({r["count"] for r in got.where("doc_id = 7").groupBy("_row").count().collect()}) <= 1
    assert got.where("_s <> 's' or _row <> 1 or _cdf <> 2 or _id <> 3 or place <> 4").count() == 0
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * sum(sizes)
