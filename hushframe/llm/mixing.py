"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the budget over its size. Each document draws how often it
appears by inverting the Poisson distribution of that mean at a uniform number hashed from seed and document, so the
draw needs no shuffle, no state and comes out alike on every attempt. Copies are exploded and globally shuffled by a
second hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, read_table

#: Shares are broadcast while there are at most so many sources; beyond, they are joined.
BROADCAST_SOURCES = 50_000
_HEX = 13  # hex digits, 52 bits, of a uniform number


def _uniform(seed: int, key):
    text = F.concat(F.lit(f"{seed}|"), key)
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("double") / float(16**_HEX)


def mix(docs: DataFrame, power: float = 0.5, weights: dict[str, float] | None = None, budget: float = 1.0, seed: int = 7, source_column: str = "source", id_column: str = "doc_id", size_column: str | None = None) -> DataFrame:
    """Documents repeated to the target weights: the input's columns and ``copy`` (from 1), globally shuffled.

    Target share of a source: its weight in ``weights``, or its size to the power ``power``, over the sum of all. Size is
    the number of documents, or the sum of ``size_column``. A source's mean rate is share * budget * total size / its
    own size. Documents that draw 0 don't appear. A null source is a source of its own; one without weight, or of size 0,
    gives none. Equal ids draw alike; each row without id draws on its own, by its place in the input. An empty table gives
    no rows; an input column ``copy`` is replaced, all others kept under any name.
    """
    spark, cols = docs.sparkSession, [c for c in docs.columns if c != "copy"]
    amount = F.count("*").cast("double") if size_column is None else F.sum(F.coalesce(F.col(size_column), F.lit(0))).cast("double")
    sizes = docs.groupBy(F.col(source_column).alias("_s")).agg(amount.alias("_n")).where("_n > 0")
    everything = F.lit(None)
    if weights is not None:
        everything = F.lit(sizes.agg(F.sum("_n")).first()[0])
    if weights is None:
        sizes = sizes.withColumn("_w", F.pow("_n", F.lit(power)))
    else:
        table = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "_k string, _w double")
        sizes = sizes.join(table, F.col("_s").eqNullSafe(F.col("_k"))).drop("_k").where("_w > 0")
    total = sizes.agg(F.sum("_w").alias("w"), F.coalesce(everything, F.sum("_n")).alias("n"), F.count("*").alias("c")).first()
    if not total["c"]:
        return docs.select(*cols).withColumn("copy", F.lit(1)).limit(0)
    rate = F.col("_w") / F.lit(total["w"]) * F.lit(budget * total["n"]) / F.col("_n")
    rates = sizes.select("_s", rate.alias("_rate")).withColumn("_cdf", poisson_cdf(F.col("_rate"))).withColumn("_first", _first(F.col("_rate"))).drop("_rate")
    if total["c"] <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # rows of one id may be many: their places in the input spread them over the shuffle
    named = docs.select(F.struct(*cols).alias("_row"), F.col(source_column).alias("_source"), F.col(id_column).cast("string").alias("_id"), F.monotonically_increasing_id().alias("_at"))
    joined = named.join(rates, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_source")
    u = _uniform(seed, F.coalesce("_id", F.concat(F.lit("null|"), F.col("_at").cast("string"))))
    n = F.when(u > 0, F.col("_first") + F.size(F.filter("_cdf", lambda p: p < u))).otherwise(F.lit(0))
    drawn = joined.select("_row", "_id", "_at", n.alias("_n")).where("_n > 0")
    copies = drawn.select("_row", F.xxhash64(F.lit(seed), "_id", "_at").alias("_key"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("copy"))
    place = F.xxhash64(F.lit(seed), "_key", "copy")
    shuffled = copies.repartition(partitions(spark), place).sortWithinPartitions(place)
    return shuffled.select(*(F.col("_row").getField(c).alias(c) for c in cols), "copy")


def _first(rate):
    """The number from which poisson_cdf() counts: lower ones have less mass than a 52-bit uniform number can tell from 0."""
    return F.greatest(F.floor(rate - 9 * F.sqrt(rate) - 25), F.lit(0)).cast("int")


def poisson_cdf(rate):
    """The distribution function at _first(rate) and on, up to where a 52-bit uniform number can no longer tell it from 1.

    Terms are built outward from the mode, relative to its own, and divided by their sum, so that none underflows.
    """
    first, mode, last = _first(rate), F.floor(rate).cast("int"), F.ceil(rate + 9 * F.sqrt(rate) + 25).cast("int")

    def terms(numbers, ratio):
        start = F.struct(F.lit(1.0).alias("p"), F.array().cast("array<double>").alias("a"))

        def step(s, k):
            p = s["p"] * ratio(k)
            return F.struct(p.alias("p"), F.concat(s["a"], F.array(p)).alias("a"))

        return F.aggregate(numbers, start, step)["a"]

    below = F.when(mode > first, F.sequence(mode, first + 1, F.lit(-1))).otherwise(F.array().cast("array<int>"))
    weights = F.concat(F.reverse(terms(below, lambda k: k / rate)), F.array(F.lit(1.0)), terms(F.sequence(mode + 1, last), lambda k: rate / k))
    zero = F.struct(F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("a"))

    def add(s, p):
        return F.struct((s["c"] + p).alias("c"), F.concat(s["a"], F.array(s["c"] + p)).alias("a"))

    return F.aggregate(weights, zero, add, lambda s: F.transform(s["a"], lambda c: c / s["c"]))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source to shares that follow the square root of the sources' sizes."""
    return mix(read_table(spark, sf_dir, "documents"))


ORACLE = """
WITH s AS (SELECT source, CAST(count(*) AS DOUBLE) AS n FROM documents GROUP BY source),
t AS (SELECT sum(sqrt(n)) AS w, sum(n) AS n FROM s),
r AS (SELECT source, sqrt(s.n) / t.w * t.n / s.n AS rate FROM s, t),
k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 9 * sqrt(rate) + 25) AS BIGINT) + 1)) AS k FROM r),
c AS (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents),
m AS (SELECT u.doc_id, count(*) AS n FROM u JOIN c ON c.source IS NOT DISTINCT FROM u.source AND c.cdf < u.u GROUP BY u.doc_id)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(unnest(range(1, m.n + 1)) AS INTEGER) AS copy
FROM documents d JOIN m ON d.doc_id = m.doc_id
"""
