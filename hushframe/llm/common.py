"""What the operators of this subpackage share: scratch tables, ranks and connected components.

Intermediate results are written as Parquet below ``spark.checkpoint.dir`` and read again. That cuts
lineage, survives lost executors and needs no folder that is local to one machine.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder that the session names; a temporary one only where it names none and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="hushframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the scratch folder and returns a DataFrame that reads it."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(*saved: DataFrame) -> None:
    """Deletes tables written by save() that no later step reads."""
    for df in saved:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of DataFrames that are out of use."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), a != b, of any comparable type.

    Returns (node, component): the smallest node reachable, for each node that has an edge. Alternates large-star and
    small-star steps (Kiveris et al., 2014), each a distributed aggregation, until every node has one edge, to a node
    that has none itself. A hub's edges are aggregated to their minimum before they meet, so no task gathers a component.
    """
    both = save(edges.select("a", "b").where("a <> b").distinct(), "edges")
    for _ in range(max_rounds):
        # every larger neighbour points to the smallest of a neighbourhood, then every smaller one
        now = save(_star(_star(both, large=True), large=False).distinct(), "edges")
        drop(both)
        both = now
        ends = both.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(both.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if per.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty():
            break
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return both.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step; result edges (a, b) with a > b, some of them repeated."""
    turned = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        turned = turned.unionByName(turned.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = turned.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = turned.join(least, "u")
    moved = joined.where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        moved = moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("a <> b")


def running_total(df: DataFrame, keys: list[str], count: str, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``count`` over all rows whose keys sort lower. Keys must be distinct. drop() takes the result.

    Rows are range-partitioned, each part sums on its own, and only one total per part meets in a single task.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    parted = save(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()), name)
    totals = parted.groupBy("_part").agg(F.sum(count).alias("_t"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_o"))  # a row per part
    inner = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    own = parted.withColumn("_b", F.coalesce(F.sum(count).over(inner), F.lit(0)))
    out = own.join(F.broadcast(offsets), "_part").withColumn("before", F.col("_b") + F.col("_o")).drop("_part", "_b", "_o")
    out._scratch_path = parted._scratch_path
    return out
