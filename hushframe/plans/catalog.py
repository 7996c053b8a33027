"""Registry of the library's queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo, groups
from ..functions.generalizers import Aggregation, Categories, NoneGeneralizer, Reduction
from ..functions.hierarchy import Hierarchy
from ..operators.batch import anonymize, compare_baseline, shard_metrics
from ..operators.kernel import COUNTERS
from ..rules import SUPPRESS_MAX, AnonymizerConfig, Rule, RuleSet
from ..sources import taxi
from ..sources.text import format_delimited, parse_delimited
from ..streaming.operator import anonymize_stream, with_counters

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _flat(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns({f"{column}_lo": F.col(column)["lo"], f"{column}_hi": F.col(column)["hi"]}).drop(column)


# generalizers over known groups


def _range(kind: str):
    rules = RuleSet.of(("c_mktsegment", "c_acctbal"), Rule("c_mktsegment", NoneGeneralizer()), Rule("c_acctbal", Aggregation(-1000, 10000, kind)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = groups.generalize_groups(_table(spark, sf_dir, "customer"), ["c_mktsegment"], rules)
        return _rounded(_flat(found, "c_acctbal"), "info_loss", "c_acctbal_lo", "c_acctbal_hi")

    return run


def _range_sql(kind: str) -> str:
    return f"""
SELECT c_mktsegment, round(CAST(min(CAST(c_acctbal AS {kind})) AS DOUBLE), 6) AS c_acctbal_lo, round(CAST(max(CAST(c_acctbal AS {kind})) AS DOUBLE), 6) AS c_acctbal_hi,
  round(least(CAST(max(CAST(c_acctbal AS {kind})) - min(CAST(c_acctbal AS {kind})) AS DOUBLE) / 11000.0, 1.0), 6) AS info_loss
FROM customer GROUP BY c_mktsegment"""


for _name, _kind, _sql in (("double", "double", "DOUBLE"), ("float", "float", "FLOAT")):
    _query(f"gen_range_{_name}", _range_sql(_sql))(_range(_kind))


@_query("gen_range_int", """
SELECT o_orderpriority, min(CAST(o_custkey AS BIGINT)) AS o_custkey_lo, max(CAST(o_custkey AS BIGINT)) AS o_custkey_hi,
  round(least((max(o_custkey) - min(o_custkey)) / 1000.0, 1.0), 6) AS info_loss FROM orders GROUP BY o_orderpriority""")
def gen_range_int(spark, sf_dir):
    rules = RuleSet.of(("o_orderpriority", "o_custkey"), Rule("o_orderpriority", NoneGeneralizer()), Rule("o_custkey", Aggregation(0, 1000, "int")))
    return _rounded(_flat(groups.generalize_groups(_table(spark, sf_dir, "orders"), ["o_orderpriority"], rules), "o_custkey"), "info_loss")


_PREFIX = "len(list_filter(range(1, length(lo) + 1), lambda i: substr(lo, 1, i) = substr(hi, 1, i)))"


@_query("gen_reduction_by_group", f"""
WITH g AS (SELECT c_nationkey, min(c_name) AS lo, max(c_name) AS hi, min(length(c_name)) AS a, max(length(c_name)) AS b FROM customer GROUP BY c_nationkey),
p AS (SELECT *, CASE WHEN a <> b THEN 0 ELSE {_PREFIX} END AS k FROM g)
SELECT c_nationkey, substr(lo, 1, k) || repeat('*', b - k) AS c_name, round((b - k) / CAST(b AS DOUBLE), 6) AS info_loss FROM p""")
def gen_reduction_by_group(spark, sf_dir):
    rules = RuleSet.of(("c_nationkey", "c_name"), Rule("c_nationkey", NoneGeneralizer()), Rule("c_name", Reduction()))
    return _rounded(groups.generalize_groups(_table(spark, sf_dir, "customer"), ["c_nationkey"], rules), "info_loss")


@_query("gen_reduction_mixed_length", f"""
WITH g AS (SELECT p_size, min(p_brand) AS lo, max(p_brand) AS hi, min(length(p_brand)) AS a, max(length(p_brand)) AS b FROM part GROUP BY p_size),
p AS (SELECT *, CASE WHEN a <> b THEN 0 ELSE {_PREFIX} END AS k FROM g)
SELECT p_size, substr(lo, 1, k) || repeat('*', b - k) AS p_brand, round((b - k) / CAST(b AS DOUBLE), 6) AS info_loss FROM p""")
def gen_reduction_mixed_length(spark, sf_dir):
    rules = RuleSet.of(("p_size", "p_brand"), Rule("p_size", NoneGeneralizer()), Rule("p_brand", Reduction()))
    return _rounded(groups.generalize_groups(_table(spark, sf_dir, "part"), ["p_size"], rules), "info_loss")


def _nations(spark, sf_dir) -> Hierarchy:
    """Regions over nations: as many rows as there are nations."""
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name").orderBy("r_name", "n_name").collect()
    return Hierarchy([r.r_name, r.n_name] for r in rows)


_LCA = """
SELECT {key}, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) WHEN count(DISTINCT r_name) = 1 THEN min(r_name) ELSE '<ROOT>' END AS n_name,
  round(CASE WHEN count(DISTINCT n_name) = 1 THEN 0.0 WHEN count(DISTINCT r_name) = 1 THEN (min(leaves) - 1) / (min(total) - 1.0) ELSE 1.0 END, 6) AS info_loss
FROM ({rows}) x JOIN (SELECT n_nationkey, n_name, r_name, count(*) OVER (PARTITION BY r_name) AS leaves, count(*) OVER () AS total FROM nation JOIN region ON n_regionkey = r_regionkey) n ON x.nk = n.n_nationkey
GROUP BY {key}"""


def _with_nation(spark, sf_dir, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(F.broadcast(_table(spark, sf_dir, "nation")), F.col(key) == F.col("n_nationkey"))


@_query("gen_category_ancestor", _LCA.format(key="bucket", rows="SELECT c_nationkey AS nk, c_custkey // 5 AS bucket FROM customer"))
def gen_category_ancestor(spark, sf_dir):
    rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "customer"), "c_nationkey").withColumn("bucket", F.floor(F.col("c_custkey") / 5))
    rules = RuleSet.of(("bucket", "n_name"), Rule("bucket", NoneGeneralizer()), Rule("n_name", Categories(_nations(spark, sf_dir))))
    return _rounded(groups.generalize_groups(rows, ["bucket"], rules), "info_loss")


@_query("gen_category_array", _LCA.format(key="s_bucket", rows="SELECT s_nationkey AS nk, s_suppkey // 3 AS s_bucket FROM supplier"))
def gen_category_array(spark, sf_dir):
    rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "supplier"), "s_nationkey").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.floor(F.col("s_suppkey") / 3).alias("s_bucket"), F.array("r_name", "n_name").alias("n_name"))
    rules = RuleSet.of(("s_bucket", "n_name"), Rule("s_bucket", NoneGeneralizer()), Rule("n_name", Categories(_nations(spark, sf_dir))))
    return _rounded(groups.generalize_groups(rows, ["s_bucket"], rules), "info_loss")


@_query("gen_category_unknown", """
SELECT c_mktsegment, CASE WHEN count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'other' END) = 1 THEN min(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'other' END) ELSE '<ROOT>' END AS label
FROM customer GROUP BY c_mktsegment""")
def gen_category_unknown(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").withColumn("label", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("other"))
    tree = Hierarchy([["known", "AUTOMOBILE"], ["known", "BUILDING"]])
    rules = RuleSet.of(("c_mktsegment", "label"), Rule("c_mktsegment", NoneGeneralizer()), Rule("label", Categories(tree)))
    return groups.generalize_groups(rows, ["c_mktsegment"], rules).drop("info_loss")


def _customer_rules(spark, sf_dir, weights=(0.0, 0.0, 0.0)) -> RuleSet:
    return RuleSet.of(("c_mktsegment", "c_name", "c_acctbal", "n_name"), Rule("c_mktsegment", NoneGeneralizer()), Rule("c_name", Reduction(), weight=weights[0]), Rule("c_acctbal", Aggregation(-1000, 10000), weight=weights[1]), Rule("n_name", Categories(_nations(spark, sf_dir)), weight=weights[2]))


@_query("generalize_customers", """
WITH n AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT c_mktsegment, r_name, min(c_acctbal) AS c_acctbal_lo, max(c_acctbal) AS c_acctbal_hi,
  CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) ELSE r_name END AS n_name, count(DISTINCT c_custkey) AS n_subjects
FROM customer JOIN n ON c_nationkey = n_nationkey GROUP BY c_mktsegment, r_name""")
def generalize_customers(spark, sf_dir):
    rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "customer"), "c_nationkey").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rules = RuleSet.of(("c_acctbal", "n_name"), Rule("c_acctbal", Aggregation(-1000, 10000)), Rule("n_name", Categories(_nations(spark, sf_dir))))
    return _flat(groups.generalize_groups(rows, ["c_mktsegment", "r_name"], rules, "c_custkey").drop("info_loss"), "c_acctbal")


# rendering of suppressed rows, and rows that pass


def _suppress(strategy: int):
    def run(spark, sf_dir):
        rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "customer"), "c_nationkey").select("c_custkey", "c_name", "c_acctbal", "n_name")
        rules = RuleSet.of(rows.columns, Rule("c_custkey", NoneGeneralizer()), Rule("c_name", Reduction()), Rule("c_acctbal", Aggregation(-1000, 10000)), Rule("n_name", Categories(_nations(spark, sf_dir))))
        out = _flat(groups.suppress(rows, rules, strategy), "c_acctbal")
        return out if strategy in (0, 1, 2) else out.select("info_loss", F.col("c_custkey").isNull().alias("no_key"), F.col("c_name").isNull().alias("no_name"), F.col("c_acctbal_lo").isNull().alias("no_range"))

    return run


_query("suppress_drop", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS n_name, CAST(1 AS FLOAT) AS info_loss, c_acctbal AS c_acctbal_lo, c_acctbal AS c_acctbal_hi FROM customer WHERE false")(_suppress(0))
_query("suppress_null", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(NULL AS VARCHAR) AS n_name, CAST(1 AS FLOAT) AS info_loss, CAST(NULL AS DOUBLE) AS c_acctbal_lo, CAST(NULL AS DOUBLE) AS c_acctbal_hi FROM customer")(_suppress(1))
_query("suppress_max", "SELECT c_custkey, '*' AS c_name, '<ROOT>' AS n_name, CAST(1 AS FLOAT) AS info_loss, CAST(-1000 AS DOUBLE) AS c_acctbal_lo, CAST(10000 AS DOUBLE) AS c_acctbal_hi FROM customer")(_suppress(2))
_query("suppress_blank", "SELECT CAST(1 AS FLOAT) AS info_loss, true AS no_key, true AS no_name, true AS no_range FROM customer")(_suppress(-1))


@_query("pass_through", "SELECT event_id, user_id, event_type, value FROM events")
def pass_through(spark, sf_dir):
    return compare_baseline(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "stamp").drop("stamp")


# losses


_GROUP_LOSS = f"""
WITH n AS (SELECT n_nationkey, n_name, r_name, count(*) OVER (PARTITION BY r_name) AS leaves, count(*) OVER () AS total FROM nation JOIN region ON n_regionkey = r_regionkey),
g AS (SELECT bucket, min(c_name) AS lo, max(c_name) AS hi, min(length(c_name)) AS a, max(length(c_name)) AS b, min(c_acctbal) AS x, max(c_acctbal) AS y, count(DISTINCT n_name) AS names, count(DISTINCT r_name) AS regions, min(leaves) AS leaves, min(total) AS total
  FROM (SELECT *, c_custkey // 7 AS bucket FROM customer) c JOIN n ON c_nationkey = n_nationkey GROUP BY bucket),
l AS (SELECT bucket, CASE WHEN a <> b THEN 1.0 ELSE (b - {_PREFIX}) / CAST(b AS DOUBLE) END AS l1, least((y - x) / 11000.0, 1.0) AS l2,
  CASE WHEN names = 1 THEN 0.0 WHEN regions = 1 THEN (leaves - 1) / (total - 1.0) ELSE 1.0 END AS l3 FROM g)"""


def _loss(weights):
    def run(spark, sf_dir):
        rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "customer"), "c_nationkey").withColumn("bucket", F.floor(F.col("c_custkey") / 7))
        rules = _customer_rules(spark, sf_dir, weights)
        return _rounded(groups.generalize_groups(rows, ["bucket"], rules).select("bucket", "info_loss"), "info_loss")

    return run


_query("infoloss_mean", _GROUP_LOSS + " SELECT bucket, round((l1 + l2 + l3) / 3, 6) AS info_loss FROM l")(_loss((0.0, 0.0, 0.0)))
_query("infoloss_weighted", _GROUP_LOSS + " SELECT bucket, round(0.5 * l1 + 0.3 * l2 + 0.2 * l3, 6) AS info_loss FROM l")(_loss((0.5, 0.3, 0.2)))
_query("infoloss_weights_round_to_one", _GROUP_LOSS + " SELECT bucket, round(0.6 * l1 + 0.4 * l2 + 0.4 * l3, 6) AS info_loss FROM l")(_loss((0.6, 0.4, 0.4)))


_VALUE = RuleSet.of(("event_type", "value"), Rule("event_type", NoneGeneralizer()), Rule("value", Aggregation(0, 600)))


@_query("enlargement_tuple", """
WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events WHERE value BETWEEN 50 AND 200 GROUP BY event_type),
p AS (SELECT c_nationkey AS probe, CAST(c_nationkey * 20 AS DOUBLE) AS v FROM customer GROUP BY c_nationkey)
SELECT event_type, probe, round(least((greatest(hi, v) - least(lo, v)) / 600, 1) - least((hi - lo) / 600, 1), 6) AS enlargement FROM g, p""")
def enlargement_tuple(spark, sf_dir):
    probes = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("probe")).distinct().withColumn("value", (F.col("probe") * 20).cast("double"))
    rows = _table(spark, sf_dir, "events").where("value BETWEEN 50 AND 200")
    return _rounded(groups.enlargement(rows, ["event_type"], _VALUE, probes, "probe"), "enlargement")


@_query("generalize_writeback", """
SELECT e.event_type, e.event_id, g.lo AS value_lo, g.hi AS value_hi FROM events e JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type) g ON e.event_type = g.event_type""")
def generalize_writeback(spark, sf_dir):
    rules = RuleSet.of(("event_type", "event_id", "value"), Rule("event_type", NoneGeneralizer()), Rule("event_id", NoneGeneralizer()), Rule("value", Aggregation(0, 600)))
    return _flat(groups.generalize_rows(_table(spark, sf_dir, "events").select("event_type", "event_id", "value"), ["event_type"], rules).drop("info_loss"), "value")


# audits


def _binned(spark, sf_dir):
    return _table(spark, sf_dir, "events").withColumn("bin", F.floor(F.col("value") / 20))


@_query("k_size", "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(DISTINCT user_id) AS k_size FROM events GROUP BY 1")
def k_size(spark, sf_dir):
    return groups.k_sizes(_binned(spark, sf_dir), ["bin"], "user_id")


@_query("k_violations", "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(DISTINCT user_id) AS k_size FROM events GROUP BY 1 HAVING count(DISTINCT user_id) < 10")
def k_violations(spark, sf_dir):
    return groups.k_violations(_binned(spark, sf_dir), ["bin"], "user_id", 10)


@_query("l_diversity", "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(DISTINCT event_type) AS l_size FROM events GROUP BY 1")
def l_diversity(spark, sf_dir):
    return groups.l_diversity(_binned(spark, sf_dir), ["bin"], "event_type")


@_query("l_violations", "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, count(DISTINCT event_type) AS l_size FROM events GROUP BY 1 HAVING count(DISTINCT event_type) < 4")
def l_violations(spark, sf_dir):
    return groups.l_violations(_binned(spark, sf_dir), ["bin"], "event_type", 4)


@_query("l_diversity_array", "SELECT c_mktsegment, count(DISTINCT n_name) AS l_size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def l_diversity_array(spark, sf_dir):
    rows = _with_nation(spark, sf_dir, _table(spark, sf_dir, "customer"), "c_nationkey").withColumn("path", F.array(F.col("n_regionkey").cast("string"), "n_name"))
    return groups.l_diversity(rows, ["c_mktsegment"], "path")


@_query("l_diversity_greedy")
def l_diversity_greedy(spark, sf_dir):
    rows = _binned(spark, sf_dir).withColumn("level", F.floor(F.col("value") / 5) % 4)
    return groups.greedy_diversity(rows, ["bin"], ["event_type", "level"])


@_query("group_counts", "SELECT CAST(floor(value / 20) AS BIGINT) AS bin, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) < 50")
def group_counts(spark, sf_dir):
    return groups.group_counts(_binned(spark, sf_dir), ["bin", "event_type"], 50)


@_query("value_mode", """
SELECT user_id, event_type, n FROM (SELECT user_id, event_type, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) x) y WHERE r = 1""")
def value_mode(spark, sf_dir):
    return groups.value_mode(_table(spark, sf_dir, "events"), ["user_id"], "event_type")


@_query("tau_moving_average", """
SELECT event_id, user_id, round(avg(value / 600) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS tau FROM events""")
def tau_moving_average(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("loss", F.col("value") / 600)
    return _rounded(groups.moving_loss(rows, ["ts", "event_id"], "loss", 10, ["user_id"]).select("event_id", "user_id", "tau"), "tau")


@_query("nearest_topk", """
SELECT event_type, event_id, r AS rank FROM (SELECT event_type, event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 100), event_id) AS INTEGER) AS r FROM events) x WHERE r <= 4""")
def nearest_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").withColumn("distance", F.abs(F.col("value") - 100))
    return groups.nearest(rows, ["event_type"], "distance", "event_id", 5).select("event_type", "event_id", "rank")


@_query("evaluation_averages", """
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type""")
def evaluation_averages(spark, sf_dir):
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


# text in and out


@_query("parse_delimited", "SELECT event_id, user_id, event_type, value FROM events")
def parse(spark, sf_dir):
    lines = format_delimited(_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    return parse_delimited(lines, schema)


@_query("format_delimited", "SELECT CAST(n_nationkey AS VARCHAR) || ';[' || r_name || ', ' || n_name || '];' || r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def format_(spark, sf_dir):
    rows = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return format_delimited(rows.select("n_nationkey", F.array("r_name", "n_name").alias("path"), "r_name"))


# positions


def _positions(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", (-74.05 + (F.col("event_id") % 350) / 1000.0).alias("lon"), (40.5 + (F.col("event_id") % 499) / 1000.0).alias("lat"), (-74.05 + (F.col("user_id") % 331) / 1000.0).alias("lon2"), (40.5 + (F.col("user_id") % 457) / 1000.0).alias("lat2"))


_POS = "(SELECT event_id, -74.05 + (event_id % 350) / 1000.0::DOUBLE AS lon, 40.5 + (event_id % 499) / 1000.0::DOUBLE AS lat, -74.05 + (user_id % 331) / 1000.0::DOUBLE AS lon2, 40.5 + (user_id % 457) / 1000.0::DOUBLE AS lat2 FROM events)"


@_query("geo_in_box", f"SELECT event_id, lon2 BETWEEN -74.05 AND -73.7 AND lat2 + 0.2 BETWEEN 40.5 AND 41.0 AS inside FROM {_POS} p")
def geo_in_box(spark, sf_dir):
    return _positions(spark, sf_dir).select("event_id", geo.in_nyc(F.col("lon2"), F.col("lat2") + 0.2).alias("inside"))


@_query("geo_grid", f"SELECT event_id, CAST(floor((74.05::DOUBLE - abs(lon)) / 0.0014::DOUBLE) + floor((41.0::DOUBLE - lat) / 0.00125::DOUBLE) * 250 AS INTEGER) AS cell FROM {_POS} p")
def geo_grid(spark, sf_dir):
    return _positions(spark, sf_dir).select("event_id", geo.grid_cell(F.col("lon"), F.col("lat")).alias("cell"))


@_query("geo_cell_center", "SELECT event_id, CAST(-(74.05::DOUBLE - (event_id % 250) * 0.0014::DOUBLE - 0.0014::DOUBLE / 2) AS FLOAT) AS lon, CAST(41::DOUBLE - (event_id // 250) * 0.00125::DOUBLE - 0.00125::DOUBLE / 2 AS FLOAT) AS lat FROM events")
def geo_cell_center(spark, sf_dir):
    c = F.col("event_id")
    return _table(spark, sf_dir, "events").select("event_id", geo.cell_center_lon(c).alias("lon"), geo.cell_center_lat(c).alias("lat"))


@_query("geo_distance", f"SELECT event_id, round(110.25 * sqrt(pow(lat - lat2, 2) + pow((lon - lon2) * cos(lat2), 2)), 6) AS km FROM {_POS} p")
def geo_distance(spark, sf_dir):
    return _positions(spark, sf_dir).select("event_id", F.round(geo.distance(*map(F.col, ("lon", "lat", "lon2", "lat2"))), 6).alias("km"))


@_query("geo_direction", f"SELECT event_id, CAST(trunc(degrees(atan2(lat2 + 0.00037::DOUBLE - lat, (lon2 + 0.00071::DOUBLE - lon) * cos(lat)))) AS INTEGER) + 179 AS degrees FROM {_POS} p")
def geo_direction(spark, sf_dir):
    return _positions(spark, sf_dir).select("event_id", geo.direction(F.col("lon"), F.col("lat"), F.col("lon2") + 0.00071, F.col("lat2") + 0.00037).alias("degrees"))


#: The columns of cells that a line passes are numbered i, their rows r, both from the western end; all in whole numbers.
_WAYS = f"""
SELECT event_id, CASE WHEN x1 <= x2 THEN x1 ELSE x2 END AS x, CASE WHEN x1 <= x2 THEN y1 ELSE y2 END AS y, abs(x2 - x1) AS wide, abs(y2 - y1) AS high, CASE WHEN (x2 - x1 >= 0) = (y2 - y1 >= 0) THEN 1 ELSE -1 END AS up
FROM (SELECT event_id, CAST(floor((74.05::DOUBLE - abs(lon)) / 0.0014::DOUBLE) AS BIGINT) AS x1, CAST(floor((41.0::DOUBLE - lat) / 0.00125::DOUBLE) AS BIGINT) AS y1, CAST(floor((74.05::DOUBLE - abs(lon2)) / 0.0014::DOUBLE) AS BIGINT) AS x2, CAST(floor((41.0::DOUBLE - lat2) / 0.00125::DOUBLE) AS BIGINT) AS y2 FROM {_POS} p) q"""


@_query("geo_cells_on_way", f"""
WITH w AS ({_WAYS}), c AS (SELECT *, unnest(range(wide + 1)) AS i FROM w),
f AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE (20 * (2 * i - 1) * high + 22 * wide - 1) // (40 * wide) END AS first, CASE WHEN i = wide THEN high ELSE (20 * (2 * i + 1) * high + 18 * wide) // (40 * wide) END AS last FROM c)
SELECT event_id, string_agg(CAST(x + i + (y + up * r) * 250 AS VARCHAR), ',' ORDER BY i, r) AS cells FROM (SELECT *, unnest(range(first, greatest(first, last) + 1)) AS r FROM f) g GROUP BY event_id""")
def geo_cells_on_way(spark, sf_dir):
    p = _positions(spark, sf_dir).repartition(4 * spark.sparkContext.defaultParallelism)  # short rows make long ways
    cells = geo.cells_on_way(*map(F.col, ("lon", "lat", "lon2", "lat2")))
    return p.select("event_id", F.array_join(cells, ",").alias("cells"))


@_query("taxi_fares")
def taxi_fares(spark, sf_dir):
    return taxi.fares(spark, _table(spark, sf_dir, "events").count())


@_query("taxi_rides")
def taxi_rides(spark, sf_dir):
    return taxi.rides(spark, _table(spark, sf_dir, "events").count()).orderBy("seq")


# online clustering


def _events(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value", F.hour("ts").alias("hour"), "event_type")


def _event_rules(columns, second: bool = False) -> RuleSet:
    return RuleSet.of(columns, *(Rule(c, NoneGeneralizer(), sensitive=c == "event_type" or second and c == "hour") for c in columns if c != "value" and (second or c != "hour")), Rule("value", Aggregation(0, 600)), *([] if second else [Rule("hour", Aggregation(0, 23, "int"))]))


def _config(**options) -> AnonymizerConfig:
    return AnonymizerConfig(**({"subject": "user_id", "order": ("ts", "event_id"), "suppress": SUPPRESS_MAX, "show_info_loss": True, "flush": "release", "shards": 8} | options))


@_query("cluster_events")
def cluster_events(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(_flat(anonymize(rows, _event_rules(rows.columns), _config()), "value"), "hour")


@_query("cluster_k_only")
def cluster_k_only(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(_flat(anonymize(rows, _event_rules(rows.columns), _config(l=0)), "value"), "hour")


#: One open cluster that takes every row until the first is due: groups are runs of 201 rows, none large enough to split.
_WINDOWS = {"subject": "event_id", "k": 101, "beta": 1, "shards": 1, "flush": "none"}
_NUMBERED = "(SELECT event_id, ts, user_id, value, hour(ts) AS hour, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)"
_WINDOWED = f"(SELECT *, i // 201 AS w FROM {_NUMBERED} x WHERE i // 201 < n // 201)"


@_query("cluster_windows", f"""
SELECT event_id, ts, user_id, event_type, 'cluster' AS _status, (least(CAST(vhi - vlo AS FLOAT) / CAST(600 AS FLOAT), CAST(1 AS FLOAT)) + least(CAST(hhi - hlo AS FLOAT) / CAST(23 AS FLOAT), CAST(1 AS FLOAT))) / CAST(2 AS FLOAT) AS info_loss, vlo AS value_lo, vhi AS value_hi, CAST(hlo AS BIGINT) AS hour_lo, CAST(hhi AS BIGINT) AS hour_hi
FROM (SELECT *, min(value) OVER (PARTITION BY w) AS vlo, max(value) OVER (PARTITION BY w) AS vhi, min(hour) OVER (PARTITION BY w) AS hlo, max(hour) OVER (PARTITION BY w) AS hhi FROM {_WINDOWED} y) z""")
def cluster_windows(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(_flat(anonymize(rows, _event_rules(rows.columns), _config(**_WINDOWS)), "value"), "hour")


@_query("cluster_suppressed", f"SELECT event_id, ts, user_id, event_type, 'suppressed' AS _status, CAST(1 AS FLOAT) AS info_loss, CAST(0 AS DOUBLE) AS value_lo, CAST(600 AS DOUBLE) AS value_hi, CAST(0 AS BIGINT) AS hour_lo, CAST(23 AS BIGINT) AS hour_hi FROM {_NUMBERED} x WHERE i < n - 200")
def cluster_suppressed(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(_flat(anonymize(rows, _event_rules(rows.columns), _config(subject="event_id", k=202, shards=1, flush="none")), "value"), "hour")


@_query("cluster_single_rows", "SELECT event_id, ts, user_id, event_type, 'cluster' AS _status, CAST(0 AS FLOAT) AS info_loss, value AS value_lo, value AS value_hi, hour(ts) AS hour_lo, hour(ts) AS hour_hi FROM events")
def cluster_single_rows(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(_flat(anonymize(rows, _event_rules(rows.columns), _config(k=1, l=0, delta=0)), "value"), "hour")


@_query("cluster_metrics", f"SELECT 101 AS k, 2 AS l, 1 AS sensitive_columns, max(n) % 201 AS held_rows, 1 AS rule_sets, 0 AS suppressed_rows, 0 AS merged_clusters, max(n) // 201 AS collected_clusters, 0 AS reused_clusters, CAST(ceil(max(n) / 201) AS BIGINT) AS created_clusters, 0 AS split_clusters FROM {_NUMBERED} x")
def cluster_metrics(spark, sf_dir):
    rows = _events(spark, sf_dir)
    found = shard_metrics(rows, _event_rules(rows.columns), _config(**_WINDOWS))
    return found.select("k", "l", "sensitive_columns", "held_rows", "rule_sets", *COUNTERS)


@_query("cluster_several_sensitive")
def cluster_several_sensitive(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return _flat(anonymize(rows, _event_rules(rows.columns, second=True), _config(l=3)), "value")


def invariants(found: DataFrame, source: DataFrame, k: int, l: int) -> DataFrame:  # noqa: E741
    """One row: input rows, output rows, and how many groups or rows break what is promised."""
    kept = found.where("_status NOT IN ('suppressed', 'reused')")
    sizes = kept.groupBy("value", "hour").agg(F.count_distinct("user_id").alias("k"), F.count_distinct("event_type").alias("l"))
    raw = found.select("event_id", "value", "hour").join(source.select("event_id", F.col("value").alias("v"), F.col("hour").alias("h")), "event_id")
    out = found.agg(F.count("*").alias("rows_out"), F.count_distinct("event_id").alias("ids_out"))
    bad = sizes.agg(F.count_if(F.col("k") < k).alias("k_violations"), F.count_if(F.col("l") < l).alias("l_violations"))
    miss = raw.agg(F.count_if(~(F.col("v").between(F.col("value.lo"), F.col("value.hi")) & F.col("h").between(F.col("hour.lo"), F.col("hour.hi")))).alias("uncovered"))
    return source.agg(F.count("*").alias("rows_in")).join(F.broadcast(out)).join(F.broadcast(bad)).join(F.broadcast(miss))  # one row each


@_query("cluster_invariants", "SELECT count(*) AS rows_in, count(*) AS rows_out, count(*) AS ids_out, CAST(0 AS BIGINT) AS k_violations, CAST(0 AS BIGINT) AS l_violations, CAST(0 AS BIGINT) AS uncovered FROM events")
def cluster_invariants(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return invariants(_saved(anonymize(rows, _event_rules(rows.columns), _config())), rows, 5, 2)


@_query("cluster_k_only_invariants", "SELECT count(*) AS rows_in, count(*) AS rows_out, count(*) AS ids_out, CAST(0 AS BIGINT) AS k_violations, CAST(0 AS BIGINT) AS l_violations, CAST(0 AS BIGINT) AS uncovered FROM events")
def cluster_k_only_invariants(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return invariants(_saved(anonymize(rows, _event_rules(rows.columns), _config(l=0))), rows, 5, 0)


def _scratch(spark: SparkSession) -> str:
    """A new folder below the shared one that the session names; a temporary one only where all runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="hushframe-")
    return f"{shared.rstrip('/')}/hushframe-{uuid.uuid4().hex}"


def _saved(df: DataFrame) -> DataFrame:
    """Written once and read again, so that several uses don't repeat the clustering."""
    df.write.parquet(path := _scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@_query("stream_equals_batch", "SELECT CAST(0 AS BIGINT) AS only_stream, CAST(0 AS BIGINT) AS only_batch")
def stream_equals_batch(spark, sf_dir):
    rows, at = _events(spark, sf_dir), _scratch(spark)
    config = _config(flush="none", shards=2)
    # the batch runs beside the stream
    with ThreadPoolExecutor(1) as beside:
        batch = beside.submit(_saved, anonymize(rows, _event_rules(rows.columns), config))
        out = _streamed(spark, rows, config, at)
    a, b = spark.read.schema(out.schema).parquet(f"{at}/out"), batch.result()
    flat = lambda d, tag: _flat(_flat(d, "value"), "hour").withColumn("side", F.lit(tag))
    both = flat(a, 1).unionByName(flat(b, -1))
    each = both.groupBy(*(c for c in both.columns if c != "side")).agg(F.sum("side").alias("n"))
    return each.agg(F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("only_stream"), F.coalesce(F.sum(F.greatest(-F.col("n"), F.lit(0))), F.lit(0)).alias("only_batch"))


def _streamed(spark, rows: DataFrame, config: AnonymizerConfig, at: str) -> DataFrame:
    """Runs the rows through a stream below a folder; the streaming DataFrame."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    # four files by time, one for each micro-batch; the query stops after two and starts again from its checkpoint
    at_ts = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = [None, *rows.agg(F.percentile_approx(at_ts, [0.25, 0.5, 0.75])).first()[0], None]
    for i, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        part = rows.where((F.lit(True) if lo is None else at_ts > lo) & (F.lit(True) if hi is None else at_ts <= hi))
        part.coalesce(1).write.mode("append").parquet(f"{at}/in")
        if i % 2:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
            out = with_counters(anonymize_stream(stream, _event_rules(rows.columns), config))
            out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return out
