import socket
import threading
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry
from hushframe.functions import geo, groups
from hushframe.functions.generalizers import Aggregation, Categories, NoneGeneralizer, Reduction
from hushframe.functions.hierarchy import Hierarchy
from hushframe.operators.batch import anonymize
from hushframe.plans import catalog, jobs
from hushframe.rules import AnonymizerConfig, Rule, RuleSet
from hushframe.sources import taxi, text
from hushframe.streaming.operator import anonymize_stream, with_counters, with_rule_updates

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(plain(v) for v in r) for r in got.select(*names).collect()))) == sorted(map(str, (tuple(plain(v) for v in r) for r in cur.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_groups_agree_with_kernel_values(spark):
    rows = [("a", "123456", 5, "Ball"), ("a", "123567", None, "Cylinder"), ("b", None, None, None), ("b", "", 1, "new")]
    df = spark.createDataFrame(rows, "g string, s string, n int, c string")
    tree = Hierarchy([["Round", "Ball"], ["Round", "Cylinder"], ["NotRound", "Cube"]])
    rules = RuleSet.of(df.columns, Rule("g", NoneGeneralizer()), Rule("s", Reduction()), Rule("n", Aggregation(0, 10, "int")), Rule("c", Categories(tree)))
    got = {r.g: (r.s, (r.n.lo, r.n.hi), r.c) for r in groups.generalize_groups(df, ["g"], rules).collect()}
    assert got == {"a": ("123***", (5, 5), "Round"), "b": ("", (1, 1), "new")}


def test_enlargement_is_the_growth_of_the_loss(spark):
    tree = Hierarchy([["Round", "Ball"], ["Round", "Cylinder"], ["NotRound", "Cube"]])
    rules = RuleSet.of(("s", "n", "c"), Rule("s", Reduction()), Rule("n", Aggregation(0, 10, "int")), Rule("c", Categories(tree)))
    rows = [("a", "123456", 5, "Ball"), ("a", "123567", None, "Cylinder"), ("b", None, None, None), ("c", "12", 1, "Cube")]
    probes = [(1, "123999", 7, "Ball"), (2, "99", 0, "Cube"), (3, None, None, None), (4, "123450", 6, "Ball"), (4, "124", 9, "Cylinder")]
    df, asked = spark.createDataFrame(rows, "g string, s string, n int, c string"), spark.createDataFrame(probes, "p int, s string, n int, c string")
    got = {(r.g, r.p): r.enlargement for r in groups.enlargement(df, ["g"], rules, asked, "p").collect()}
    together = [(f"{g}{p}", *x[1:]) for g in "abc" for p in range(5) for x in [*rows, *probes] if x[0] in (g, p)]
    loss = {r.g: r.info_loss for r in groups.generalize_groups(spark.createDataFrame(together, df.schema), ["g"], rules).collect()}
    assert len(got) == 12
    for (g, p), v in got.items():
        assert v == pytest.approx(loss[f"{g}{p}"] - loss[f"{g}0"])


def test_greedy_diversity_by_hand(spark):
    """Against rounds over single rows: the most frequent (column, value), ties to the earlier column, then by text."""
    rows = [(g, (7 * i * g) % 5 if i % 11 else None, "xyz"[(i * i + g) % 3] if i % 7 else None) for g in range(1, 7) for i in range(3 * g)]
    got = {r.g: r.diversity for r in groups.greedy_diversity(spark.createDataFrame(rows, "g int, a int, b string"), ["g"], ["a", "b"]).collect()}
    for g in range(1, 7):
        left, rounds = [r[1:] for r in rows if r[0] == g], 0
        while left:
            found = {(c, r[c]) for r in left for c in (0, 1)}
            c, v = min(found, key=lambda f: (-sum(r[f[0]] == f[1] for r in left), f[0], str(f[1])))
            left, rounds = [r for r in left if r[c] != v], rounds + 1
        assert got[g] == rounds


def rows_of(spark, n=400):
    return spark.range(n).select(F.col("id").alias("seq"), (F.xxhash64("id") % 40).alias("subject"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 10).alias("v"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(4)).alias("s"))


def rules_of(hi=100):
    cols = ("seq", "subject", "v", "s")
    return RuleSet.of(cols, Rule("seq", NoneGeneralizer()), Rule("subject", NoneGeneralizer()), Rule("v", Aggregation(0, hi)), Rule("s", NoneGeneralizer(), sensitive=True))


def test_batch_does_not_depend_on_partitions(spark):
    config = AnonymizerConfig("subject", k=3, l=2, delta=20, order=("seq",), shards=3, show_info_loss=True)
    a = sorted(map(str, anonymize(rows_of(spark), rules_of(), config).collect()))
    b = sorted(map(str, anonymize(rows_of(spark).repartition(7), rules_of(), config).collect()))
    assert a == b and len(a) > 200
    assert anonymize(rows_of(spark).limit(0), rules_of(), config).count() == 0


def test_column_without_rule_is_never_let_out(spark):
    config = AnonymizerConfig("subject", k=2, l=0, delta=5, order=("seq",), flush="release")
    cols = ("seq", "subject", "v", "s")
    got = anonymize(rows_of(spark, 50), RuleSet.of(cols, Rule("seq", NoneGeneralizer()), Rule("subject", NoneGeneralizer())), config)
    assert got.where("v IS NOT NULL OR s IS NOT NULL").count() == 0 and got.count() == 50


def test_stream_equals_batch_across_micro_batches(spark, tmp_path):
    config = AnonymizerConfig("subject", k=3, l=2, delta=20, order=("seq",), shards=2, show_info_loss=True)
    source = str(tmp_path / "in")
    for i in range(3):
        rows_of(spark).where(f"seq >= {i * 150} AND seq < {i * 150 + 150}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows_of(spark).schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = with_counters(anonymize_stream(stream, rules_of(), config))
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(str, anonymize(rows_of(spark), rules_of(), config).collect()))
    assert sum(p["observedMetrics"]["anonymizer"]["rows"] for p in q.recentProgress if "anonymizer" in p.get("observedMetrics", {})) == len(got)


def test_rules_change_on_the_way(spark, tmp_path):
    config = AnonymizerConfig("subject", k=2, l=0, delta=4, order=("seq",), shards=2, suppress=2)
    source = str(tmp_path / "in")
    data = rows_of(spark, 200)
    updates = spark.createDataFrame([(20, 0), (100, 1)], "seq long, _rules int")
    with_rule_updates(data, updates, config).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    sets = [rules_of(100), rules_of(1000)]
    q = anonymize_stream(stream, sets, config).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.agg(F.min("seq")).first()[0] >= 20 and got.count() > 150


def test_lines(spark):
    lines = spark.createDataFrame([("1;2.5;x",), ("a;;",), ("9",)], "value string")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    assert [tuple(r) for r in text.parse_delimited(lines, schema).collect()] == [(1, 2.5, "x"), (None, None, ""), (9, None, None)]
    shown = spark.sql("SELECT 1 AS a, array('x', 'y') AS b, named_struct('lo', 1.5D, 'hi', 2D) AS c, CAST(NULL AS string) AS d")
    assert text.format_delimited(shown).first().value == "1;[x, y];(1.5,2.0);null"
    census = spark.createDataFrame([("39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, Not-in-family, White, Male, 2174, 0, 40, United-States, <=50K",), ("short, line",)], "value string")
    rows = text.parse_census(census).orderBy("id").collect()
    assert rows[0]["age"] == 39.0 and rows[0]["education"] == "Bachelors" and rows[0]["marital-status"] == "Never-married" and rows[1]["workclass"] is None


def test_socket_writer(spark):
    server, got = socket.create_server(("127.0.0.1", 0)), []

    def serve():
        while True:
            try:
                c, _ = server.accept()
            except OSError:
                return
            with c, c.makefile() as f:
                got.extend(f.read().splitlines())

    t = threading.Thread(target=serve, daemon=True)
    t.start()
    text.socket_writer("127.0.0.1", server.getsockname()[1])(spark.range(5), 0)
    server.close()
    t.join(5)
    assert sorted(got) == [str(i) for i in range(5)]


def test_jobs(spark, tmp_path):
    line = "39, State-gov, 77516, Bachelors, 13, Never-married, Adm-clerical, {}, White, Male, 2174, 0, 40, United-States, <=50K"
    (tmp_path / "census.txt").write_text("\n".join(line.format(x) for x in ["Husband", "Wife", "Unmarried"] * 40))
    config = AnonymizerConfig("id", k=3, l=1, delta=10, order=("id",), show_info_loss=True)
    out = jobs.census_job(spark, config, str(tmp_path / "census.txt"))
    assert out.count() > 90 and out.where("age.lo = 39").count() > 0
    fares = jobs.taxi_job(spark, AnonymizerConfig("taxi_id", k=3, l=2, delta=50, order=("ride_id",), show_info_loss=True), 300)
    assert fares.count() > 200
    energy = jobs.energy_lines(spark.createDataFrame([("1;2;3.5;Office;20;1990;3;1;2;1;0;1;1;1;1;1451600000000000001;5;6",)], "value string"))
    assert energy.first()["METER_READING"] == "3.5" and energy.first()["PRIMARY_USE"] == "Office"


def _walk(x, y, to_x, to_y):
    """Cells of a line between the middles of two cells by fractions, one border at a time; x doesn't fall."""
    up, wide, high = (1 if to_y >= y else -1), to_x - x, abs(to_y - y)
    i = r = 0
    out = [(x, y)]
    while (i, r) != (wide, high):
        over = Fraction(2 * i + 1, 2 * wide) * high - r - Fraction(1, 2) if i < wide else 1  # of the row's far border
        corner = abs(over) < Fraction(1, 20)
        i, r = i + (corner or over < 0), r + (corner or over > 0)
        out.append((x + i, y + up * r))
    return out


def test_cells_on_way(spark):
    ends = [(a, 200, 20, b) for a in (20, 3, 0) for b in range(140, 260, 3)] + [(20, 200, 20, 200), (5, 90, 45, 91), (5, 90, 200, 93), (5, 90, 200, 87), (5, 90, 6, 130)]
    ends += [(a, b, a + n, b + m) for a, b, n, m in ((7, 300, 9, 9), (7, 300, 9, -9), (7, 300, 5, 15), (7, 300, 15, -5))]  # through corners
    lon, lat = (lambda x: -74.05 + 0.0014 * (x + 0.5)), (lambda y: 41 - 0.00125 * (y + 0.5))
    rows = [(k, lon(a), lat(b), lon(c), lat(d)) for k, (a, b, c, d) in enumerate(ends)]
    df = spark.createDataFrame([*rows, (-1, None, 40.7, -74.0, 40.7)], "k int, a double, b double, c double, d double")
    got = {r.k: r.cells for r in df.select("k", geo.cells_on_way(*map(F.col, "abcd")).alias("cells")).collect()}
    back = {r.k: r.cells for r in df.select("k", geo.cells_on_way(*map(F.col, "cdab")).alias("cells")).collect()}
    assert got[-1] is None
    for k, (a, b, c, d) in enumerate(ends):
        assert got[k] == [x + y * geo.GRID_X for x, y in _walk(a, b, c, d)]
        assert back[k] == (got[k] if a < c else got[k][::-1])


def test_cells_on_way_compute_positions_once(spark):
    df = spark.createDataFrame([(-74.0, 40.7, -73.8, 40.9)], "a double, b double, c double, d double")
    plan = df.select(geo.cells_on_way(*map(F.col, "abcd")).alias("cells"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(str(geo.DELTA_LON)) == 2 and plan.count(str(geo.DELTA_LAT)) == 2  # not for each cell


@pytest.fixture(scope="module")
def beyond(spark, tmp_path_factory):
    """Events of which some have values outside the declared domain; they come second or later in their group."""
    at = str(tmp_path_factory.mktemp("beyond"))
    value = F.when(F.col("event_id") % 97 == 5, F.col("value") + 640 + F.col("event_id")).otherwise(F.col("value"))
    spark.read.parquet("/root/testdata/sf0.01/events.parquet").where("event_id < 4000").withColumn("value", value).coalesce(1).write.parquet(f"{at}/events.parquet")
    return at


def equals_sql(spark, name, at):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{at}/events.parquet/*.parquet')")
    cur = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    got = [tuple(plain(v) for v in r) for r in catalog.QUERIES[name](spark, at).select(*names).collect()]
    return sorted(map(str, got)) == sorted(str(tuple(plain(v) for v in r)) for r in cur.fetchall())


def test_suppressed_rows_show_the_declared_domain(spark, beyond):
    assert equals_sql(spark, "cluster_suppressed", beyond)


def test_losses_are_shares_of_the_declared_domain(spark, beyond):
    assert equals_sql(spark, "cluster_windows", beyond)


@pytest.mark.parametrize("name", ["cluster_invariants", "cluster_k_only_invariants"])
def test_rows_beyond_the_domain_are_covered(spark, beyond, name):
    assert equals_sql(spark, name, beyond)


@pytest.mark.parametrize("name", ["cluster_invariants", "cluster_k_only_invariants"])
@pytest.mark.parametrize("rows", [1500, 2500, 4000])
def test_last_rows_beyond_the_domain_are_covered(spark, tmp_path, name, rows):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").where(F.col("event_id") < rows)
    events.withColumn("value", F.col("value") + 640 + 10 * (F.col("event_id") % 350)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert equals_sql(spark, name, str(tmp_path))


def test_rides(spark):
    r = taxi.rides(spark, 100)
    assert r.count() == 200 and taxi.in_ride_order(r).first().is_start
    first = {(x.ride_id, x.is_start): i for i, x in enumerate(r.orderBy("seq").collect())}
    assert len(first) == 200
