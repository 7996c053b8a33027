"""Generated taxi fares and rides: all fields follow from the ride's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import LAT_NORTH, LAT_SOUTH, LON_EAST, LON_WEST

# The first ride's start, the time between rides, and the drivers.
BEGINNING, SECONDS_BETWEEN, FIRST_DRIVER, DRIVERS = "2020-01-01 12:00:00", 20, 2013000000, 200
# Ways to pay, as paths.
PAYMENTS = (("CARD", "APPLE PAY"), ("CASH", "Banknotes"), ("CASH", "Coins"), ("CARD", "CREDIT CARD"), ("CARD", "MAESTRO CARD"), ("CARD", "PAYPAL", "Ratenzahlung"), ("CARD", "PAYPAL", "Auf Rechnung"), ("CARD", "PAYPAL", "Direktzahlung"), ("9-Euro Ticket", "No payment"))


def _noise(name: str) -> Column:
    """Uniform in [0, 1), by field and ride id."""
    return F.pmod(F.xxhash64(F.lit(name), F.col("ride_id")), F.lit(1 << 30)) / float(1 << 30)


def _gauss(name: str, mean: float, sd: float, lo: float, hi: float) -> Column:
    """A normal number, held to an interval."""
    z = F.sqrt(-2 * F.log(1 - _noise(name + "r"))) * F.cos(6.283185307179586 * _noise(name + "a"))
    return F.least(F.greatest(z * sd + mean, F.lit(lo)), F.lit(hi))


def _fields(df: DataFrame) -> DataFrame:
    start = F.timestamp_seconds(F.unix_timestamp(F.lit(BEGINNING)) + SECONDS_BETWEEN * F.col("ride_id"))
    driver = FIRST_DRIVER + F.floor(_noise("driver") * DRIVERS).cast("long")
    pay = F.array(*(F.array(*map(F.lit, p)) for p in PAYMENTS))
    tolls = F.when(F.col("ride_id") % 10 == 0, F.floor(_gauss("tolls", 2.5, 1.25, 0, 5))).otherwise(0.0)
    minutes = F.floor(_gauss("minutes", 40, 20, 0, 600))
    out = df.withColumns({"start_time": start, "driver_id": driver, "taxi_id": driver, "payment_type": F.get(pay, F.floor(_noise("pay") * len(PAYMENTS)).cast("int")), "tip": F.floor(_gauss("tip", 15, 10, 0, 60)).cast("float"), "tolls": tolls.cast("float"), "minutes": minutes})
    return out.withColumns({"total_fare": (3.0 + F.col("minutes") + F.col("tip") + F.col("tolls")).cast("float"), "end_time": F.timestamp_seconds(F.unix_timestamp("start_time") + 60 * F.col("minutes"))})


def fares(spark: SparkSession, n: int) -> DataFrame:
    """n fares, ids from 1."""
    return _fields(spark.range(1, n + 1).withColumnRenamed("id", "ride_id")).select("ride_id", "taxi_id", "driver_id", "start_time", "payment_type", "tip", "tolls", "total_fare")


def fare_stream(spark: SparkSession, rows_per_second: int = 200) -> DataFrame:
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return _fields(source.select((F.col("value") + 1).alias("ride_id"))).select("ride_id", "taxi_id", "driver_id", "start_time", "payment_type", "tip", "tolls", "total_fare")


def rides(spark: SparkSession, n: int, batch: int = 5) -> DataFrame:
    """Start and end events of n rides, and ``seq``, the order in which they arrive.

    Starts come in shuffled batches; before a batch come the ends that are due, so some precede their start.
    """
    all_ = _fields(spark.range(1, n + 1).withColumnRenamed("id", "ride_id"))
    box = {"start_lon": (LON_WEST, LON_EAST), "start_lat": (LAT_SOUTH, LAT_NORTH), "end_lon": (LON_WEST, LON_EAST), "end_lat": (LAT_SOUTH, LAT_NORTH)}
    where = {c: _gauss(c, (lo + hi) / 2, (hi - lo) / 6, lo - 0.1, hi + 0.1).cast("float") for c, (lo, hi) in box.items()}
    all_ = all_.withColumns(where | {"passenger_cnt": (1 + F.floor(_noise("passengers") * 4)).cast("short")})
    number = F.floor((F.col("ride_id") - 1) / batch)
    starts = all_.withColumns({"is_start": F.lit(True), "event_time": F.col("start_time"), "turn": number, "place": _noise("turn")})
    due = F.unix_timestamp("end_time") - F.unix_timestamp(F.lit(BEGINNING))
    first = F.greatest(F.ceil(F.ceil(due / SECONDS_BETWEEN) / batch) - 1, number)
    ends = all_.withColumns({"is_start": F.lit(False), "event_time": F.col("end_time"), "turn": first, "place": -1.0 / (2 + due)})
    events = starts.unionByName(ends)
    # an order that sorts in ranges: the batch, ends by time before shuffled starts
    return events.select("ride_id", "is_start", "event_time", "start_lon", "start_lat", "end_lon", "end_lat", "passenger_cnt", "taxi_id", "driver_id", F.struct("turn", "is_start", "place", "ride_id").alias("seq"))


def in_ride_order(df: DataFrame) -> DataFrame:
    """By time, starts before ends."""
    return df.orderBy("event_time", F.desc("is_start"))
