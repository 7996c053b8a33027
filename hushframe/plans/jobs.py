"""Ready jobs, run as python -m hushframe.plans.jobs NAME --k 5 --l 2 ..."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batch import anonymize
from ..rules import SUPPRESS_DROP, SUPPRESS_NULL, AnonymizerConfig
from ..sources import taxi
from ..sources.text import format_delimited, parse_census, parse_delimited, read_lines, socket_lines, socket_writer
from ..streaming.operator import anonymize_stream, with_counters
from . import schemas


def energy_lines(lines: DataFrame) -> DataFrame:
    """Building energy readings from ;-parted lines."""
    numbers = schemas.ENERGY_DOMAINS
    kinds = [T.StructField(c, T.DoubleType() if c == "UNIXTIMESTAMP" else T.FloatType() if c in numbers else T.StringType() if c in ("PRIMARY_USE", "METER_READING") else T.LongType()) for c in schemas.ENERGY_COLUMNS]
    return parse_delimited(lines, T.StructType(kinds))


def energy_job(spark: SparkSession, config: AnonymizerConfig, source: tuple[str, int], sink: tuple[str, int], checkpoint: str):
    """Socket to socket; returns the running query."""
    rows = energy_lines(socket_lines(spark, *source))
    out = with_counters(anonymize_stream(rows, schemas.energy(), config))
    return out.writeStream.foreachBatch(socket_writer(*sink)).option("checkpointLocation", checkpoint).start()


def census_job(spark: SparkSession, config: AnonymizerConfig, path: str) -> DataFrame:
    rows = parse_census(read_lines(spark, path))
    return anonymize(rows, schemas.census(rows.columns), config)


def taxi_job(spark: SparkSession, config: AnonymizerConfig, n: int) -> DataFrame:
    rows = taxi.fares(spark, n)
    return anonymize(rows, schemas.taxi(rows.columns), config)


def with_latency(df: DataFrame, stamp: str) -> DataFrame:
    """Milliseconds since a stamp, in its place."""
    return df.withColumn(stamp, F.unix_millis(F.current_timestamp()) - F.unix_millis(F.col(stamp)))


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("job", choices=["energy", "census", "taxi"])
    for name, default in (("k", 5), ("l", 2), ("delta", 200), ("beta", 50), ("zeta", 10), ("mu", 10), ("shards", 1), ("rows", 1000)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--input")
    p.add_argument("--output")
    p.add_argument("--checkpoint")
    p.add_argument("--source", default="127.0.0.1:50051")
    p.add_argument("--sink", default="127.0.0.1:50052")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName(f"hushframe-{a.job}").getOrCreate()
    common = {"k": a.k, "l": a.l, "delta": a.delta, "beta": a.beta, "zeta": a.zeta, "mu": a.mu, "shards": a.shards, "show_info_loss": True}
    if a.job == "energy":
        ends = [(h, int(n)) for h, n in (x.rsplit(":", 1) for x in (a.source, a.sink))]
        energy_job(spark, AnonymizerConfig(subject="BUILDING_ID", suppress=SUPPRESS_DROP, **common), *ends, a.checkpoint).awaitTermination()
        return
    if a.job == "census":
        out = census_job(spark, AnonymizerConfig(subject="id", suppress=SUPPRESS_NULL, order=("id",), **common), a.input)
    else:
        out = taxi_job(spark, AnonymizerConfig(subject="taxi_id", order=("ride_id",), **common), a.rows)
    if a.output:
        format_delimited(out).write.text(a.output)
    else:
        out.show(truncate=False)


if __name__ == "__main__":
    main()
