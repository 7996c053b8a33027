"""Delimited text in and out, over files, object stores and sockets."""

from __future__ import annotations

import socket

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Lines of text files of any store that Spark reads, as column value."""
    return (spark.readStream if stream else spark.read).text(path)


def socket_lines(spark: SparkSession, host: str = "127.0.0.1", port: int = 50051) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load()


def parse_delimited(lines: DataFrame, schema: T.StructType, separator: str = ";", least: int = 0) -> DataFrame:
    """Columns of a schema from lines; what doesn't fit its type, and every field of a line with too few, is null."""
    parts = F.split("value", separator.replace("|", r"\|").replace("^", r"\^"), -1)
    fields = []
    for i, f in enumerate(schema.fields):
        text = F.get(parts, F.lit(i))
        value = text if isinstance(f.dataType, T.StringType) else F.trim(text).try_cast(f.dataType)
        fields.append((F.when(F.size(parts) >= least, value) if least else value).alias(f.name))
    return lines.select(*fields)


def _shown(field: T.StructField) -> Column:
    c, kind = F.col(field.name), field.dataType
    if isinstance(kind, T.StructType):
        c = F.concat(F.lit("("), F.concat_ws(",", *(F.col(field.name)[x.name].cast("string") for x in kind.fields)), F.lit(")"))
        c = F.when(F.col(field.name).isNotNull(), c)
    elif isinstance(kind, T.ArrayType):
        c = F.when(F.col(field.name).isNotNull(), F.concat(F.lit("["), F.array_join(F.col(field.name).cast("array<string>"), ", "), F.lit("]")))
    else:
        c = c.cast("string")
    return F.coalesce(c, F.lit("null"))


def format_delimited(df: DataFrame, separator: str = ";") -> DataFrame:
    """One line per row: ranges as (lo,hi), arrays as [a, b], nulls as null."""
    return df.select(F.concat_ws(separator, *map(_shown, df.schema.fields)).alias("value"))


def socket_writer(host: str = "127.0.0.1", port: int = 50052, separator: str = ";"):
    """A foreachBatch function that sends rows as lines; each partition opens its own connection."""

    def send(rows) -> None:
        with socket.create_connection((host, port)) as s:
            for r in rows:
                s.sendall((r.value + "\n").encode())

    return lambda batch, _: format_delimited(batch, separator).foreachPartition(send)


# The fields of a census line, of which education-num is not kept, and of the loaded table.
CENSUS_RAW = ("age", "workclass", "fnlwgt", "education", "education-num", "marital-status", "occupation", "relationship", "race", "sex", "capital-gain", "capital-loss", "hours-per-week", "native-country", "income")
CENSUS_NUMBERS = ("age", "fnlwgt", "capital-gain", "capital-loss", "hours-per-week")


def parse_census(lines: DataFrame) -> DataFrame:
    """Census lines, fields parted by comma and space: an id per row, then all fields but education-num; short lines are null.

    Ids are unique and follow the order of lines within a partition.
    """
    schema = T.StructType([T.StructField(c, T.FloatType() if c in CENSUS_NUMBERS else T.StringType()) for c in CENSUS_RAW])
    rows = parse_delimited(lines, schema, ", ", least=len(CENSUS_RAW)).drop("education-num")
    return rows.withColumn("id", F.monotonically_increasing_id()).select("id", *(c for c in CENSUS_RAW if c != "education-num"))
