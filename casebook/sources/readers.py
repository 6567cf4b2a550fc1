"""Readers for delimited text. Declared schemas are preferred: inference costs an
extra pass over the files and can change types between runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True,
             sep: str = ",", encoding: str | None = None, quoted: bool = False,
             infer: bool = False, date_format: str | None = None, null_value: str | None = None) -> DataFrame:
    """CSV / TSV scan.

    ``schema`` (DDL string) skips inference; ``quoted`` turns on RFC-4180 quoting
    with embedded newlines (``multiLine`` — such files are read one task per
    file, so keep them many and small); ``encoding`` e.g. ``'ISO-8859-1'``.
    """
    r = spark.read.option("header", header).option("sep", sep)
    if encoding:
        r = r.option("encoding", encoding)
    if quoted:
        r = r.option("quote", '"').option("escape", '"').option("multiLine", True)
    if date_format:
        r = r.option("dateFormat", date_format)
    if null_value is not None:
        r = r.option("nullValue", null_value)
    if schema:
        r = r.schema(schema)
    elif infer:
        r = r.option("inferSchema", True)
    return r.csv(path)


def parse_date_columns(df: DataFrame, cols: Sequence[str], fmt: str) -> DataFrame:
    """Text columns → DATE with ``try_to_date`` (unparsable → NULL)."""
    return df.withColumns({c: F.try_to_date(F.col(c), fmt) for c in cols})


def read_partitioned(spark: SparkSession, path: str, fmt: str = "orc") -> DataFrame:
    """Read a partitioned directory; filters on partition columns prune directories."""
    return spark.read.format(fmt).load(path)
