"""Sinks. All paths are expected under shared storage (see ``session.scratch_path``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "orc",
                      compression: str = "snappy", dynamic: bool = True) -> None:
    """Dynamic-partition overwrite (``INSERT OVERWRITE … PARTITION``).

    Rows are first rebalanced by the partition columns: each task writes few files
    per partition, and adaptive execution splits a value that holds many rows over
    several tasks. The overwrite mode is an option of this write alone.
    """
    (df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by)
       .option("partitionOverwriteMode", "dynamic" if dynamic else "static")
       .option("compression", compression).format(fmt).save(path))


def replace_table(df: DataFrame, name: str, path: str, fmt: str = "parquet") -> None:
    """``DROP TABLE IF EXISTS`` then create it again at an explicit shared location."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.mode("overwrite").format(fmt).option("path", path).saveAsTable(name)


def write_csv(df: DataFrame, path: str, header: bool = True, sep: str = ",", encoding: str | None = None,
              quoted: bool = False) -> None:
    """CSV text. A character that a one-byte ``encoding`` lacks fails the write
    instead of being replaced."""
    if encoding and encoding.upper() in ("ISO-8859-1", "US-ASCII"):
        df = df.withColumns({c: F.decode(F.encode(F.col(f"`{c}`"), encoding), encoding)
                             for c, kind in df.dtypes if kind == "string"})
    w = df.write.mode("overwrite").option("header", header).option("sep", sep)
    if encoding:
        w = w.option("encoding", encoding)
    if quoted:
        w = w.option("quote", '"').option("escape", '"').option("quoteAll", True)
    w.csv(path)
