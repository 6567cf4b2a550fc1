"""Plumbing shared by the corpus operators: column selection, row keys and stored intermediates."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.session import checkpoint_dir, ship_package


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns cast to the given types, found by exact name. Extra columns, also ones whose names
    differ only in case, equal an operator's working names or hold dots, have no effect."""
    names = df.columns
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"c{names.index(n)}").cast(t).alias(n) for n, t in columns.items()])


def keyed(docs: DataFrame, **columns: str) -> DataFrame:
    """``doc_id``, the named columns and ``_row``, a unique non-null long.

    ``_row`` is ``doc_id`` itself where that is unique and never null (one narrow count decides). Otherwise the
    rows are written once with a generated key, so that repeated and null ids stay separate rows; the key follows
    the order of doc_id, null last.
    """
    rows = pick(docs, doc_id="long", **columns)
    clash = rows.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL")
    if clash.isEmpty():
        return rows.withColumn("_row", F.col("doc_id"))
    return stored(rows.orderBy(F.col("doc_id").asc_nulls_last()).withColumn("_row", F.monotonically_increasing_id()), "keyed")


_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as Parquet under the shared checkpoint folder and read back: lineage ends there, so a lost
    executor costs a reread, not a recomputation. The folder is removed when the driver ends. ``options`` go to the
    writer."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 -- the JVM may be gone already
            return
