"""Reproducible train / test splits.

A row's side depends only on a hash of its key (and a salt), so the split is the
same for any partitioning, executor count or re-run, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.operators.prefix import scan


def hash_pct(key, salt: str = "") -> Column:
    """0..99 from the first 32 bits of md5(salt || key) (same value in DuckDB:
    ``('0x' || substr(md5(salt || k::varchar), 1, 8))::bigint % 100``)."""
    k = F.col(key) if isinstance(key, str) else key
    s = F.concat(F.lit(salt), k.cast("string"))
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def split_hash(df: DataFrame, key: str, test_pct: int = 30, salt: str = "") -> tuple[DataFrame, DataFrame]:
    """(train, test) with ``hash_pct(key) < test_pct`` in test."""
    h = hash_pct(key, salt)
    return df.where(h >= test_pct), df.where(h < test_pct)


def split_stratified(df: DataFrame, key: str, label: str, test_pct: float = 0.3, salt: str = "",
                     parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Per label exactly ``floor(n_label * test_pct)`` rows go to test: those with
    the smallest (md5 hash, key). Ranks are a prefix scan over label and hash, so no
    label is ever collected into one task."""
    hk = F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.col(key).cast("string"))), 1, 12), 16, 10).cast("bigint")
    h = df.withColumn("_h", hk).withColumn("_one", F.lit(1))
    ranked = scan(h, [F.col("_h"), F.col(key)], {"_one": "_r"}, partition=[label], totals={"_one": "_n"}, parts=parts)
    in_test = F.col("_r") <= F.floor(F.col("_n") * F.lit(test_pct))
    test, train = (ranked.where(c).drop("_h", "_one", "_r", "_n") for c in (in_test, ~in_test))
    return train, test


def tag_split(df: DataFrame, key: str, test_pct: int = 30, salt: str = "", name: str = "is_test") -> DataFrame:
    return df.withColumn(name, hash_pct(key, salt) < test_pct)


__all__: Sequence[str] = ["hash_pct", "split_hash", "split_stratified", "tag_split"]
