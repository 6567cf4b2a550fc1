"""Corpus pipeline: language ID, exact dedup, near dedup, substring dedup, packing.

Every stage is ``fn(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and reread as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import exact, langid, minhash, packing, substring
from casebook.llm.common import keyed, pick, stored
from casebook.llm.encoder import default_vocabulary
from casebook.session import ship_package

COLUMNS = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing ``lang`` becomes the predicted one."""
    ship_package(spark)
    rows = pick(docs, doc_id="long", **COLUMNS)
    found = langid.predict(rows, langid.train(rows))
    return found.filter("NOT rejected").select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def _kept(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    return rows.join(decisions.filter("NOT kept").select("_row"), "_row", "left_anti").select("doc_id", *COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    ship_package(spark)
    rows = keyed(docs, **COLUMNS)
    return _kept(rows, exact.decide(rows))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    ship_package(spark)
    rows = keyed(docs, **COLUMNS)
    return _kept(rows, minhash.decide(rows))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the units that an earlier place holds; ``n_chars`` follows the text."""
    ship_package(spark)
    return substring.decide(keyed(docs, **COLUMNS)).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in BPE ids, in sequences of the permitted lengths."""
    ship_package(spark)
    return packing.best_fit_packing(docs, vocabulary=default_vocabulary())


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies),
          ("substring_dedup", repeated_passages), ("packing", packed)]

#: Kneser-Ney models, star components and best-fit bins are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result stored before the next stage reads it."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
