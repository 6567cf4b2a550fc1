"""The operators over the driver tables: one thin query each, and its SQL where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casebook.llm import alignment, bm25, bpe, decontamination, exact, langid, minhash, negatives, packing, sharding, substring, toxicity, wavelet
from casebook.llm.common import read
from casebook.llm.encoder import default_vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn
    return put


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_bm25_top_k", f"""
WITH words AS (SELECT doc_id, unnest(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+')) AS term FROM documents),
     tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY 1, 2),
     dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
     df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
     n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM documents) AS mean),
     s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * d.tf * 2.2
                  / (d.tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
           FROM tf q JOIN tf d USING (term) JOIN df USING (term) JOIN dl ON dl.doc_id = d.doc_id, n
           WHERE q.doc_id % 50 = 0 GROUP BY 1, 2),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op1(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    return bm25.top_k(docs, docs.filter("doc_id % 50 = 0"), 10)


@query("op2_language_id")
def op2(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


@query("op3_minhash_near_dedup")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_dedup(read(spark, d, "documents"), words=2).drop("_row")


@query("op4_exact_dedup", """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) = doc_id AS kept,
       sha256(norm) AS text_sha256
FROM n""")
def op4(spark: SparkSession, d: str) -> DataFrame:
    return exact.exact_dedup(read(spark, d, "documents")).drop("_row")


@query("op5_substring_dedup")
def op5(spark: SparkSession, d: str) -> DataFrame:
    return substring.substring_dedup(read(spark, d, "documents"))


@query("op6_toxicity")
def op6(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    model = toxicity.train(docs.filter(~held_out()), read(spark, d, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op7_minimax_sharding")
def op7(spark: SparkSession, d: str) -> DataFrame:
    return sharding.contiguous_shards(read(spark, d, "documents"), 24)


@query("op8_best_fit_packing")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return packing.best_fit_packing(read(spark, d, "documents"), vocabulary=default_vocabulary())


@query("op9_wavelet_token_store")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return wavelet.token_store(read(spark, d, "documents"))


@query("op10_bpe_chunk_reuse")
def op10(spark: SparkSession, d: str) -> DataFrame:
    return bpe.round_trip(read(spark, d, "documents"))


@query("op11_token_alignment")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(read(spark, d, "documents"))


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query("op12_positional_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     size AS (SELECT DISTINCT least(len(w), 10) AS size FROM b WHERE len(w) > 0),
     windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS size, w[s:s + least(len(w), 10) - 1] AS phrase
                 FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(s) WHERE len(w) > 0),
     places AS (SELECT doc_id, s, size, w[s:s + size - 1] AS phrase FROM d, size, unnest(range(1, len(w) - size + 2)) AS t(s)),
     found AS (SELECT doc_id, s, size, item_id FROM places JOIN windows USING (size, phrase)),
     hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(s, s + size)) AS t(p) GROUP BY 1),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.contamination(read(spark, d, "documents"), read(spark, d, "benchmark")).drop("items")


@query("op13_hard_negatives", """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
                  CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank
           FROM p JOIN s USING (anchor_id)
           WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "embeddings").filter("NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return negatives.mine(rows.select("vec_id", label.alias("label"), whole.alias("embedding"), (F.col("vec_id") % 100 == 0).alias("anchor")))
