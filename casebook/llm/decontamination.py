"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions alone.

The index holds one posting (document, position, term) for every place where a document has a word of any benchmark
item, and one end mark a document (the empty term, at the position after the last word). Words that no item holds can
match nothing and have no posting. Phrase search runs over it from the rarest terms on:

1. A window's two rarest terms, by postings, name it. Neighbouring windows mostly share them, so an item has few such
   pairs. The list of the rarer term, shifted by its offset, gives diagonals (document, position minus offset).
2. The list of the other term, shifted likewise, is intersected with them by an equi-join on (document, term, position).
3. For the diagonals left, the lists of all further terms of the windows concerned are intersected in one such join.
   A run of matched offsets as long as a window is an exact occurrence.

Proximity search takes the rarest term's list too, looks for the other terms near its places by blocks of positions,
and keeps the items whose words all lie within a given span.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm.common import keyed, pick, stored

WINDOW = 10
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z; null has none."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))
    return F.array_remove(F.split(lowered, _BREAKS), "")


@dataclass
class Index:
    """``rows`` (_row, doc_id), ``postings`` (_row, pos, term) with end marks under term 0, ``terms`` (item text
    number ``text``, offset ``o``, ``term``, postings ``n``, ``length``) and ``items`` (text, item_id)."""

    rows: DataFrame
    postings: DataFrame
    terms: DataFrame
    items: DataFrame


def index(docs: DataFrame, benchmark: DataFrame) -> Index:
    """The positional index of ``docs`` (doc_id, text) over the words of ``benchmark`` (item_id, text), stored.

    Items of equal words are one text. Rows of null text, or without words, have an end mark at position 0 only.
    Repeated and null doc_ids stay rows of their own.
    """
    items = pick(benchmark, item_id="string", text="string").select("item_id", words(F.col("text")).alias("words")).filter("size(words) > 0")
    items = items.groupBy("words").agg(F.collect_set("item_id").alias("ids"))
    items = stored(items.withColumn("text", F.monotonically_increasing_id()), "benchmark-texts")
    placed = items.select("text", F.size("words").alias("length"), F.posexplode("words").alias("o", "word"))
    known = placed.select("word").distinct().withColumn("term", F.monotonically_increasing_id() + 1)
    known = stored(known.union(docs.sparkSession.sql("SELECT '', 0L")), "benchmark-words")
    rows = keyed(docs, text="string")
    # a stored table's size is known when the join is planned: it is broadcast below the session's threshold only
    found = rows.select("_row", F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word"))
    postings = stored(found.join(known, "word").select("_row", "pos", "term"), "postings")
    counted = postings.groupBy("term").agg(F.count("*").alias("n"))
    terms = placed.join(known, "word").join(counted, "term", "left").select("text", "o", "term", F.coalesce("n", F.lit(0)).alias("n"), "length")
    return Index(rows.select("_row", "doc_id"), postings, stored(terms, "benchmark-terms"), items.select("text", F.explode("ids").alias("item_id")))


def phrases(ix: Index, window: int = WINDOW) -> DataFrame:
    """``_row, text, pos, length, at``: the maximal runs of ``length`` document words from ``pos`` on that stand in an
    item text in the same order from its word ``at`` on, of at least ``window`` words (of the whole text, if it has fewer)."""
    size = F.least(F.lit(window), F.col("length"))
    spots = F.array_sort(F.collect_list(F.struct("o", "n", "term")))
    texts = ix.terms.groupBy("text", "length").agg(spots.alias("spots"))
    starts = texts.select("text", F.explode(F.sequence(F.lit(0), F.col("length") - size)).alias("s"), size.alias("size"), "spots")
    rare = F.array_sort(F.transform(F.slice("spots", F.col("s") + 1, F.col("size")), lambda x: F.struct(x.n.alias("n"), x.o.alias("o"), x.term.alias("term"))))
    starts = starts.select("text", "s", "size", F.element_at(rare, 1).alias("a"), F.element_at(rare, F.least(F.lit(2), F.col("size"))).alias("b"))
    pairs = starts.filter("a.n > 0").groupBy("text", F.col("a.o").alias("o1"), F.col("a.term").alias("term1"), F.col("b.o").alias("o2"), F.col("b.term").alias("term2"))
    pairs = stored(pairs.agg(F.min("s").alias("first"), (F.max(F.col("s") + F.col("size")) - 1).alias("last")), "rare-pairs")

    one = ix.postings.join(pairs.withColumnRenamed("term1", "term"), "term")
    one = one.select("_row", "text", (F.col("pos") - F.col("o1")).alias("diagonal"), (F.col("pos") - F.col("o1") + F.col("o2")).alias("pos"), F.col("term2").alias("term"), "first", "last")
    second = ix.postings.join(pairs.select(F.col("term2").alias("term")).distinct(), "term", "left_semi")
    two = stored(one.join(second, ["_row", "term", "pos"]).select("_row", "text", "diagonal", "first", "last"), "diagonals")

    wanted = two.select("_row", "text", "diagonal", F.explode(F.sequence("first", "last")).alias("o")).distinct()
    wanted = wanted.join(ix.terms.select("text", "o", "term", "length"), ["text", "o"]).withColumn("pos", F.col("diagonal") + F.col("o"))
    there = ix.postings.join(stored(two.select("_row").distinct(), "candidates"), "_row", "left_semi")
    matched = wanted.join(there, ["_row", "term", "pos"])
    line = Window.partitionBy("_row", "text", "diagonal").orderBy("o")      # at most as many rows as the item has words
    runs = matched.withColumn("run", F.col("o") - F.row_number().over(line))
    runs = runs.groupBy("_row", "text", "diagonal", "run").agg(F.min("o").alias("at"), F.count("*").cast("int").alias("run_length"), F.first("length").alias("length"))
    return runs.filter(F.col("run_length") >= size).select("_row", "text", (F.col("diagonal") + F.col("at")).alias("pos"), F.col("run_length").alias("length"), "at")


def near(ix: Index, span: int) -> DataFrame:
    """``_row, text, pos``: places ``pos`` such that the ``span`` document words from ``pos`` on hold every distinct
    word of the item text in any order, the word at ``pos`` being one of them. Texts of more than ``span`` distinct words match nothing."""
    distinct = ix.terms.groupBy("text", "term").agg(F.first("n").alias("n"))
    needed = distinct.groupBy("text").agg(F.count("*").alias("needed"), F.min(F.struct("n", "term")).alias("rarest")).filter((F.col("needed") <= span) & (F.col("rarest.n") > 0))
    needed = stored(needed.select("text", "needed", F.col("rarest.term").alias("term")), "rarest")
    # the rarest word lies in the span, so all others lie in its block of positions or a neighbouring one
    spread = F.explode(F.array(*[F.floor(F.col("pos") / span).cast("int") + i for i in (-1, 0, 1)]))
    blocks = ix.postings.join(needed, "term").select("_row", "text", "needed", spread.alias("block")).distinct()
    wanted = stored(blocks.join(distinct.select("text", "term"), "text"), "near-blocks")
    there = ix.postings.join(stored(wanted.select("_row").distinct(), "candidates"), "_row", "left_semi").withColumn("block", F.floor(F.col("pos") / span).cast("int"))
    found = wanted.join(there, ["_row", "term", "block"])
    ahead = Window.partitionBy("_row", "text").orderBy("pos").rangeBetween(Window.currentRow, span - 1)
    return found.withColumn("held", F.size(F.collect_set("term").over(ahead))).filter(F.col("held") == F.col("needed")).select("_row", "text", "pos")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` and ``items``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; items without words or text
    have none. ``n_hit`` counts the document words inside any occurrence, ``items`` lists the distinct non-null
    item_ids with occurring windows, sorted as strings; an item without an id still gives hits. ``items_sha256`` is of
    these ids joined by commas, of the empty string if there are none. Null and empty texts have no words. Repeated
    rows and ids get a row each; an empty table gives none, an empty benchmark no hits.
    """
    ix = index(docs, benchmark)
    found = stored(phrases(ix, window).select("_row", "text", "pos", "length"), "occurrences")
    hits = found.select("_row", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("length") - 1)).alias("p")).distinct()
    hits = hits.groupBy("_row").agg(F.count("*").alias("n_hit"))
    items = found.select("_row", "text").distinct().join(ix.items, "text").groupBy("_row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    ends = ix.postings.filter("term = 0").select("_row", F.col("pos").cast("long").alias("n_words"))
    out = ix.rows.join(ends, "_row").join(hits, "_row", "left").join(items, "_row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), items.alias("items"))
