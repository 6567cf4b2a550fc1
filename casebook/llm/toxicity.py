"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier on its posterior.

From a bounded sample of labelled rows (``SAMPLE``, whole texts, drawn by hash):

1. lexicon: words and word beginnings (4 to 7 bytes) that labelled toxic documents hold far more often, counted in
   Spark; the ``LEXICON`` most significant stay, as sorted hashes;
2. voters: parts of the lexicon, hit counts and densities, and text patterns, each a yes or no per document; the
   given label is one more voter;
3. label model: a latent class model fitted by expectation maximisation. It estimates each voter's rate of yes on
   toxic and on clean documents and, from the class-conditional correlations, how far voters repeat each other;
   a voter's evidence is divided by one plus its summed correlations;
4. classifier: logistic regression on voters and hit counts, fitted to the posterior labels.

Scoring is one pass over the texts with the lexicon and weights alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import kernels
from casebook.llm.common import pick

SAMPLE, LEXICON, PARTS, LEAST_G = 20_000, 4000, 8, 20.0
PREFIXES = (4, 5, 6, 7)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def _marks(data: np.ndarray, off: np.ndarray):
    """(document of each word, features of all words as (word, hash) pairs) of lower-cased bytes."""
    start, end, doc = spans = kernels.spans(_LETTER[data], off)
    sums = kernels.PrefixHash(data)
    word, mark = [np.arange(len(start))], [sums.of(start, end)]
    for size in PREFIXES:
        long = np.flatnonzero(end - start >= size + 1)
        word.append(long)
        mark.append(sums.of(start[long], start[long] + size) ^ np.uint64(size))
    return spans[2] if len(start) else doc, np.concatenate(word), np.concatenate(mark)


def _count(batches):
    """(feature, documents by label) of a batch of (text, toxic)."""
    for batch in batches:
        toxic = batch.column(1).to_numpy().astype(np.int64)
        for i, j, data, off in kernels.blocks(pc.utf8_lower(batch.column(0).cast(pa.large_string()))):
            doc, word, mark = _marks(data, off)
            order = np.lexsort((doc[word], mark))
            mark, at = mark[order], doc[word][order]
            first = np.append(True, (mark[1:] != mark[:-1]) | (at[1:] != at[:-1])) if len(mark) else np.zeros(0, bool)
            mark, yes = mark[first], toxic[i:j][at[first]]
            h, inverse = np.unique(mark, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(inverse, 1 - yes, len(h)).astype(np.int64)),
                                              pa.array(np.bincount(inverse, yes, len(h)).astype(np.int64))], names=["mark", "n0", "n1"])


VOTERS = [f"part_{i}" for i in range(PARTS)] + ["hit_1", "hit_2", "hit_3", "hit_5", "kinds_2", "kinds_3", "dense_05", "dense_1", "dense_3",
                                               "strong", "shouting", "bangs", "repeats", "symbols", "digits"]
COUNTS = ["log_hits", "log_kinds", "density", "log_strong"]


def features(column: pa.Array, lexicon: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Voters (0 or 1), then counts, of each text."""
    n = len(column)
    out = np.zeros((n, len(VOTERS) + len(COUNTS)))
    column = column.cast(pa.large_string()).fill_null("")
    lower = pc.utf8_lower(column)
    for i, j, data, off in kernels.blocks(lower):
        doc, word, mark = _marks(data, off)
        words = np.bincount(doc, minlength=j - i)
        at = np.searchsorted(lexicon, mark)
        at[at == len(lexicon)] = 0
        hit = lexicon[at] == mark if len(lexicon) else np.zeros(len(mark), bool)
        word, at = word[hit], at[hit]
        hits = np.unique(word)
        n_hits = np.bincount(doc[hits], minlength=j - i)
        # a word may match by several beginnings: its longest mark names its kind
        kind = np.unique(np.stack([doc[word], at]), axis=1) if len(word) else np.zeros((2, 0), np.int64)
        part = np.zeros((j - i, PARTS), bool)
        part[kind[0], kind[1] % PARTS] = True
        sure = np.bincount(doc[np.unique(word[strong[at]])], minlength=j - i) if len(word) else np.zeros(j - i, np.int64)
        first = np.sort(np.unique(word, return_index=True)[1])
        kinds = np.unique(np.stack([doc[word[first]], at[first]]), axis=1)[0] if len(word) else np.zeros(0, np.int64)
        n_kinds = np.bincount(kinds, minlength=j - i)
        dense = n_hits / np.maximum(words, 1)
        f = out[i:j]
        f[:, :PARTS] = part
        for c, v in enumerate((n_hits >= 1, n_hits >= 2, n_hits >= 3, n_hits >= 5, n_kinds >= 2, n_kinds >= 3, dense >= 0.005, dense >= 0.01, dense >= 0.03, sure >= 1)):
            f[:, PARTS + c] = v
        c = len(VOTERS)
        f[:, c], f[:, c + 1], f[:, c + 2], f[:, c + 3] = np.log1p(n_hits), np.log1p(n_kinds), np.sqrt(dense), np.log1p(sure)
    for i, j, data, off in kernels.blocks(column):
        def share(mask):
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[off[1:]] - total[off[:-1]]) / np.maximum(np.diff(off), 1)
        upper, small = share((data >= 65) & (data < 91)), share((data >= 97) & (data < 123))
        same = np.append(False, data[1:] == data[:-1])
        c = PARTS + 10
        out[i:j, c:c + 5] = np.stack([upper > small, share((data == 33) & same) > 0.002, share(same & (data != 32)) > 0.06,
                                      share(np.isin(data, [35, 36, 37, 38, 42, 64])) > 0.02, share((data >= 48) & (data < 58)) > 0.05], axis=1)
    return out


def label_model(votes: np.ndarray, given: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior of toxic by row, from 0/1 ``votes`` (rows x voters) and the given label as the last voter."""
    v = np.column_stack([votes, given]).astype(float)
    p = np.where(given > 0, 0.9, 0.05)
    trust = np.ones(v.shape[1])
    for step in range(rounds):
        yes, no = p.sum(), (1 - p).sum()
        prior = (yes + 1) / (yes + no + 2)
        a = (p @ v + 1) / (yes + 2)
        b = ((1 - p) @ v + 1) / (no + 2)
        if step % 10 == 0:
            # what voters share beyond the class: correlations of the residuals
            r = v - np.outer(p, a) - np.outer(1 - p, b)
            sd = r.std(axis=0) + 1e-9
            shared = np.abs((r.T @ r) / len(r) / np.outer(sd, sd))
            np.fill_diagonal(shared, 0)
            trust = 1 / (1 + shared.sum(axis=1))
            trust[-1] = 1
        weight = v * np.log(a / b) + (1 - v) * np.log((1 - a) / (1 - b))
        z = np.log(prior / (1 - prior)) + weight @ trust
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return p


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps on soft labels."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), ridge * np.append(np.ones(x.shape[1] - 1), 1e-6)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(keep), x.T @ (p - q) - keep * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    lexicon: np.ndarray
    strong: np.ndarray
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Model | None:
    """Fits on at most ``sample`` rows that have a text and a toxic label; None if either class is missing.
    Of several labels of a doc_id the greatest counts."""
    given = pick(labels, doc_id="long", toxic="int").filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = pick(docs, doc_id="long", text="string").filter("text IS NOT NULL")
    # labels of rows that are not there must not use up the sample
    given = given.join(texts.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = texts.join(F.broadcast(given), "doc_id").select("text", "toxic")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    f1, f0 = (F.col("n1") + 0.5) / (n[1] + 1), (F.col("n0") + 0.5) / (n[0] + 1)
    # log-likelihood ratio of the mark's toxic share against the overall one
    held, share = F.col("n0") + F.col("n1"), n[1] / (n[0] + n[1])
    part = lambda c, q: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (held * q))).otherwise(0.0)
    g = 2 * (part("n1", share) + part("n0", 1 - share))
    marks = rows.mapInArrow(_count, "mark long, n0 long, n1 long").groupBy("mark").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    best = marks.filter((F.col("n1") >= 3) & (f1 > 8 * f0)).withColumn("g", g).filter(F.col("g") > LEAST_G).orderBy(F.desc("g"), "mark").limit(size).toArrow()
    lexicon = best["mark"].to_numpy().view(np.uint64)
    order = np.argsort(lexicon)
    strong = (best["n1"].to_numpy() >= 20 * np.maximum(best["n0"].to_numpy(), 0.05))[order]
    lexicon = lexicon[order]

    def gather(batches):
        for batch in batches:
            x = features(batch.column(0), lexicon, strong)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    got = rows.mapInArrow(gather, "x array<double>, toxic int").toArrow()
    x = np.array(got["x"].to_pylist())
    p = label_model(x[:, :len(VOTERS)], got["toxic"].to_numpy())
    return Model(lexicon, strong, logistic(x, p))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score, predicted`` of every row; only the text is looked at. Null counts as empty. Without a model
    the score is 0. Rows are scored one by one, so repeated rows get equal results and an empty table gives none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            s = np.zeros(n)
            if m is not None and n:
                s = 1 / (1 + np.exp(-np.clip(features(batch.column(1), m.lexicon, m.strong) @ m.weights[:-1] + m.weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pick(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, score double, predicted int")
