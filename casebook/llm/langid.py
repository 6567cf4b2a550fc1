"""Language ID with interpolated Kneser-Ney character models in sorted hash arrays.

One model per language value. Texts are lower-cased, every run of non-letters is one space, and each character is
scored from the three before it. The n-grams of all languages lie in one sorted array of 64-bit hashes per order,
with a row of log-probabilities (a column per language) beside each, so one binary search serves all languages.

Training reads whole texts of a hash sample of about ``per_lang`` labelled documents per language value (the bound
of the classifier's data, a parameter); the counting runs in Spark, and the driver gets the n-gram counts only. A
tenth of the sample is held back to calibrate the score (temperature) and the rejection (cross-entropy by language).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casebook.llm import kernels
from casebook.llm.common import pick

ORDER, PER_LANG, MOST_LANGS, FEW = 4, 1000, 1000, 20
_MOST = (1 << 63) - 1
_B = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> lower-case code point of letters, 0 of all others."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low[0])
    return table


def letter_runs(column: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Codes (0 for a gap) of the concatenated texts and offsets. Each text starts with ``order`` - 1 gaps, so no
    n-gram reaches into the text before it, and ends with a gap."""
    lead = "\0" * (order - 1)
    texts = [lead + (t or "") + "\0" for t in column.to_pylist()]
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _letters()[np.minimum(points, 0x10FFFF)]
    limits = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0      # the first gap after a letter stays
    for i in range(order - 1):
        keep[limits[:-1] + i] = True
    keep[limits[1:] - 1] = True
    return codes[keep], np.concatenate([[0], np.cumsum(keep)[limits[1:] - 1]])


def gram_hashes(codes: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each position; gaps stand before the block."""
    padded = np.concatenate([np.zeros(order - 1, np.uint64), codes.astype(np.uint64)]) + np.uint64(1)
    n, out, h = len(codes), [], None
    for k in range(1, order + 1):
        part = padded[order - k:order - k + n]
        h = kernels.mix(part) if h is None else kernels.mix(h * _B + part * np.uint64(k))
        out.append(h)
    return out


def _scored(codes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions whose character counts: letters, and the gap that ends a word."""
    some = codes != 0
    some[1:] |= codes[:-1] != 0
    return some


def _count(order: int):
    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            held = np.array(batch.column(2).to_pylist(), bool)
            for lang in sorted(set(langs[~held])):
                codes, off = letter_runs(batch.column(1).filter(pa.array((langs == lang) & ~held)), order)
                some = np.flatnonzero(_scored(codes, off))
                grams = gram_hashes(codes, order)
                for k in range(1, order + 1):
                    h, at, n = np.unique(grams[k - 1][some], return_index=True, return_counts=True)
                    at = some[at]
                    before = np.maximum(at - 1, 0)
                    shorter = grams[k - 2][at] if k > 1 else np.zeros(len(at), np.uint64)
                    context = grams[k - 2][before] if k > 1 else np.zeros(len(at), np.uint64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(h), pa.string()), pa.array([k] * len(h), pa.int32()),
                        pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(shorter.view(np.int64)),
                        pa.array(n, pa.int64())], names=["lang", "k", "gram", "context", "shorter", "n"])
    return run


@dataclass
class Model:
    """Per order k: sorted gram hashes and their log-probabilities by language; sorted context hashes of length k
    and their log back-off weights by language. ``floor``: log-probability of an unseen character."""
    langs: list[str]
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    back: list[np.ndarray]
    floor: float
    heat: float = 1.0
    worst: np.ndarray | None = None

    def _find(self, table: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(table, h)
        at[at == len(table)] = 0
        return at, (table[at] == h if len(table) else np.zeros(len(h), bool))

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of every position by language: the longest gram known, plus the back-off weights of
        the longer contexts."""
        order = len(self.grams)
        hashes = gram_hashes(codes, order)
        out = np.full((len(codes), len(self.langs)), self.floor, np.float32)
        left, weight = np.arange(len(codes)), np.zeros((len(codes), len(self.langs)), np.float32)
        for k in range(order, 0, -1):
            at, hit = self._find(self.grams[k - 1], hashes[k - 1][left])
            out[left[hit]] = self.logp[k - 1][at[hit]] + weight[hit]
            left, weight = left[~hit], weight[~hit]
            if len(left) == 0:
                return out
            if k > 1:
                context = np.where(left > 0, hashes[k - 2][left - 1], hashes[k - 2][0])
                at, hit = self._find(self.contexts[k - 2], context)
                weight = weight + np.where(hit[:, None], self.back[k - 2][at] if len(self.back[k - 2]) else 0, 0)
        out[left] = self.floor + weight
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy in nats per scored character by text and language, letters by text)."""
        n = len(column)
        ce, letters = np.zeros((n, len(self.langs))), np.zeros(n, np.int64)
        size, i = kernels.utf8(column)[1], 0
        while i < n:  # blocks of whole texts
            j = max(i + 1, int(np.searchsorted(size, size[i] + kernels.BLOCK, "right")) - 1)
            codes, off = letter_runs(column.slice(i, j - i), len(self.grams))
            some = _scored(codes, off)
            if len(codes):
                p = self.positions(codes)
                p[~some] = 0
                total = np.add.reduceat(p, off[:-1], axis=0, dtype=np.float64)
                count = np.add.reduceat(some.astype(np.int64), off[:-1])
                letters[i:j] = np.add.reduceat((codes != 0).astype(np.int64), off[:-1])
                ce[i:j] = -total / np.maximum(count, 1)[:, None]
            i = j
        return ce, letters

    def posterior(self, ce: np.ndarray) -> np.ndarray:
        z = -self.heat * (ce - ce.min(axis=1, keepdims=True))
        e = np.exp(z)
        return e / e.sum(axis=1, keepdims=True)


def _kneser_ney(table: pa.Table, langs: list[str], order: int) -> Model:
    """Interpolated Kneser-Ney: raw counts at the top order, continuation counts below, one discount per order."""
    lang, k = np.array([langs.index(x) for x in table["lang"].to_pylist()]), table["k"].to_numpy()
    cols = {c: table[c].to_numpy().view(np.uint64) for c in ("gram", "context", "shorter")}
    n, size = table["n"].to_numpy(), len(langs)
    letters = len(np.unique(cols["gram"][k == 1]))
    floor = -float(np.log(letters + 1.0))
    grams, logp, contexts, back = [], [], [], []
    for q in range(1, order + 1):
        here = k == q
        gram, first = np.unique(cols["gram"][here], return_index=True)
        shorter, context = cols["shorter"][here][first], cols["context"][here][first]
        count = np.zeros((len(gram), size))
        if q == order:
            np.add.at(count, (np.searchsorted(gram, cols["gram"][here]), lang[here]), n[here])
        else:  # distinct characters seen before the gram
            longer = k == q + 1
            at = np.searchsorted(gram, cols["shorter"][longer])
            np.add.at(count, (at, lang[longer]), 1)
        n1, n2 = (count == 1).sum(axis=0), (count == 2).sum(axis=0)
        d = np.where(n1 > 0, n1 / np.maximum(n1 + 2 * n2, 1), 0.5).clip(0.05, 0.95)
        ctx, inv = np.unique(context, return_inverse=True)
        total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
        np.add.at(total, inv, count)
        np.add.at(kinds, inv, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            lam = np.where(total > 0, d * kinds / total, 1.0)
            own = np.where(total[inv] > 0, np.maximum(count - d, 0) / total[inv], 0.0)
        if q == 1:
            low = np.full((len(gram), size), np.exp(floor))
        else:
            low = np.exp(logp[-1][np.searchsorted(grams[-1], shorter)])
        grams.append(gram)
        logp.append(np.log(own + lam[inv] * low).astype(np.float32))
        contexts.append(ctx)
        back.append(np.log(lam).astype(np.float32))
    return Model(langs, grams, logp, contexts[1:], back[1:], floor + float(back[0].mean()))


def train(docs: DataFrame, per_lang: int = PER_LANG, order: int = ORDER) -> Model | None:
    """Models from rows with text and lang; None without any. ``per_lang`` bounds the sample per language value, drawn
    by a hash of id and text. More than ``MOST_LANGS`` language values raise: a column like that holds no languages."""
    rows = pick(docs, doc_id="long", text="string", lang="string").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} values of lang")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, _MOST if n <= per_lang else _MOST * per_lang // n)])
    draw = F.xxhash64("doc_id", "text").bitwiseAND(F.lit(_MOST))
    sample = rows.filter(draw <= F.element_at(share, F.col("lang")))
    sample = sample.select("lang", "text", (F.pmod(F.xxhash64("doc_id", "text", F.lit(1)), F.lit(10)) == 0).alias("held"))

    def counts(of: DataFrame) -> pa.Table:
        return of.mapInArrow(_count(order), "lang string, k int, gram long, context long, shorter long, n long") \
            .groupBy("lang", "k", "gram", "context", "shorter").agg(F.sum("n").alias("n")).toArrow()

    counted = counts(sample)
    if counted.num_rows == 0:       # so few rows that all are held back: they do both
        counted = counts(sample.withColumn("held", F.lit(False)))
    if counted.num_rows == 0:
        return None
    model = _kneser_ney(counted, sorted(set(counted["lang"].to_pylist())), order)
    return _calibrate(model, sample.filter("held").select("lang", "text"))


def _calibrate(model: Model, held: DataFrame) -> Model:
    """Temperature by least log-loss; rejection bound of a language one nat above the 99 % quantile of the held-back
    cross-entropies of its documents (of all documents, where it has under ``FEW``). With fewer documents than that
    held back in all, only a text that is scored worse than by even chances is rejected."""
    names = list(model.langs)

    def run(batches):
        for batch in batches:
            ce, letters = model.entropies(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(ce), pa.list_(pa.float64())), pa.array(letters)],
                                             names=["lang", "ce", "letters"])

    got = held.mapInArrow(run, "lang string, ce array<double>, letters long").filter("letters > 0").toArrow().to_pylist()
    got = [r for r in got if r["lang"] in names]
    model.worst = np.full(len(names), -model.floor)
    if got:
        ce = np.array([r["ce"] for r in got])
        truth = np.array([names.index(r["lang"]) for r in got])
        best = ce.min(axis=1)
        if len(best) >= FEW:
            model.worst = np.array([np.quantile(best[truth == i] if (truth == i).sum() >= FEW else best, 0.99) + 1.0 for i in range(len(names))])

        def loss(heat: float) -> float:
            model.heat = heat
            return -np.log(np.maximum(model.posterior(ce)[np.arange(len(ce)), truth], 1e-9)).mean()

        model.heat = min(2.0 ** np.arange(0, 8, 0.5), key=loss)
    return model


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The columns of ``docs`` plus ``lang_pred, score, entropy, rejected``, in place of columns of these names. Only
    the text is looked at.

    ``lang_pred``: the language of least cross-entropy (ties: first in order), ``und`` where the text is null or has
    no letter, or where there is no model; then the score is 0 and the row is rejected. ``score``: calibrated
    posterior in 0..1. ``rejected``: ``und``, or a cross-entropy above the bound found in calibration.
    No n-gram reaches from one text into another, so a text gets the same result beside any others, repeated rows
    included. An empty table gives none.
    """
    spark = docs.sparkSession
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own = [i for i, n in enumerate(docs.columns) if n not in ("lang_pred", "score", "entropy", "rejected")]
    names, plain = [docs.columns[i] for i in own], plain.select(*[f"c{i}" for i in own])
    at = names.index("text")
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            column = batch.column(at).cast(pa.large_string())
            n = batch.num_rows
            if m is None:
                add = [["und"] * n, [0.0] * n, [None] * n, [True] * n]
            else:
                ce, letters = m.entropies(column)
                best = ce.argmin(axis=1)
                p = m.posterior(ce)[np.arange(n), best] if n else np.zeros(0)
                none = letters == 0
                low = ce[np.arange(n), best] if n else np.zeros(0)
                add = [["und" if z else m.langs[b] for z, b in zip(none, best, strict=True)],
                       np.where(none, 0.0, p).tolist(), [None if z else float(x) for z, x in zip(none, low, strict=True)],
                       (none | (low > m.worst[best] if n else none)).tolist()]
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(a, t) for a, t in zip(add, types, strict=True)]],
                                             names=[*batch.schema.names, "lang_pred", "score", "entropy", "rejected"])

    schema = StructType(list(plain.schema.fields))
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("entropy", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    return plain.mapInArrow(run, schema).toDF(*names, "lang_pred", "score", "entropy", "rejected")
