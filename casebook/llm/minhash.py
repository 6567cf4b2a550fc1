"""MinHash near-duplicate groups: universal hash minima, banding, verification on full sets, star components.

Rows with equal shingle sets (by a 128-bit digest) are one class, so copies never meet in pairs. Every class goes
to ``BANDS`` buckets of ``ROWS`` minima each (a pair at similarity 0.8 misses all with probability 5e-6). The pairs
that are verified, on the full sets built from the whole texts, come in two rounds:

1. in each bucket every class with the bucket's least class. Links found here join most of a large group;
2. in each bucket that still holds several components, the classes outside its most common component with all
   classes of another component there, as long as at most ``OUTSIDE`` classes are outside (at most that many
   comparisons a class and bucket);
3. the classes of all other such buckets, many texts from one template for instance, in a prefix join instead: every
   set is ordered from rare to frequent shingles, counted in ``SLOTS`` slots over these classes, and two sets meet
   only at a shingle that stands so early in both that what follows can still make up the similarity. A pair at the
   similarity always has one, so the join finds every link among these classes, whether in one bucket or not. Texts
   that share a template and differ in the rest have their common shingles late and do not meet.

No link that a bucket offers is left out: what round 2 skips lies within one component already. Three tests drop
pairs before their texts are fetched: the set sizes; one bit per minimum (1-bit minwise hashing), where a true pair
agrees in 216 of 240 bits on average and is dropped below 186 (6 standard deviations); and 1,024 parity bits of the
set's hashes, whose distance never exceeds the symmetric difference of the sets, so that test loses nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import kernels
from casebook.llm.common import keyed, stored
from casebook.llm.components import components

BANDS, ROWS, LEAST_BITS = 40, 6, 186
PARITY = 1024
OUTSIDE = 32        # classes outside a bucket's most common component up to which that bucket is compared directly
SLOTS = 1 << 20     # slots of the shingle counts: one byte each goes to every task
_SKETCH = ["n", *[f"s{i}" for i in range(4)], *[f"p{i}" for i in range(PARITY // 64)]]
_SIG = "_row long, doc_id long, digest binary, " + "".join(f"{c} long, " for c in _SKETCH) + "bands array<long>"


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least value of each hash ``a*x + b mod 2^32`` over the set."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (a[:, None] * x[None, i:i + 1024] + b[:, None]).min(axis=1), out=least)
    return least


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        rng = np.random.default_rng(20240607)
        a = (rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        b = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
        for batch in batches:
            for i, j, data, off in kernels.blocks(batch.column(2)):
                sets = kernels.shingle_sets(data, off, k)
                some = [s for s in sets if len(s)]
                m = np.stack([_minima((s >> np.uint64(32)).astype(np.uint32), a, b) for s in some]) if some else np.zeros((0, bands * rows), np.uint32)
                keys = np.zeros((len(m), bands), np.uint64)
                for r in range(rows):
                    keys = kernels.mix(keys ^ (m[:, r::rows].astype(np.uint64) + np.uint64(r + 1)))
                bits = (m * np.uint32(0x9E3779B1) >> np.uint32(31)).astype(np.uint8)
                sketch = np.zeros((len(m), 32), np.uint8)
                packed = np.packbits(bits, axis=1)[:, :32]
                sketch[:, :packed.shape[1]] = packed
                sketch = sketch.view(np.int64)
                full = np.array([len(x) > 0 for x in sets], bool)
                at = np.cumsum(full) - 1
                every = np.zeros((j - i, 4), np.int64)
                every[full] = sketch
                parity = np.zeros((j - i, PARITY // 8), np.uint8)
                for d, x in enumerate(sets):
                    parity[d] = np.packbits((np.bincount((x & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1).astype(np.uint8))
                parity = parity.view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i),
                    pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    *[pa.array(np.ascontiguousarray(x)) for x in (*every.T, *parity.T)],
                    pa.array([keys[at[d]].view(np.int64) if full[d] else None for d in range(j - i)], pa.list_(pa.int64())),
                ], names=["_row", "doc_id", "digest", *_SKETCH, "bands"])
    return run


def _slots(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(20)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _slot_counts(k: int):
    """Sets per slot: one row a task and slot."""
    def run(batches):
        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, data, off in kernels.blocks(batch.column(0)):
                for x in kernels.shingle_sets(data, off, k):
                    np.add.at(counts, _slots(x), 1)
        some = np.flatnonzero(counts)
        for i in range(0, len(some), 1 << 16):
            at = some[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["slot", "n"])
    return run


def _prefixes(k: int, percent: int, level: np.ndarray):
    """The shingles of each set up to the last place where a similar set may meet it, from rare to frequent."""
    def run(batches):
        for batch in batches:
            for i, j, data, off in kernels.blocks(batch.column(2)):
                sets = kernels.shingle_sets(data, off, k)
                most = np.array([len(x) - -(-percent * len(x) // 100) + 1 if len(x) else 0 for x in sets], np.int64)
                first = [x[np.lexsort((x, level[_slots(x)]))[:m]] for x, m in zip(sets, most)]
                doc = np.repeat(np.arange(i, j), most)
                rows = batch.select([0, 1]).take(pa.array(doc))
                at = np.concatenate([np.arange(m) for m in most])
                yield pa.RecordBatch.from_arrays([
                    *rows.columns, pa.array(np.repeat([len(x) for x in sets], most).astype(np.int64)),
                    pa.array(np.concatenate(first).view(np.int64)), pa.array(at.astype(np.int64))], names=["_row", "comp", "n", "h", "at"])
    return run


def prefix_pairs(rows: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` (a < b), without repeats: rows of ``_row, comp, text`` of different ``comp`` whose sets meet within
    their prefixes, among them every pair of similar sets. ``SLOTS`` counts at most go through the driver; their
    order only decides how few pairs there are."""
    slots = rows.select("text").mapInArrow(_slot_counts(k), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(SLOTS, np.uint8)
    level[slots.column("slot").to_numpy()] = np.minimum(255, 4 * np.log2(1.0 + slots.column("n").to_numpy()))
    every = rows.select("_row", F.col("comp").cast("long"), "text").mapInArrow(
        _prefixes(k, percent, level), "_row long, comp long, n long, h long, at long")
    side = lambda s: every.select("h", F.col("_row").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("comp", "n", "at")])
    part, na, nb = 100 + percent, F.col("a_n"), F.col("b_n")
    left = {s: part * (F.col(f"{s}_n") - F.col(f"{s}_at")) for s in "ab"}     # most of the overlap from that place on
    near = side("a").join(side("b").filter(left["b"] >= 2 * percent * nb), "h").filter(
        (F.col("a_comp") != F.col("b_comp")) & ((nb < na) | ((nb == na) & (F.col("b") < F.col("a"))))
        & (left["a"] >= percent * (na + nb)) & (left["b"] >= percent * (na + nb)))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _confirm(k: int, percent: int):
    """Of rows (a, b, ta, tb) the pairs whose full shingle sets are similar enough."""
    def run(batches):
        for batch in batches:
            keep, last, held = [], None, None
            for i in range(batch.num_rows):
                b = batch.column(1)[i].as_py()
                if b != last:
                    last, held = b, kernels.shingle_sets(*kernels.utf8(batch.column(3).slice(i, 1)), k)[0]
                own = kernels.shingle_sets(*kernels.utf8(batch.column(2).slice(i, 1)), k)[0]
                both = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(held) - both))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns, names=["u", "v"])
    return run


def _sided(frame: DataFrame, s: str, *more: str) -> DataFrame:
    """``_row`` as ``s`` and the sketch columns with that prefix."""
    return frame.select(F.col("_row").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in _SKETCH], *more)


def _plausible(percent: int, least_bits: int):
    """False only where a and b cannot be linked."""
    def apart(names):
        return sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in names), F.lit(0))
    na, nb = F.col("a_n"), F.col("b_n")
    return ((100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (apart(_SKETCH[1:5]) <= BANDS * ROWS - least_bits)
            & ((100 + percent) * apart(_SKETCH[5:]) <= (100 - percent) * (na + nb)))


def _links(near: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The true links among the pairs (a, b)."""
    near = stored(near.distinct(), "near-pairs")
    text = lambda s: texts.select(F.col("_row").alias(s), F.col("text").alias(f"t{s}"))
    return stored(near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "ta", "tb")
                  .mapInArrow(_confirm(k, percent), "u long, v long"), "near-links")


def near_dedup(docs: DataFrame, words: int = 5, percent: int = 80, least_bits: int = LEAST_BITS) -> DataFrame:
    """One row per input row: ``_row, doc_id, n_shingles, component_id, kept``.

    Links join rows with ``100 * |A & B| >= percent * |A | B|`` over distinct ``words``-word shingles of the text,
    lower-cased in A-Z and split at ``[\\x20\\x09-\\x0D]``; with fewer words the whole sequence is the one shingle.
    Rows without words (also null) link with nothing and stay. ``component_id`` is the least doc_id of the rows that
    links reach (null only if all of these are null); one row of a component is kept, the least by (doc_id, null
    last, then row key). Repeated rows are rows of one component. An empty table gives no rows.
    """
    return decide(keyed(docs, text="string"), words, percent, least_bits)


def decide(rows: DataFrame, words: int = 5, percent: int = 80, least_bits: int = LEAST_BITS) -> DataFrame:
    """``near_dedup`` of keyed rows."""
    sig = stored(rows.select("_row", "doc_id", "text").mapInArrow(_signatures(words, BANDS, ROWS), _SIG), "signatures")
    some = sig.filter("n > 0")
    classes = some.groupBy("n", "digest").agg(F.min("_row").alias("rep"))
    member = stored(some.select("_row", "n", "digest").join(classes, ["n", "digest"]).select("_row", "rep"), "classes")
    reps = sig.join(member.filter("_row = rep").select("_row"), "_row", "left_semi")
    sketch = reps.select("_row", *_SKETCH)
    banded = reps.select("_row", F.posexplode("bands").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("_row").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    shared = stored(banded.join(buckets, ["band", "key"]).select("band", "key", "_row", "lead"), "buckets")

    stars = shared.filter("_row != lead").select(F.col("_row").alias("a"), F.col("lead").alias("b")).distinct()
    stars = stars.join(_sided(sketch, "a"), "a").join(_sided(sketch, "b"), "b").filter(_plausible(percent, least_bits))
    first = _links(stars.select("a", "b"), rows, words, percent)
    joined = components(first)
    placed = shared.join(joined.withColumnRenamed("u", "_row"), "_row", "left").select(
        "band", "key", "_row", F.coalesce("v", "_row").alias("comp"))
    parts = placed.groupBy("band", "key", "comp").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("band", "key").agg(F.count("*").alias("parts"), F.sum("size").alias("total"), F.max(F.struct("size", "comp")).alias("top")) \
        .filter("parts > 1").select("band", "key", F.col("top.comp").alias("top"), (F.col("total") - F.col("top.size")).alias("outside"))
    mixed = placed.join(stored(mixed, "mixed"), ["band", "key"])
    crowd = stored(mixed.filter(F.col("outside") > OUTSIDE).select("_row", "comp").distinct(), "crowded")
    there = stored(mixed.filter(F.col("outside") <= OUTSIDE).join(sketch, "_row"), "mixed-buckets")
    left = _sided(there.filter("comp != top"), "a", "band", "key", F.col("comp").alias("a_comp"))
    right = _sided(there, "b", "band", "key", "top", F.col("comp").alias("b_comp"))
    across = left.join(right, ["band", "key"]).filter(
        (F.col("a_comp") != F.col("b_comp")) & ((F.col("b_comp") == F.col("top")) | (F.col("a") < F.col("b")))
        & _plausible(percent, least_bits))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if not crowd.isEmpty():
        met = prefix_pairs(crowd.join(rows.select("_row", "text"), "_row"), words, percent)
        across = across.unionAll(met.join(_sided(sketch, "a"), "a").join(_sided(sketch, "b"), "b")
                                 .filter(_plausible(percent, least_bits)).select("a", "b"))
    second = _links(across, rows, words, percent)
    if not second.isEmpty():
        joined = components(joined.unionAll(second))

    comp = member.join(joined.select(F.col("u").alias("rep"), "v"), "rep", "left").select(
        "_row", F.coalesce("v", "rep").alias("comp"))
    every = sig.select("_row", "doc_id", "n").join(comp, "_row", "left").withColumn("comp", F.coalesce("comp", "_row"))
    every = stored(every, "near-components")
    heads = every.groupBy("comp").agg(F.count("*").alias("size"), F.min(
        F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row")).alias("head")).filter("size > 1")
    return every.join(heads, "comp", "left").select(
        "_row", "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce(F.col("head._row") == F.col("_row"), F.lit(True)).alias("kept"))
