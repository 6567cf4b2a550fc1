"""Variable-capacity best-fit packing of documents into sequences of a few permitted lengths.

A document longer than the greatest length is cut into pieces; pieces of the greatest length are sequences of their
own, and the rest (at most one a document) is packed. Items are dealt by a hash into groups of about ``GROUP`` items,
so a group is bounded however large the corpus is, and each group is packed by itself:

best-fit decreasing puts an item into the open bin that it fills best; if none has room, the bin size of least cost
per token opens. This runs once for every permitted length as the largest size to open, each bin is then downsized to
the least permitted length that holds its contents, and the run of least total cost is taken.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import kernels
from casebook.llm.common import keyed, stored
from casebook.llm.encoder import encoder

LENGTHS = (256, 512, 1024, 2048, 4096, 8192)
GROUP = 20_000
_OUT = "doc_id long, piece int, start long, n_tokens long, bin_group long, bin_no long, bin_size int, bin_used int, bin_offset int"


def cost(length: int) -> float:
    """Of one sequence: its tokens, a small quadratic share (attention) and a fixed overhead."""
    return length * (1 + length / 65_536) + 64


def best_fit(sizes: list[int], lengths: tuple[int, ...], top: int) -> tuple[list[int], list[int]]:
    """(bin of each item, contents of each bin) for items in decreasing order; bins up to ``top`` open where they
    hold the item. Ties: the bin that got this room last."""
    mask, room, bins, used, caps = 0, {}, [], [], []
    for size in sizes:
        fit = mask >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                mask &= ~(1 << left)
        else:
            allowed = [x for x in lengths if size <= x <= top] or [min(x for x in lengths if x >= size)]
            caps.append(min(allowed, key=lambda x: (cost(x) / x, x)))
            used.append(0)
            b = len(caps) - 1
        used[b] += size
        bins.append(b)
        left = caps[b] - used[b]
        room.setdefault(left, []).append(b)
        mask |= 1 << left
        if left == 0:
            mask &= ~1
    return bins, used


def pack(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each item, contents and final length of each bin) of the cheapest run over all largest sizes."""
    best = None
    for top in lengths:
        bins, used = best_fit(sizes, lengths, top)
        final = [lengths[i] for i in np.searchsorted(lengths, used)] if used else []
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, bins, used, final
    return best[1:]


def _group(lengths: tuple[int, ...]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n_tokens", "_row"], ascending=[False, True], kind="stable")
        bins, used, final = pack(rows.n_tokens.tolist(), lengths)
        bins = np.array(bins, np.int64)
        at = rows.n_tokens.groupby(bins).cumsum() - rows.n_tokens
        return pd.DataFrame({"doc_id": rows.doc_id, "piece": rows.piece, "start": rows.start, "n_tokens": rows.n_tokens, "bin_group": rows.bin_group,
                             "bin_no": bins, "bin_size": np.array(final)[bins], "bin_used": np.array(used)[bins], "bin_offset": at})
    return run


def _id_counts(path: str):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for i, j, data, off in kernels.blocks(batch.column(2)):
                if coder.plain:
                    n = np.diff(coder.encode(data, off)[1], prepend=0)
                else:
                    n = np.array([len(x) for x in coder.whole([data[off[d]:off[d + 1]].tobytes().decode() for d in range(j - i)])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64) + 1)],
                                                 names=["_row", "doc_id", "size"])
    return run


def best_fit_packing(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, group: int = GROUP, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, n_tokens, bin_group, bin_no, bin_size, bin_used, bin_offset``.

    Tokens are the ids that the tokenizer file ``vocabulary`` gives (without one the words ``[^\\x20\\x09-\\x0D]+``) plus
    one end mark a document, so null and empty texts are one token. Ids are counted once, in one scan of the texts; the
    counts are stored.
    ``start`` is the piece's first token in the document, ``bin_offset`` its place in the sequence
    (``bin_group``, ``bin_no``) of ``bin_size`` positions, ``bin_used`` of them used. Every token of every row is in
    just one sequence; no sequence is larger than the least permitted length that holds it. Repeated rows and null
    ids are rows of their own. An empty table gives no rows.
    """
    lengths, rows = tuple(sorted(lengths)), keyed(docs, text="string")
    most = lengths[-1]
    if vocabulary:
        sized = stored(rows.select("_row", "doc_id", "text").mapInArrow(_id_counts(vocabulary), "_row long, doc_id long, size long"), "sizes")
    else:
        sized = rows.select("_row", "doc_id", (F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long").alias("size"))
    groups = max(1, -(-sized.count() // group))
    full = sized.filter(F.col("size") >= most).select("_row", "doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"size div {most}") - 1)).alias("piece"))
    full = full.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * most).alias("start"), F.lit(most).cast("long").alias("n_tokens"),
                       (-1 - F.col("_row")).alias("bin_group"), F.col("piece").alias("bin_no"), F.lit(most).alias("bin_size"), F.lit(most).alias("bin_used"), F.lit(0).alias("bin_offset"))
    rest = sized.filter(F.col("size") % most > 0).select(
        "_row", "doc_id", F.expr(f"CAST(size div {most} AS INT)").alias("piece"), (F.col("size") - F.col("size") % most).alias("start"),
        (F.col("size") % most).alias("n_tokens"), F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("bin_group"))
    return rest.groupBy("bin_group").applyInPandas(_group(lengths), _OUT).unionAll(full)
