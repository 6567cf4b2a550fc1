"""Cross-tokenizer alignment on distinct texts.

Texts are shuffled whole and grouped, so each distinct text is tokenised and aligned once, by a byte-level BPE (A) and
a sentencepiece BPE (B), whatever the number of its copies. Both token lists tile the bytes of a space and the text.
The ends of both, merged, cut them into the least pieces that lie in one token of A and one of B: each such piece is
a link. Ends that both share cut the tokens into groups.

How many links hold an id pair is summed over the distinct texts, weighted by copies. The counts go back to the texts
in two ways that together are whole: a table of the most frequent pairs, of bounded size, is broadcast; links of any
other pair are joined with the stored counts. The measures then join the doc_ids by length and SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm import kernels
from casebook.llm.common import pick, stored
from casebook.llm.encoder import Encoder, Table, default_vocabulary, merged, ragged

SPANS, PAIRS, HEAD = 500_000, 1_000_000, 1_000_000      # entries: spans a worker keeps, pairs a task holds, pairs broadcast
_MEASURES = "n_a long, n_b long, n_groups long, n_links long"


def default_pieces() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(Encoder):
    """A sentencepiece BPE that encodes the span from a run of spaces to the next one once and looks it up again.

    No piece has a space after another character, so no merge reaches over the limit of such spans; with a model
    whose pieces do, or that rewrites text, whole texts are encoded (``plain`` is false).
    """

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto
        self.sp = SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        spec.ParseFromString(self.sp.serialized_model_proto())
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        form = spec.normalizer_spec
        self.plain = (not any("▁" in p.lstrip("▁") for p in pieces) and spec.trainer_spec.model_type == 2 and not form.precompiled_charsmap
                      and not form.remove_extra_whitespaces and form.add_dummy_prefix and not any(p.type == 4 for p in spec.pieces))
        parts = [bytes([int(p[3:-1], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.words = Table(SPANS)
        self.text, self.text_at, self.text_size = self._pool(parts)
        self.digits, self.digits_at, self.digits_size = self._pool([f"{i},".encode() for i in range(len(parts))])

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of texts that start with the space that the model adds by itself."""
        return self.sp.encode([t[1:] for t in texts], num_threads=1)

    def sure(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        mask = np.zeros(len(data), bool)
        mask[1:] = (data[1:] == 0x20) & (data[:-1] != 0x20)
        mask[off[:-1]] = False
        return np.flatnonzero(mask)

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        got = self.whole([data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)])
        self.words.add(h, np.array([len(g) for g in got], np.int64), np.array([i for g in got for i in g], np.int64))


@lru_cache(2)
def coders(a: str, b: str) -> tuple[Encoder, Pieces]:
    """Both tokenizers of a Python worker, apart from those that other operators keep."""
    first = Encoder(a)
    if not first.plain:
        raise ValueError(f"{a}: not a byte-level BPE without further rules")
    first.tok.encode_special_tokens = True
    first.words = Table(SPANS)
    return first, Pieces(b)


def _spaced(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The block with a space before every document."""
    out = np.empty(len(data) + len(off) - 1, np.uint8)
    out[ragged(off[:-1] + np.arange(1, len(off)), np.diff(off))] = data
    limits = off + np.arange(len(off))
    out[limits[:-1]] = 0x20
    return out, limits


def _tokens(coder: Encoder, data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of each document, and whether their bytes, joined, are the document."""
    if coder.plain:
        ids, ends = coder.encode(data, off)
    else:
        every = coder.whole([data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)])
        ids, ends = np.array([i for x in every for i in x], np.int64), np.cumsum([len(x) for x in every])
    out, raw, good = np.split(ids, ends[:-1]), data.tobytes(), np.ones(len(ends), bool)
    if coder.decoded(ids).tobytes() != raw:
        for d, x in enumerate(out):
            own = raw[off[d]:off[d + 1]]
            if coder.decoded(x).tobytes() != own:
                out[d] = np.array(coder.whole([own.decode()])[0], np.int64)
                good[d] = coder.decoded(out[d].astype(np.int64)).tobytes() == own
    return out, good


def ends(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets where tokens of A, of B and of either end."""
    ea, eb = np.cumsum(size_a[a]), np.cumsum(size_b[b])
    return ea, eb, merged(ea, eb) if len(ea) else ea


def group_text(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, common: np.ndarray, coder_a: Encoder, coder_b: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;...`` with a mark after every id, and where the part of each group ends."""
    ga, gb = np.searchsorted(common, ea, "left"), np.searchsorted(common, eb, "left")
    upto_a, upto_b = np.searchsorted(ga, np.arange(len(common)), "right"), np.searchsorted(gb, np.arange(len(common)), "right")
    place_a = np.arange(len(a)) + np.append(0, upto_b)[ga]
    place_b = np.arange(len(b)) + upto_a[gb]
    size = np.empty(len(a) + len(b), np.int64)
    size[place_a], size[place_b] = coder_a.digits_size[a], coder_b.digits_size[b]
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, np.uint8)
    for ids, place, coder in ((a, place_a, coder_a), (b, place_b, coder_b)):
        out[ragged(stop[place] - size[place], size[place])] = coder.digits[ragged(coder.digits_at[ids], size[place])]
    out[stop[place_a[upto_a - 1]] - 1] = ord("|")
    out[stop[place_b[upto_b - 1]] - 1] = ord(";")
    return out, stop[place_b[upto_b - 1]]


def _align(path_a: str, path_b: str):
    def run(batches):
        first, second = coders(path_a, path_b)
        kind = np.uint16 if max(len(first.text_size), len(second.text_size)) <= 1 << 16 else np.uint32
        for batch in batches:
            for i, j, data, off in kernels.blocks(batch.column(2)):
                data, off = _spaced(data, off)
                a, good = _tokens(first, data, off)
                b, also = _tokens(second, data, off)
                good &= also
                rows = np.flatnonzero(good)
                if len(rows) == 0:
                    continue
                n_a, n_b = np.array([len(a[d]) for d in rows]), np.array([len(b[d]) for d in rows])
                all_a, all_b = np.concatenate([a[d] for d in rows]).astype(np.int64), np.concatenate([b[d] for d in rows]).astype(np.int64)
                ea, eb, either = ends(all_a, all_b, first.text_size, second.text_size)
                common = np.intersect1d(ea, eb, assume_unique=True)
                stop = np.cumsum(np.diff(off)[rows])
                groups, links = np.searchsorted(common, stop, "right"), np.searchsorted(either, stop, "right")
                text, text_ends = group_text(all_a, all_b, ea, eb, common, first, second)
                cuts = np.append(0, text_ends[groups - 1]).tolist()
                text = text.tobytes()
                digest = [hashlib.sha256(text[x:y - 1]).hexdigest() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                at = pa.array(rows + i)
                ids = lambda x: pa.array([x[d].astype(kind).tobytes() for d in rows], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), ids(a), ids(b), pa.array(n_a), pa.array(n_b),
                                                  pa.array(np.diff(groups, prepend=0)), pa.array(np.diff(links, prepend=0)), pa.array(digest)],
                                                 names=["key", "copies", "a", "b", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    return run


def _ids(column: pa.Array, path_sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    kind = np.uint16 if max(map(len, path_sizes)) <= 1 << 16 else np.uint32
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0]:off[-1]].copy().view(kind).astype(np.int64)


def _links(batches, sizes, rows: int = 512):
    """Per run of rows: the slice of the batch, the pair key of every link and the row it belongs to."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            part = batch.slice(i, rows)
            a, b = (_ids(part.column(c).cast(pa.binary()), sizes) for c in (1, 2))
            ea, eb, either = ends(a, b, *sizes)
            key = a[np.searchsorted(ea, either, "left")] * len(sizes[1]) + b[np.searchsorted(eb, either, "left")]
            n = part.column(3).to_numpy()
            yield part, key, np.repeat(np.arange(len(n)), n)


def _sizes(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    first, second = coders(path_a, path_b)
    return first.text_size, second.text_size


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return every, total


def _pairs(path_a: str, path_b: str, room: int):
    """(pair, links) of a task's texts, each counted once a copy; given out whenever more than ``room`` are held."""
    def run(batches):
        keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        give = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k), pa.array(c)], names=["pair", "links"])
        for part, key, row in _links(batches, _sizes(path_a, path_b)):
            own, at, n = np.unique(key, return_inverse=True, return_counts=True)
            copies = part.column(0).to_numpy()
            if (copies != 1).any():
                n = np.zeros(len(own), np.int64)
                np.add.at(n, at, copies[row])
            keys.append(own)
            counts.append(n)
            held += len(own)
            if held > 2 * room:
                k, c = _summed(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > room:
                    yield give(k, c)
                    keys, counts, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        k, c = _summed(keys, counts)
        if len(k):
            yield give(k, c)
    return run


def _measures(path_a: str, path_b: str, head):
    """Sums over the links of the broadcast pairs; the other pairs of a text, with their links, as two lists."""
    def run(batches):
        known, links, best = head.value
        for part, key, row in _links(batches, _sizes(path_a, path_b)):
            at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            there = known[at] == key if len(known) else np.zeros(len(key), bool)
            n_best, count_sum = np.zeros((2, part.num_rows), np.int64)
            np.add.at(n_best, row[there], best[at[there]].astype(np.int64))
            np.add.at(count_sum, row[there], links[at[there]])
            span = len(_sizes(path_a, path_b)[0]) * len(_sizes(path_a, path_b)[1])
            rest, n = np.unique(row[~there] * span + key[~there], return_counts=True)
            off = pa.array(np.searchsorted(rest // span, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(x.astype(np.int64))) for x in (rest % span, n)]
            yield pa.RecordBatch.from_arrays([part.column(4), pa.array(n_best), pa.array(count_sum), *lists], names=["key", "n_best", "count_sum", "pairs", "times"])
    return run


def align(docs: DataFrame, a: str | None = None, b: str | None = None, head: int = HEAD, room: int = PAIRS) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``a`` is the file of a byte-level BPE, applied to a space and the text; ``b`` that of a sentencepiece model, which
    adds the space itself. Strings of special tokens in a text are text. A link is a pair of an A and a B token whose
    bytes overlap; an id pair's count is the number of links that hold it in all rows. ``count_sum`` adds it up over
    the row's links, ``n_best`` counts the links whose count is the highest of their B id (ties included).
    ``groups_sha256`` is of ``a1,a2|b1;a3|b2,b3``, the ids between ends that both share.

    A null or empty text, or one that the joined bytes of A or B do not give back (text with U+2581, say), has zeros
    and an empty ``groups_sha256``. Repeated rows count once each and get equal results; an empty table gives none.
    ``head`` bounds the pairs broadcast, ``room`` those a task holds; neither changes a result.
    """
    spark, a, b = docs.sparkSession, a or default_vocabulary(), b or default_pieces()
    rows = pick(docs, doc_id="long", text="string")
    key = F.concat(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.octet_length("text").cast("long")), 16, "0")))
    texts = rows.filter("text <> ''").groupBy("text").agg(F.count("*").alias("copies")).select(key.alias("key"), "copies", "text")
    texts = stored(texts.mapInArrow(_align(a, b), f"key binary, copies long, a binary, b binary, {_MEASURES}, groups_sha256 string"), "aligned-texts")

    linked = texts.select("copies", "a", "b", "n_links", "key")
    pairs = linked.mapInArrow(_pairs(a, b, room), "pair long, links long").groupBy("pair").agg(F.sum("links").alias("links"))
    width = len(coders(a, b)[1].text_size)
    pairs = stored(pairs.withColumn("b", F.col("pair") % width), "pairs")
    best = pairs.groupBy("b").agg(F.max("links").alias("most"))       # one row an id of B
    pairs = stored(pairs.join(best, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best")), "pair-counts")
    # eighths of powers of two, from the most frequent pairs down, as long as the table stays within `head`
    steps = sorted(pairs.groupBy(F.floor(F.log2("links") * 8).alias("step")).count().collect(), reverse=True)
    least, total = None, 0
    for step, n in steps:
        if total + n > head:
            break
        least, total = step, total + n
    whole = total == sum(n for _, n in steps)
    top = pairs.filter(F.floor(F.log2("links") * 8) >= F.lit(least)).toArrow() if total else pairs.limit(0).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    sent = spark.sparkContext.broadcast(tuple(top[c].to_numpy()[order] for c in ("pair", "links", "best")))

    found = linked.mapInArrow(_measures(a, b, sent), "key binary, n_best long, count_sum long, pairs array<long>, times array<long>")
    if not whole:
        found = stored(found, "measures")
        rest = found.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("key", "x.pairs", "x.times").join(pairs.withColumnRenamed("pair", "pairs"), "pairs")
        rest = rest.select("key", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("links") * F.col("times")).alias("count_sum"))
        found = found.select("key", "n_best", "count_sum").unionByName(rest).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    counts = texts.select("key", *[c.split()[0] for c in _MEASURES.split(", ")], "groups_sha256").join(found.select("key", "n_best", "count_sum"), "key")
    out = rows.select("doc_id", F.when(F.col("text") != "", key).alias("key")).join(counts, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *[zero(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
