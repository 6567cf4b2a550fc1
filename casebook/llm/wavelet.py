"""Token ids in wavelet-matrix files: one compressed file a shard, with access, rank, select, count and occurrences.

Texts are encoded where they are scanned, and only ids (two bytes each, for vocabularies up to 65,536) are shuffled.
Documents go to shards in ascending doc_id order: ranges of the key between approximate quantiles, a number of tasks
that grows with the rows up to ``PARTS``; a task starts a new file after ``FILE_TOKENS`` ids, so a file and the memory
of a task are bounded by that plus one batch or one document. A file holds the bit planes of its
ids from the highest bit down, each plane in the order that stable partitions by the planes above leave, a running
count of ones every 512 bits, and the id and end of every document.

Writers name a file by a fresh suffix and report it in their rows, so files of lost or repeated attempts are never
read. Files lie in the shared folder of ``spark.checkpoint.dir``.

File format: b"CBWM1\\n", length of the header (little-endian u32), JSON header, then zstd parts in header order:
doc ids (i64), null marks of the doc ids (u8), document ends (i64), and per plane its packed bits and its counts (u32).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casebook.llm import kernels
from casebook.llm.common import _WRITTEN, keyed, stored
from casebook.llm.encoder import default_vocabulary, encoder
from casebook.session import checkpoint_dir

MAGIC, SPAN, FILE_TOKENS, SHARD_ROWS, END = b"CBWM1\n", 512, 1 << 21, 2500, 2
PARTS = 4096        # range partitions at most; each writes as many files as its ids need
PIECE = 1 << 16     # ids that one step of a stable partition moves, so that its index arrays stay in cache


class WaveletMatrix:
    """A sequence of non-negative ids below 2^planes as bit planes with rank support."""

    def __init__(self, n: int, planes: list[np.ndarray], counts: list[np.ndarray]) -> None:
        self.n, self.planes, self.counts = n, planes, counts
        self.zeros = [n - int(self._ones(k, n)) for k in range(len(planes))]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        height = max(1, int(ids.max()).bit_length()) if n else 1
        v = ids.astype(np.uint16 if height <= 16 else np.uint32)
        planes, counts = [], []
        for k in range(height - 1, -1, -1):
            bit = ((v >> k) & 1).astype(bool)
            planes.append(np.packbits(bit, bitorder="little"))
            padded = np.zeros(-(-n // SPAN) * SPAN // 8, np.uint8)
            padded[:len(planes[-1])] = planes[-1]
            per = np.bitwise_count(padded.view(np.uint64)).reshape(-1, SPAN // 64).sum(axis=1, dtype=np.uint32)
            counts.append(np.concatenate([[0], np.cumsum(per, dtype=np.uint32)]).astype(np.uint32))
            down, zero, one = np.empty_like(v), 0, n - int(np.count_nonzero(bit))
            for i in range(0, n, PIECE):
                w, b = v[i:i + PIECE], bit[i:i + PIECE]
                low, high = np.flatnonzero(~b), np.flatnonzero(b)
                down[zero:zero + len(low)] = w[low]
                down[one:one + len(high)] = w[high]
                zero, one = zero + len(low), one + len(high)
            v = down
        return cls(n, planes, counts)

    def _ones(self, k: int, i: int) -> int:
        """Ones among the first ``i`` bits of plane ``k``."""
        at = i // SPAN
        part = self.planes[k][at * SPAN // 8:(i + 7) // 8]
        if len(part) == 0:
            return int(self.counts[k][at])
        bits = np.unpackbits(part, bitorder="little")[:i - at * SPAN]
        return int(self.counts[k][at]) + int(bits.sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(len(self.planes)):
            bit = int(self.planes[k][i >> 3] >> (i & 7)) & 1
            ones = self._ones(k, i)
            value, i = value << 1 | bit, self.zeros[k] + ones if bit else i - ones
        return value

    def _range(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` among the first ``i`` ids lie below the last plane."""
        height, a, b = len(self.planes), 0, i
        if value >> height:
            return 0, 0
        for k in range(height):
            x, y = self._ones(k, a), self._ones(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if value >> (height - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def rank(self, value: int, i: int) -> int:
        """Occurrences of ``value`` among the first ``i`` ids."""
        a, b = self._range(value, i)
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) occurrence of ``value``; -1 if there is none."""
        a, b = self._range(value, self.n)
        if not 0 <= nth < b - a:
            return -1
        at, height = a + nth, len(self.planes)
        for k in range(height - 1, -1, -1):
            one = value >> (height - 1 - k) & 1
            at = self._nth(k, one, at - self.zeros[k] if one else at)
        return at

    def _nth(self, k: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` bit of that value in plane ``k``."""
        below = self.counts[k].astype(np.int64) if bit else np.arange(len(self.counts[k])) * SPAN - self.counts[k]
        at = int(np.searchsorted(below, nth, "right")) - 1
        bits = np.unpackbits(self.planes[k][at * SPAN // 8:(at + 1) * SPAN // 8], bitorder="little")
        return at * SPAN + int(np.flatnonzero(bits == bit)[nth - int(below[at])])

    def occurrences(self, value: int) -> list[int]:
        return [self.select(value, i) for i in range(self.count(value))]

    def decode(self) -> np.ndarray:
        """All ids in order: the partitions undone from the last plane up."""
        v = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[k], count=self.n, bitorder="little").view(bool)
            mark = v.dtype.type(1 << (len(self.planes) - 1 - k))
            up, zero, one = np.empty_like(v), 0, self.zeros[k]
            for i in range(0, self.n, PIECE):
                w, b = up[i:i + PIECE], bit[i:i + PIECE]
                low, high = np.flatnonzero(~b), np.flatnonzero(b)
                w[low] = v[zero:zero + len(low)]
                w[high] = v[one:one + len(high)] | mark
                zero, one = zero + len(low), one + len(high)
            v = up
        return v.astype(np.uint32)


def to_bytes(doc_ids: np.ndarray, null: np.ndarray, ends: np.ndarray, matrix: WaveletMatrix) -> bytes:
    parts = [doc_ids.astype("<i8"), null.astype(np.uint8), ends.astype("<i8"), *[x for p, c in zip(matrix.planes, matrix.counts, strict=True) for x in (p, c.astype("<u4"))]]
    packed = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.nbytes else b"" for p in parts]
    head = json.dumps({"n": matrix.n, "docs": len(doc_ids), "planes": len(matrix.planes), "parts": [[len(b), p.nbytes] for b, p in zip(packed, parts, strict=True)]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc ids, their null marks, document ends, ids) of a file."""
    if not data.startswith(MAGIC):
        raise ValueError("not a wavelet-matrix file")
    at = len(MAGIC) + 4 + (size := struct.unpack_from("<I", data, len(MAGIC))[0])
    head, parts = json.loads(data[at - size:at]), []
    for packed, whole in head["parts"]:
        parts.append(pa.decompress(data[at:at + packed], whole, codec="zstd", asbytes=True) if whole else b"")
        at += packed
    planes = [np.frombuffer(p, np.uint8) for p in parts[3::2]]
    counts = [np.frombuffer(p, "<u4") for p in parts[4::2]]
    return np.frombuffer(parts[0], "<i8"), np.frombuffer(parts[1], np.uint8).astype(bool), np.frombuffer(parts[2], "<i8"), WaveletMatrix(head["n"], planes, counts)


def _filesystem(folder: str):
    """The Arrow file system of a folder and its path there; Hadoop's names of S3 are S3."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return pafs.LocalFileSystem(), folder
    scheme, rest = folder.split("://", 1)
    return pafs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{rest}")


def _kind(coder) -> type:
    """The integer type of ids, the end id included."""
    return np.uint16 if max(coder.tok.get_vocab_size(), END + 1) <= 1 << 16 else np.uint32


def _encode(path: str, bounds: list[int]):
    """(range of the key, key, doc_id, ids with the end id) of every row."""
    def run(batches):
        coder = encoder(path)
        kind, limits = _kind(coder), np.array(bounds, np.int64)
        for batch in batches:
            part = pa.array(np.searchsorted(limits, batch.column(0).to_numpy(), "left").astype(np.int32))
            for i, j, data, off in kernels.blocks(batch.column(2), 2 * kernels.BLOCK):
                if coder.plain:
                    got, ends = coder.encode(data, off)
                else:
                    each = coder.whole([data[off[d]:off[d + 1]].tobytes().decode() for d in range(j - i)])
                    got, ends = np.array([x for e in each for x in e], np.uint32), np.cumsum([len(e) for e in each])
                last = ends + np.arange(len(ends))
                ids, own = np.full(len(got) + len(ends), END, kind), np.ones(len(got) + len(ends), bool)
                own[last] = False
                ids[own] = got
                cuts = (np.append(0, last + 1) * ids.itemsize).astype(np.int64)
                packed = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cuts), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.slice(i, j - i), batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), packed], names=["part", "_row", "doc_id", "ids"])
    return run


def _write(folder: str, path: str, file_tokens: int):
    def run(batches):
        fs, base = _filesystem(folder)
        fs.create_dir(base)
        kind, part, seq = _kind(encoder(path)), TaskContext.get().partitionId(), 0
        encoder.cache_clear()       # the worker may have encoded before; planes need its memory
        keys, sizes, ids, held = [], [], [], 0

        def close():
            name = f"shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.wm"
            with fs.open_output_stream(f"{base}/{name}") as f:
                doc = pa.chunked_array(keys, pa.int64())
                f.write(to_bytes(doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(), np.cumsum(np.concatenate(sizes)), WaveletMatrix.build(np.concatenate(ids))))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([name]), pa.array([held], pa.int64())],
                                              names=["part", "seq", "name", "n"])

        for batch in batches:
            column = batch.column(3).cast(pa.large_binary())
            off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
            data = np.frombuffer(column.buffers()[2], np.uint8)
            ends, i = off // np.dtype(kind).itemsize, 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, ends[i] + file_tokens - held, "right")) - 1)
                ids.append(data[off[i]:off[j]].copy().view(kind).astype(np.uint32))
                sizes.append(np.diff(ends[i:j + 1]))
                keys.append(batch.column(2).slice(i, j - i))
                held, i = held + len(ids[-1]), j
                if held >= file_tokens or j < batch.num_rows:
                    yield close()
                    keys, sizes, ids, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield close()
    return run


def _read(folder: str):
    def run(batches):
        fs, base = _filesystem(folder)
        encoder.cache_clear()       # the worker may have written shards before
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{base}/{name}") as f:
                    doc, null, ends, matrix = from_bytes(f.read())
                ids = matrix.decode().astype("<u4")
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), pa.array(starts + before), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())],
                                                 names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def write_shards(rows: DataFrame, path: str | None = None, shard_rows: int = SHARD_ROWS, file_tokens: int = FILE_TOKENS) -> tuple[str, DataFrame]:
    """Writes keyed rows (``_row, doc_id, text``) in key order; (folder, manifest ``part, seq, name, n, before``)."""
    spark = rows.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables/wavelet-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, folder))
    path = path or default_vocabulary()
    parts = min(PARTS, max(1, -(-rows.count() // shard_rows)))
    grid = "array(" + ",".join(f"{i / parts}D" for i in range(1, parts)) + ")"
    bounds = (rows.agg(F.expr(f"percentile_approx(_row, {grid}, {8 * parts})")).first()[0] or []) if parts > 1 else []
    coded = rows.select("_row", "doc_id", "text").mapInArrow(_encode(path, bounds), "part int, _row long, doc_id long, ids binary")
    ordered = coded.repartitionById(parts, "part").sortWithinPartitions("_row")
    files = stored(ordered.mapInArrow(_write(folder, path, file_tokens), "part long, seq long, name string, n long"), "manifest")
    # running sums within a part, and over the parts, one row each
    total = files.groupBy("part").agg(F.sum("n").alias("n"))
    parts_before = total.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("parts_before"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folder, files.withColumn("own", own).join(parts_before, "part").select("part", "seq", "name", "n", (F.col("own") + F.col("parts_before")).alias("before"))


def read_shards(folder: str, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    tasks = max(1, -(-manifest.count() // 4))
    return manifest.select("name", "before").repartition(tasks, "name").mapInArrow(
        _read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, path: str | None = None, shard_rows: int = SHARD_ROWS, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """One row per input row, read back from the files: ``doc_id, start, n_tokens, ids_crc32``.

    Every text (null: empty) is encoded and ended with id 2. ``start`` counts the ids of all documents before, in
    ascending doc_id order, null last; rows that share a doc_id follow one another. ``ids_crc32`` is of the ids with
    the end id as little-endian unsigned 32-bit integers. An empty table writes no file and gives no rows.
    """
    rows = keyed(docs, text="string")
    folder, manifest = write_shards(rows, path, shard_rows, file_tokens)
    return read_shards(folder, manifest)
