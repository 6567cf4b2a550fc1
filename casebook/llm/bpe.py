"""BPE encoding and decoding with content-defined chunk reuse.

A document's bytes are cut where a rolling hash of the 16 bytes before hits a mask, so equal passages give equal
chunks in any document. A chunk's core, from its first to its last sure boundary (see ``encoder``), is encoded once
and then looked up by its hash. The joins between cores, ragged ends of neighbouring chunks, are repaired by
re-encoding them from sure boundary to sure boundary; where a chunk has no two of them, the repair runs on through
the next chunks. Every block is then decoded and compared with its input; a document that differs is encoded whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from casebook.llm import kernels
from casebook.llm.common import pick
from casebook.llm.encoder import Encoder, default_vocabulary, encoder, merged

CHUNK, WINDOW = 256, 16


def chunk_cuts(data: np.ndarray, off: np.ndarray, mask: int) -> np.ndarray:
    """Cut positions inside a block: document limits and content-defined cuts, none inside a character."""
    at = np.zeros(0, np.int64)
    if len(data) > WINDOW:
        ends = np.arange(WINDOW, len(data))
        at = ends[(kernels.PrefixHash(data).of(ends - WINDOW, ends) & np.uint64(mask)) == 0]
        at = at[(data[at] & 0xC0) != 0x80]
        at = at[at - off[np.searchsorted(off, at, "right") - 1] >= WINDOW]      # the window lies within the document
    return merged(off, at)


def _whole(coder: Encoder, text: str) -> tuple[int, str, str]:
    ids = coder.whole([text])[0]
    back = coder.tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def digests(coder: Encoder, data: np.ndarray, off: np.ndarray, chunk: int) -> list[tuple[int, str, str]]:
    """(token count, digest of the ids, digest of the decoded text) of every document of a block."""
    ids, ends = coder.encode(data, off, chunk_cuts(data, off, chunk - 1))
    numbers, number_ends = coder.decimal(ids)
    text, text_ends = coder.decoded(ids), np.cumsum(coder.text_size[ids])
    numbers, text, raw = numbers.tobytes(), text.tobytes(), data.tobytes()
    upto = lambda e, n: int(e[n - 1]) if n else 0
    out, a = [], 0
    for d, b in enumerate(ends.tolist()):
        own = text[upto(text_ends, a):upto(text_ends, b)]
        if own == raw[off[d]:off[d + 1]]:
            decimal = numbers[upto(number_ends, a):upto(number_ends, b)]
            out.append((b - a, hashlib.sha256(decimal[:-1]).hexdigest(), hashlib.sha256(own).hexdigest()))
        else:
            out.append(_whole(coder, raw[off[d]:off[d + 1]].decode()))
        a = b
    return out


def _round_trip(path: str, chunk: int):
    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for i, j, data, off in kernels.blocks(batch.column(1)):
                if coder.plain:
                    rows = digests(coder, data, off, chunk)
                else:
                    rows = [_whole(coder, data[off[d]:off[d + 1]].tobytes().decode()) for d in range(j - i)]
                n, ids, text = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def round_trip(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text in UTF-8. Null text
    counts as empty: no ids, digests of the empty string. ``chunk`` (a power of two) is the mean chunk length in
    bytes; the tables are bounded per worker, so reuse can be lost, never correctness. Rows are independent, so
    repeated rows give equal results and an empty table none.
    """
    rows = pick(docs, doc_id="long", text="string")
    return rows.mapInArrow(_round_trip(path or default_vocabulary(), chunk), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
