"""Substring deduplication by hashing lines, the sentences in them and pieces of long sentences.

A unit is a run up to a sentence end or line end (``[^.!?\\n]+[.!?\\n]*``, with the marks of other scripts); all
units of a text joined give the text. Units are compared lower-cased with white space collapsed. A unit of under
``min_words`` words says little alone, so it is compared together with the units before it on its line, then those
after it, until that many words are there. A line of fewer words is one unit and takes its context from the lines
before it, then those after it; only a text of under ``min_words`` words is never touched.

A longer unit is cut at words that have the least hash among ``WINDOW`` neighbours, none within ``EDGE`` words of its
ends, so the cuts inside a repeated run do not depend on where the sentence around it starts or ends. A piece is
compared as part of the ``RUN`` words up to its end (from the start of the unit if there are fewer), so what goes is a
whole unit or part of a repeated run of ``RUN`` words: every verbatim run of over 50 words loses a piece at least. A
word of over ``LONG`` letters is a unit of its own, cut alike at letters, and ``LETTERS`` letters of it, or of scripts
without spaces, count as a word.

Equal 128-bit digests are one group; its first occurrence by (document, position) stays, the others go, and what goes
is reported by its offsets (code points) in the original text.

Finding the groups moves digests and positions only, and only once: equal digests of a run of documents are one row
with their places before the shuffle, and the least places and the join that brings them back read the same shuffle.
So a line that every document holds is one row a run of documents.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import keyed

_END = ".!?\n。！？｡।؟"
UNIT = re.compile(f"[^{_END}]+[{_END}]*|[{_END}]+")
MIN_WORDS = 5
EDGE, WINDOW, RUN = 6, 7, 25
LETTERS, LONG = 4, 40
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"\S+")
_LONG_WORD = re.compile(rf"\S{{{LONG + 1},}}")
_BY_LETTERS = re.compile(rf"\S{{{LONG + 1},}}|[{_SPACELESS}]")


def winnowed(h: list[int], edge: int, window: int) -> list[int]:
    """Positions that hold the least value (the last such) of some ``window`` neighbours, ``edge`` or more from the ends."""
    out, best, last = [], 0, len(h) - edge - 1
    for j in range(1, len(h)):
        if h[j] <= h[best]:
            best = j
        elif best <= j - window:
            best = j - window + 1
            for i in range(best + 1, j + 1):
                if h[i] <= h[best]:
                    best = i
        if j >= window - 1 and edge <= best <= last and (not out or out[-1] != best):
            out.append(best)
    return out


def _letter_hashes(word: str) -> list[int]:
    """Of the four letters from each letter on."""
    codes = np.frombuffer((word + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(word), np.uint64)
    for i in range(4):
        h = (h ^ codes[i:i + len(word)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.tolist()


def _size(words: list[str], by_letters: bool) -> int:
    if not by_letters:
        return len(words)
    return sum(max(1, len(w) // LETTERS) if _BY_LETTERS.search(w) else 1 for w in words)


def _needs_letters(text: str) -> bool:
    """Whether a text has a word of over ``LONG`` letters or letters of a script without spaces."""
    if text.isascii():
        return max(map(len, text.split()), default=0) > LONG
    return _BY_LETTERS.search(text) is not None


def _pieces(text: str, start: int, end: int, by_letters: bool):
    """(start, end, words, size, what is compared or None) of a unit, cut where it is long."""
    own = text[start:end]
    if by_letters and (m := _LONG_WORD.search(own)) and (m.start() or m.end() < len(own)) and (m.start() or own[m.end():].strip()):
        # the long word is a unit of its own, with the white space after it
        rest = m.end() + len(own[m.end():]) - len(own[m.end():].lstrip())
        for a, b in ((0, m.start()), (m.start(), rest), (rest, len(own))):
            if a < b:
                yield from _pieces(text, start + a, start + b, by_letters)
        return
    words = own.lower().split()
    parts, scale, at, join = words, 1, None, " "
    if len(words) == 1 and len(words[0]) > LONG:
        lead = len(own) - len(own.lstrip())
        word = own.strip()
        parts = list(word.lower()) if len(word.lower()) == len(word) else list(word)
        scale, at, join = LETTERS, range(lead, lead + len(word)), ""
        cuts = winnowed(_letter_hashes("".join(parts)), EDGE * scale, WINDOW * scale)
    elif len(words) > 2 * EDGE:
        cuts = winnowed([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], EDGE, WINDOW)
    else:
        cuts = []
    if not cuts:
        yield start, end, words, _size(words, by_letters), None
        return
    at = at or [m.start() for m in _WORD.finditer(own)]
    limits, run = [0, *cuts, len(parts)], RUN * scale
    for a, b in zip(limits, limits[1:], strict=False):
        first = max(0, b - run)
        what = f"{a - first}\1{b - first}\1{join.join(parts[first:max(b, first + run)])}"
        mine = parts[a:b] if scale == 1 else ["".join(parts[a:b])]
        yield start + (at[a] if a else 0), start + at[b] if b < len(parts) else end, mine, _size(mine, True) if by_letters else b - a, what


def _cut_words(start: int, end: int, own: str, words: list[str]):
    """The same of a unit of more than twice ``EDGE`` words, none of them counted by letters."""
    cuts = winnowed([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], EDGE, WINDOW)
    if not cuts:
        yield start, end, words, len(words), None
        return
    a, last, raw = 0, len(words), own.split()
    lead = len(own) - len(own.lstrip())
    if sum(map(len, raw)) + last - 1 == len(own.strip()):       # one character of white space between words
        at = list(accumulate(map(len, raw), lambda x, n: x + n + 1, initial=lead))
    else:
        at = [m.start() for m in _WORD.finditer(own)]
    for b in [*cuts, last]:
        first = max(0, b - RUN)
        yield (start + at[a] if a else start, start + at[b] if b < last else end, words[a:b], b - a,
               f"{a - first}\1{b - first}\1{' '.join(words[first:max(b, first + RUN)])}")
        a = b


def units(text: str, min_words: int = MIN_WORDS) -> list[tuple[int, int, str]]:
    """(start, end, what is compared) of the units that can be removed."""
    every: list[tuple[int, int, list[str], int, str | None]] = []
    lines: list[tuple[int, int, bool]] = []        # units from, to, whether the line is long enough to be compared by itself
    by_letters = _needs_letters(text)
    at = 0

    def close() -> None:
        nonlocal at
        full = sum(u[3] for u in every[at:]) >= min_words
        if not full and len(every) > at:
            words = [w for u in every[at:] for w in u[2]]
            every[at:] = [(every[at][0], every[-1][1], words, sum(u[3] for u in every[at:]), None)]
        lines.append((at, len(every), full))
        at = len(every)

    for m in UNIT.finditer(text):
        own = m.group()
        if by_letters and _needs_letters(own):
            every.extend(_pieces(text, m.start(), m.end(), True))
        else:
            words = own.lower().split()
            if len(words) > 2 * EDGE:
                every.extend(_cut_words(m.start(), m.end(), own, words))
            else:
                every.append((m.start(), m.end(), words, len(words), None))
        if "\n" in own:
            close()
    close()
    out: list[tuple[int, int, str]] = []
    if sum(u[3] for u in every) < min_words:
        return out
    for low, high, full in lines:
        for i in range(low, high):
            start, end, words, n, what = every[i]
            if what is None and n >= min_words:
                what = " ".join(words)
            elif what is None and (full or n):
                a, b, least, most = i, i + 1, *((low, high) if full else (0, len(every)))
                while n < min_words:
                    if a > least:
                        a -= 1
                        n += every[a][3]
                    elif b < most:
                        n += every[b][3]
                        b += 1
                what = f"{i - a}\0" + "\0".join(" ".join(u[2]) for u in every[a:b])
            if what is not None:
                out.append((start, end, what))
    return out


def _unit_rows(min_words: int):
    def run(batches):
        for batch in batches:
            at: list[np.ndarray] = []
            digests: list[bytes] = []
            limits: list[tuple[int, int]] = []

            def flush():
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                own = np.concatenate(at) if at else np.zeros(0, np.int64)
                lim = np.array(limits, np.int64).reshape(-1, 2)
                rows = batch.column(0).take(pa.array(own)).to_numpy(zero_copy_only=False)
                order = np.lexsort((lim[:, 0], rows, h[:, 1], h[:, 0]))
                h, own, lim = h[order], own[order], lim[order]
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(axis=1))) if len(h) else np.zeros(0, np.int64)
                take = pa.array(own)
                places = pa.StructArray.from_arrays([batch.column(0).take(take), pa.array(lim[:, 0].copy()), pa.array(lim[:, 1].copy()),
                                                     batch.column(1).take(take)], ["_row", "start", "end", "doc_id"])
                got = pa.RecordBatch.from_arrays([pa.array(h[new, 0]), pa.array(h[new, 1]),
                                                  pa.ListArray.from_arrays(pa.array(np.append(new, len(h)), pa.int32()), places)], names=["h1", "h2", "places"])
                at.clear(), digests.clear(), limits.clear()
                return got

            for i in range(batch.num_rows):
                found = units(batch.column(2)[i].as_py() or "", min_words)
                at.append(np.full(len(found), i, np.int64))
                for start, end, what in found:
                    limits.append((start, end))
                    digests.append(hashlib.blake2b(what.encode("utf-8", "surrogatepass"), digest_size=16).digest())
                if len(digests) > 100_000:
                    yield flush()
            yield flush()
    return run


_PLACES = "array<struct<_row:bigint,start:bigint,end:bigint,doc_id:bigint>>"


def removals(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``_row, removed``: per row that loses something the sorted array of (start, end, keep_id, keep_start)."""
    found = rows.select("_row", "doc_id", "text").mapInArrow(
        _unit_rows(min_words), f"h1 long, h2 long, places {_PLACES}")
    # the conditions that the join and inline would put below one of the two readers of the shuffle only
    found = found.filter("h1 IS NOT NULL AND h2 IS NOT NULL AND size(places) > 0 AND places IS NOT NULL").repartition("h1", "h2")
    first = found.groupBy("h1", "h2").agg(F.sum(F.size("places")).alias("n"), F.min(F.col("places")[0]).alias("first"))
    first = first.filter("n > 1").drop("n")
    again = found.join(first.hint("merge"), ["h1", "h2"]).select("first", F.inline("places")).filter(
        (F.col("first._row") != F.col("_row")) | (F.col("first.start") != F.col("start")))
    return again.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "end", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start")))).alias("removed"))


_SPANS = "array<struct<start:bigint,end:bigint,keep_id:bigint,keep_start:bigint>>"


def _cut(batches):
    """Drop the spans in ``removed`` (column 1) from the text (column 2)."""
    for batch in batches:
        texts = []
        for spans, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if spans:
                limits = [0, *[x for s in spans for x in (s["start"], s["end"])], len(text)]
                text = "".join(text[a:b] for a, b in zip(limits[::2], limits[1::2], strict=True))
            texts.append(text)
        yield batch.set_column(2, "text", pa.array(texts, batch.schema.field(2).type))


def decide(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Keyed rows with ``removed, n_removed, chars_removed`` and the text without what is removed."""
    rest = [c for c in rows.columns if c not in ("_row", "text")]
    both = rows.join(removals(rows, min_words), "_row", "left").select("_row", F.coalesce("removed", F.expr(f"CAST(array() AS {_SPANS})")).alias("removed"), "text", *rest)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return both.mapInArrow(_cut, both.schema).withColumns({"n_removed": F.size("removed"), "chars_removed": gone})


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per input row: ``doc_id, n_removed, chars_removed, removed, text``.

    ``removed`` lists the spans that went, in order, as (start, end, keep_id, keep_start): code point offsets in the
    original text, and where the occurrence that stays begins. ``text`` is what is left, null where the text was null.
    Repeated rows and null ids are rows of their own in the order of doc_id, null last. An empty table gives no rows.
    """
    return decide(keyed(docs, text="string"), min_words).select("doc_id", "n_removed", "chars_removed", "removed", "text")
