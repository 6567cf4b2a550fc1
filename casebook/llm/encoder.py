"""Vectorised reuse of a byte-level BPE tokenizer: equal spans of text are encoded once while bounded tables last.

A sure boundary stands before a single space between two characters that are not white space, and between an ASCII
letter and one of ``,.;:!?``. The pre-tokenizer starts a new word there whatever follows (its only rule that takes
more than one leading space is for runs of white space; letters never share a word with those marks), merges stay
within words, and no special token holds a space or such a mark; so the ids of the spans between sure boundaries,
joined, are the ids of the whole text. Vocabularies with other settings are not cut (``plain`` is false).

Spans are found by 64-bit hashes. ``decoded`` gives back the text bytes of ids, so callers can compare them with the
input: the vocabulary is lossless, hence two spans taken for one another would show.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from casebook.llm import kernels

WORDS, CHUNKS = 2_000_000, 150_000      # table sizes, in entries
JOINT = 256                             # new spans that the library gets as one text; it is slower on long texts
_MARK = np.isin(np.arange(256), list(b",.;:!?"))
_ASCII_LETTER = np.isin(np.arange(256) | 32, np.arange(97, 123)) & (np.arange(256) >= 65) & (np.arange(256) < 128)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + size[i] - 1`` of all i, in order."""
    ends = np.cumsum(size, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)


def merged(*parts: np.ndarray) -> np.ndarray:
    """Sorted distinct values of sorted arrays (a stable sort merges runs)."""
    every = np.sort(np.concatenate(parts), kind="stable")
    return every[np.append(True, every[1:] != every[:-1])]


class Table:
    """Sorted hashes with a run of ids each. Beyond ``room`` entries, those not used lately go."""

    def __init__(self, room: int) -> None:
        self.room, self.clock = room, 0
        self.hash = np.zeros(0, np.uint64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 if it has none."""
        at = np.searchsorted(self.hash, h)
        at[at == len(self.hash)] = 0
        found = np.where(self.hash[at] == h, at, -1) if len(self.hash) else np.full(len(h), -1)
        self.used[found[found >= 0]] = self.clock
        return found

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Entries for hashes that have none; ``ids`` holds their runs one after another."""
        self.clock += 1
        if len(self.hash) + len(h) > self.room:
            keep = np.flatnonzero(self.used > np.median(self.used)) if len(self.used) else np.zeros(0, np.int64)
            self.ids = self.ids[ragged(self.start[keep], self.size[keep])]
            self.hash, self.size, self.used = self.hash[keep], self.size[keep], self.used[keep]
            self.start = np.cumsum(self.size, dtype=np.int64) - self.size
        start = len(self.ids) + np.cumsum(size, dtype=np.int64) - size
        order = np.argsort(h)
        at = np.searchsorted(self.hash, h[order])
        self.start = np.insert(self.start, at, start[order])
        self.size = np.insert(self.size, at, size[order])
        self.used = np.insert(self.used, at, self.clock)
        self.hash = np.insert(self.hash, at, h[order])
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32)])


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens", [])
        self.plain = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex") and model["type"] == "BPE"
                      and not spec.get("normalizer") and not model.get("dropout") and (spec.get("decoder") or {}).get("type") == "ByteLevel"
                      and not any(set(" ,.;:!?") & set(t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added))
        self.words, self.chunks = Table(WORDS), Table(CHUNKS)
        if self.plain:
            # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
            parts = {i: bytes(back[c] for c in t) for t, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in added}
            every = [parts.get(i, b"") for i in range(max(parts) + 1)]
            self.text, self.text_at, self.text_size = self._pool(every)
            self.digits, self.digits_at, self.digits_size = self._pool([f"{i},".encode() for i in range(len(every))])

    @staticmethod
    def _pool(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.array([len(p) for p in parts], np.int64)
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def sure(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Positions of the sure boundaries of a block: marks after an ASCII letter, and spaces with a printable ASCII
        byte or a character of U+00C0..U+00FF on either side, in one document."""
        if len(data) < 3:
            return np.zeros(0, np.int64)
        ascii_ = (data > 0x20) & (data < 0x7F)
        latin = data == 0xC3
        before = ascii_.copy()
        before[1:] |= latin[:-1]
        mask = np.zeros(len(data), bool)
        mask[1:-1] = (data[1:-1] == 0x20) & before[:-2] & (ascii_ | latin)[2:]
        some = off[:-1] < off[1:]
        mask[off[1:][some] - 1] = False
        mask[1:] |= _MARK[data[1:]] & _ASCII_LETTER[data[:-1]]
        mask[off[:-1][some]] = False
        return np.flatnonzero(mask)

    def lookup(self, data: np.ndarray, sums: kernels.PrefixHash, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Entries of ``words`` for the given spans; new ones are encoded by the library."""
        h, first, inverse = np.unique(sums.of(start, end), return_index=True, return_inverse=True)
        found = self.words.find(h)
        if (found < 0).any():
            new = np.flatnonzero(found < 0)
            self._learn(data, h[new], start[first[new]], end[first[new]])
            found = self.words.find(h)
            if (found < 0).any():       # some went to make room
                new = np.flatnonzero(found < 0)
                self._learn(data, h[new], start[first[new]], end[first[new]])
                found = self.words.find(h)
        return found[inverse]

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        last, size = data[end - 1], end - start
        word = (data[start] == 0x20) & (size > 1) & (((last > 0x20) & (last < 0x7F)) | (data[np.maximum(end - 2, 0)] == 0xC3))
        word &= data[np.minimum(start + 1, len(data) - 1)] > 0x20
        mark = _MARK[data[start]] & _ASCII_LETTER[last]
        sizes, ids, order = [], [], []
        for joint in (np.flatnonzero(word), np.flatnonzero(mark)):
            for part in np.array_split(joint, max(1, len(joint) // 4096)):
                if len(part) == 0:
                    continue
                # one text of many spans: each starts at a sure boundary of it, so token lengths tell them apart
                text = data[ragged(start[part], size[part])].tobytes().decode()
                got = np.array(self.whole([text])[0], np.int64)
                limits = np.searchsorted(np.cumsum(self.text_size[got]), np.cumsum(size[part]), "left") + 1
                sizes.append(np.diff(limits, prepend=0))
                ids.append(got)
                order.append(part)
        rest = np.flatnonzero(~word & ~mark)
        if len(rest):
            got = self.whole([data[a:b].tobytes().decode() for a, b in zip(start[rest], end[rest], strict=True)])
            sizes.append(np.array([len(g) for g in got]))
            ids.append(np.array([i for g in got for i in g], np.int64))
            order.append(rest)
        self.words.add(h[np.concatenate(order)], np.concatenate(sizes).astype(np.int64), np.concatenate(ids))

    def encode(self, data: np.ndarray, off: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a block of documents, end of each document among them). With ``cuts``, equal chunks between
        cuts are looked up whole and only the joins and new chunks go word by word."""
        if len(data) == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        sums, sure = kernels.PrefixHash(data), self.sure(data, off)
        limits = merged(sure, off)
        start, end = limits[:-1], limits[1:]
        hit_at = hit_end = np.zeros(0, np.int64)
        if cuts is not None and len(sure):
            a = np.searchsorted(sure, cuts[:-1], "left")
            b = np.searchsorted(sure, cuts[1:], "left") - 1
            core = a < b
            core_at, core_end = sure[a[core]], sure[b[core]]
            core_hash = sums.of(core_at, core_end)
            entry = self.chunks.find(core_hash)
            hit_at, hit_end, entry, miss = core_at[entry >= 0], core_end[entry >= 0], entry[entry >= 0], np.flatnonzero(entry < 0)
            inside = np.searchsorted(hit_at, start, "right") - 1
            need = (inside < 0) | (start >= hit_end[np.maximum(inside, 0)]) if len(hit_at) else np.ones(len(start), bool)
            start, end = start[need], end[need]
        found = self.lookup(data, sums, start, end)
        at = np.concatenate([start, hit_at])
        size = np.concatenate([self.words.size[found], self.chunks.size[entry] if len(hit_at) else np.zeros(0, np.int64)])
        order = np.argsort(at, kind="stable")
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(size[order], dtype=np.int64) - size[order]
        ids = np.empty(int(size.sum()), np.uint32)
        n = len(start)
        ids[ragged(place[:n], size[:n])] = self.words.ids[ragged(self.words.start[found], size[:n])]
        if len(hit_at):
            ids[ragged(place[n:], size[n:])] = self.chunks.ids[ragged(self.chunks.start[entry], size[n:])]
        at, place = at[order], np.append(place[order], len(ids))
        if cuts is not None and len(sure) and len(miss):
            new, first = np.unique(core_hash[miss], return_index=True)
            a = place[np.searchsorted(at, core_at[miss[first]])]
            b = place[np.searchsorted(at, core_end[miss[first]])]
            self.chunks.add(new, b - a, ids[ragged(a, b - a)])
        return ids, place[np.searchsorted(at, off[1:])]

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        return self.text[ragged(self.text_at[ids], self.text_size[ids])]

    def decimal(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids in decimal with a comma after each, and where each ends."""
        size = self.digits_size[ids]
        return self.digits[ragged(self.digits_at[ids], size)], np.cumsum(size)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One a Python worker: its tables serve all tasks that the worker runs."""
    return Encoder(path)
