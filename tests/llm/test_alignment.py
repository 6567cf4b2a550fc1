"""Alignment of two tokenizers against both libraries and pairs counted one by one."""

import collections
import hashlib
import random

import pytest

from casebook.llm import alignment
from casebook.llm.encoder import default_vocabulary

SHAPE = "doc_id long, text string, key string, copies int, `n_a.x` int"


def _texts():
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "cat", "Sprüche", "naïve", "日本語", "token<|endoftext|>s", "<s>", "<0x41>", "</s>", "foo_bar", "x+y", "12345", "🙂", "é", " ", "don't"])
    join = lambda: rng.choice([" ", "  ", "\n", "\t", ", ", ".", "\n\n   ", "    ", ""])
    texts = ["".join(word() + join() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [None, "", " ", "   ", "\n", "a", " a", "a ", "▁", "a▁b c", "\0", "a\0 b", "﻿x", "x" * 3000, "ab " * 9000, "漢字" * 2000, *texts, *texts[:9], *texts[:3]]


def _brute(rows):
    import sentencepiece
    import tokenizers
    first = tokenizers.Tokenizer.from_file(default_vocabulary())
    first.no_truncation()
    first.no_padding()
    first.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}
    second = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    aligned, counts = [], collections.Counter()
    for text in [r[1] for r in rows]:
        links, groups, a, b = [], [], [], []
        if text:
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            bytes_a = [bytes(back[c] for c in first.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(second.id_to_piece(i)[3:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
                a = b = []
        if a:
            i = j = at_a = at_b = 0
            own_a, own_b = [], []
            while i < len(a) or j < len(b):
                if at_a == at_b and own_a:
                    groups.append((own_a, own_b))
                    own_a, own_b = [], []
                if at_a <= at_b:
                    own_a.append(a[i])
                    at_a += len(bytes_a[i])
                    i += 1
                else:
                    own_b.append(b[j])
                    at_b += len(bytes_b[j])
                    j += 1
            groups.append((own_a, own_b))
            at_b = lo = 0
            starts = []
            for t in bytes_b:
                starts.append((at_b, at_b + len(t)))
                at_b += len(t)
            at_a = 0
            for x, t in zip(a, bytes_a, strict=True):
                while starts[lo][1] <= at_a:
                    lo += 1
                k = lo
                while k < len(b) and starts[k][0] < at_a + len(t):
                    links.append((x, b[k]))
                    k += 1
                at_a += len(t)
            counts.update(links)
        aligned.append((a, b, groups, links))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for (i, *_), (a, b, groups, links) in zip(rows, aligned, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(said.encode()).hexdigest() if a else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("head, room", [(1_000_000, 1_000_000), (200, 50), (0, 1)])
def test_alignment(spark, head, room):
    rows = [(i if i % 7 else None, t, "k", 3, 1) for i, t in enumerate(_texts())] + [(5, "again", "k", 3, 1)] * 2
    got = alignment.align(spark.createDataFrame(rows, SHAPE).repartition(3), head=head, room=room)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = _brute(rows)
    assert sum(not w[1] for w in want) >= 4
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_whole_texts_where_spans_are_not_sure(spark, monkeypatch):
    coder = alignment.coders(default_vocabulary(), alignment.default_pieces())[1]
    rows = [(i, t) for i, t in enumerate(_texts()[4:30])]
    data, off = alignment._spaced(*alignment.kernels.utf8(alignment.pa.array([t for _, t in rows])))
    quick, good = alignment._tokens(coder, data, off)
    monkeypatch.setattr(coder, "plain", False)
    slow, also = alignment._tokens(coder, data, off)
    assert good.tolist() == also.tolist() and [x.tolist() for x in quick] == [x.tolist() for x in slow]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SHAPE)).collect() == []
    only = alignment.align(spark.createDataFrame([(1, None, "", 0, 0), (2, "▁", "", 0, 0)], SHAPE)).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
