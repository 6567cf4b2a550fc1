"""Hard negatives against brute force: copies, ties, repeated and null ids, negative and zero scores, ragged vectors."""

import random

import pytest

from casebook.llm import negatives

SHAPE = "vec_id long, embedding array<bigint>, label int, anchor boolean, `_row` string, `score.x` int"


def _table(seed, n, width):
    rng = random.Random(seed)
    rows = [(i, [rng.randint(-6, 9) for _ in range(width)], rng.randrange(3), i % 4 == 0) for i in range(n)]
    rows += [(n + i, rows[8][1], i % 3, i % 5 == 0) for i in range(20)]                 # copies of one vector under all labels
    rows += [(2, [1] * width, 0, False), (2, [1] * width, 0, False)]                    # repeated ids
    rows += [(None, [2] * width, 1, True), (500, None, 1, True), (501, [1, None], 1, True), (502, [1] * width, None, True)]
    rows += [(503, [3], 1, True), (504, [], 2, None), (505, [0] * width, 1, True)]      # short, empty and zero vectors
    return [r + ("x", 1) for r in rows]


def _brute(rows, positives, most):
    live = [(i, r) for i, r in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))
            if r[1] is not None and r[2] is not None and None not in r[1]]
    out = []
    for i, a in live:
        if not a[3]:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[1], b[1], strict=False)), j, b) for j, b in live if j != i)
        for p, _, b in [s for s in scored if s[2][2] == a[2]][:positives]:
            good = [(s, c) for s, _, c in scored if c[2] != a[2] and 80 * -p <= 100 * -s <= 100 * -p][:most]
            out += [(a[0], b[0], r, c[0], -p, -s) for r, (s, c) in enumerate(good, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("positives, most, block", [(5, 5, 1 << 25), (3, 1, 400), (1, 4, 100)])
def test_hard_negatives(spark, positives, most, block):
    rows = _table(positives, 120, 4)
    got = negatives.mine(spark.createDataFrame(rows, SHAPE).repartition(5), positives, most, block_bytes=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = _brute(rows, positives, most)
    assert len(want) > 100 and any(w[0] is None for w in want) and any(w[4] == 0 for w in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_large_components_stay_exact(spark):
    rows = [(i, [(1 << 27) + i, -(1 << 26) - 3 * i], i % 2, i == 0, "", 0) for i in range(12)]
    assert sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, SHAPE)).collect()), key=str) == _brute(rows, 5, 5)


def test_without_rows_or_anchors(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert negatives.mine(empty).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [1], 0, False, "", 0), (2, [1], 0, None, "", 0)], SHAPE)).collect() == []
    alone = spark.createDataFrame([(1, [1], 0, True, "", 0), (2, [1], 1, False, "", 0)], SHAPE)
    assert negatives.mine(alone).collect() == []
