"""Positional index against brute force: shared, short, empty and null items, repeated words, repeated and null ids."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from casebook.llm import decontamination

SHAPE = "doc_id long, text string, pos int, term string, `n.x` int"
ITEMS = "item_id string, text string, words int, o int"


def _words(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _data():
    rng = random.Random(3)
    vocab = [c + v for c in "bdfgk" for v in "aeiou"] + ["É", "ß", "日本", "x1"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(str(i), say(rng.randint(1, 30))) for i in range(20)]
    items += [("7b", items[7][1].upper().replace(" ", "--")), ("same", "a a a a a a a a a a a a"), ("same", say(15)), (None, say(14)), ("none", None), ("blank", " .! "),
              ("ends", "zz " + say(10) + " never"), ("99", "İstanbul Ünder ÀB")]
    docs = [None, "", "...", "a", "a " * 40, "İstanbul, Ünder ÀB", "istanbul ünder àb"]
    for _ in range(60):
        parts = [say(rng.randint(0, 12)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            w = _words(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(w) - 3))
            parts.insert(rng.randint(0, 3), ", ".join(w[a:a + rng.randint(5, 40)]))
        docs.append(" ".join(parts))
    docs += docs[10:14] + [" ".join(i[1] or "" for i in items) + " tail" * 3000]
    rows = [(i, t) for i, t in enumerate(docs)] + [(3, docs[12]), (None, docs[13]), (None, docs[13])]
    return [(i, t, 1, "x", 2) for i, t in rows], [(i, t, 0, 0) for i, t in items]


def _brute(docs, items, window):
    out = []
    for i, t, *_ in docs:
        w, hit, held = _words(t), set(), set()
        for name, text, *_ in items:
            v = _words(text)
            size = min(window, len(v))
            phrases = {tuple(v[s:s + size]) for s in range(len(v) - size + 1)} if v else set()
            for s in range(len(w) - size + 1) if v else ():
                if tuple(w[s:s + size]) in phrases:
                    hit.update(range(s, s + size))
                    held.add(name)
        held = sorted(held - {None})
        out.append((i, len(w), len(hit), len(held), hashlib.sha256(",".join(held).encode()).hexdigest(), bool(hit), held))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [10, 4, 1])
def test_contamination(spark, window):
    docs, items = _data()
    got = decontamination.contamination(spark.createDataFrame(docs, SHAPE).repartition(3), spark.createDataFrame(items, ITEMS), window)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"]
    want = _brute(docs, items, window)
    assert sum(w[5] for w in want) > 20 and any(not w[5] for w in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_shuffled_joins_find_the_same(spark):
    docs, items = _data()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = decontamination.contamination(spark.createDataFrame(docs, SHAPE), spark.createDataFrame(items, ITEMS)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(map(tuple, got), key=str) == _brute(docs, items, 10)


def test_phrases_name_places_in_both_texts(spark):
    docs = spark.createDataFrame([(1, "p q r s t u v. p q r s")], "doc_id long, text string")
    ix = decontamination.index(docs, spark.createDataFrame([("i", "x q r s t"), ("j", "s t u")], "item_id string, text string"))
    got = decontamination.phrases(ix, 3).join(ix.items, "text").select("item_id", "pos", "length", "at").collect()
    assert sorted(map(tuple, got)) == [("i", 1, 4, 1), ("i", 8, 3, 1), ("j", 3, 3, 0)]


@pytest.mark.parametrize("span", [3, 8, 30])
def test_near(spark, span):
    docs, items = _data()
    ix = decontamination.index(spark.createDataFrame(docs, SHAPE), spark.createDataFrame(items, ITEMS))
    got = decontamination.near(ix, span).join(ix.rows, "_row").join(ix.items, "text").select("doc_id", F.col("item_id"), "pos")
    want = []
    for i, t, *_ in docs:
        w = _words(t)
        for name, v in {(n, tuple(_words(text))) for n, text, *_ in items if n is not None and _words(text)}:
            want += [(i, name, s) for s in range(len(w)) if w[s] in v and set(v) <= set(w[s:s + span])]
    assert want
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark):
    docs, items = _data()
    none = decontamination.contamination(spark.createDataFrame([], SHAPE), spark.createDataFrame(items, ITEMS))
    assert none.collect() == []
    clean = decontamination.contamination(spark.createDataFrame(docs, SHAPE), spark.createDataFrame([], ITEMS))
    assert sorted(map(tuple, clean.collect()), key=str) == _brute(docs, [], 10)


def test_the_plan_holds_no_python(spark):
    docs, items = _data()
    plan = decontamination.contamination(spark.createDataFrame(docs, SHAPE), spark.createDataFrame(items, ITEMS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"))
