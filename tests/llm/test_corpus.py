"""Corpus operators against brute force on a small table with nulls, empty and long texts, ties, repeated rows and
columns whose names clash with working names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casebook.llm import bm25, bpe, components, encoder, exact, kernels, langid, minhash, packing, sharding, substring, toxicity, wavelet

VOCAB = [a + b for a in "ka lo mi ne ru ta po se".split() for b in "din fal mor tex gul".split()]


def _texts():
    rng = random.Random(11)
    base = [" ".join(rng.choice(VOCAB) for _ in range(rng.randint(3, 60))) + ".\n" + " ".join(rng.choice(VOCAB) for _ in range(12)) for _ in range(60)]
    near = [t.replace(t.split()[0], "changed", 1) for t in base[:20]]
    line = "one very common line stands in many documents here.\n"
    return [None, "", " \t\n", "Word", "word", "x", *base, *base[:15], *near, *[line + t for t in base[30:45]], *[t + "\n" + line for t in base[10:20]],
            "a b c", "A B\tC", "abc", " a b c ", "é ü <|endoftext|> 日本 " * 30, " ".join(VOCAB) * 400, "!!", "12 34"]


@pytest.fixture(scope="module")
def table(spark):
    texts = _texts()
    rows = [(i * 3, t, "en", i % 5, "own", True) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _row int, digit string, `kept.x` boolean").repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, an id with two texts and a row that is there twice."""
    return spark.createDataFrame([(1, "a b c d e f"), (1, "other text"), (2, "same"), (2, "same"), (None, "a b c d e f"), (None, None), (7, "same")],
                                 "doc_id long, text string")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def _pairs(table):
    return sorted((r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect())


def test_exact(spark, table, odd, empty):
    groups = collections.defaultdict(list)
    for i, t in _pairs(table):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    want = {}
    for norm, members in groups.items():
        members.sort()
        for _, i in members:
            want[i] = (members[0][1], len(members), i == members[0][1], hashlib.sha256(norm.encode()).hexdigest())
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact.exact_dedup(table).collect()}
    assert got == want
    rows = exact.exact_dedup(odd).collect()
    assert len(rows) == 7 and sum(r["kept"] for r in rows) == 4
    assert {r["keep_id"] for r in rows if r["group_size"] == 3} == {2} and {r["keep_id"] for r in rows if r["group_size"] == 2} == {1}
    assert exact.exact_dedup(empty).count() == 0


def _sets(pairs, k):
    out = {}
    for i, t in pairs:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near(spark, table, odd, empty, k):
    sets = _sets(_pairs(table), k)
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_dedup(table, k).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in sets}
    if k == 2:
        rows = minhash.near_dedup(odd, 2).collect()
        assert len(rows) == 7 and sum(r["kept"] for r in rows) == 4
        assert minhash.near_dedup(empty, 2).count() == 0


def test_near_within_hot_group(spark):
    """A group of near copies whose links do not all touch the least row."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(300):
        t = list(base)
        for _ in range(rng.randint(1, 8)):
            t[rng.randrange(80)] = f"v{rng.randrange(10 ** 6)}"
        texts.append(" ".join(t))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = _sets(list(enumerate(texts)), 2)
    parent = list(range(300))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(300):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df, 2).collect()} == {i: find(i) for i in range(300)}


def _similar(sets):
    return {(b, a) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_near_of_one_template(spark):
    """Texts of one template that are not near copies share buckets, but are not compared with each other."""
    rng = random.Random(8)
    template = [f"t{i}" for i in range(170)]
    texts = [[*template[:100], *(f"o{rng.randrange(10 ** 9)}" for _ in range(30)), *template[100:]] for _ in range(200)]
    for i in range(20):
        texts.append([*texts[i * 9][:128], f"n{i}", *texts[i * 9][129:]])
    texts = [" ".join(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    sets = _sets(list(enumerate(texts)), 2)
    links = _similar(sets)
    assert links == {(i * 9, 200 + i) for i in range(20)}
    assert 100 * len(sets[1] & sets[2]) > 70 * len(sets[1] | sets[2])
    rows = df.selectExpr("doc_id AS _row", "doc_id AS comp", "text")
    assert {tuple(r) for r in minhash.prefix_pairs(rows, 2, 80).collect()} == links      # of 24,090 pairs
    want = {b: a for a, b in links}
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_dedup(df, 2).collect()} == {i: want.get(i, i) for i in range(220)}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_prefixes_lose_no_similar_pair(spark, table, k):
    rng = random.Random(k)
    base = [[f"w{rng.randrange(60)}" for _ in range(n)] for n in (1, 2, 7, 30, 80, 81)]
    texts = [" ".join(t if rng.random() > 0.1 else f"v{rng.randrange(9)}" for t in rng.choice(base)) for _ in range(150)] + ["", None]
    sets = _sets(list(enumerate(texts)), k)
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "_row long, comp long, text string")
    met = [tuple(r) for r in minhash.prefix_pairs(rows, k, 80).collect()]
    assert len(met) == len(set(met)) and _similar(sets) <= set(met)
    assert minhash.prefix_pairs(rows.withColumn("comp", F.lit(1)), k, 80).isEmpty()
    assert minhash.prefix_pairs(rows.filter("_row < 0"), k, 80).isEmpty()


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


def test_substring(spark, table, odd, empty):
    first, removed = {}, collections.defaultdict(list)
    pairs = _pairs(table)
    for i, t in pairs:
        for start, end, what in substring.units(t or ""):
            if what in first:
                removed[i].append((start, end, *first[what]))
            else:
                first[what] = (i, start)
    assert sum(map(len, removed.values())) > 30
    got = {r["doc_id"]: r for r in substring.substring_dedup(table).collect()}
    for i, t in pairs:
        spans = sorted(removed[i])
        assert [tuple(s) for s in got[i]["removed"]] == spans
        rest, at = "", 0
        for a, b, _, _ in spans:
            rest, at = rest + t[at:a], b
        assert got[i]["text"] == (None if t is None else rest + t[at:])
        assert got[i]["chars_removed"] == sum(b - a for a, b, _, _ in spans) and got[i]["n_removed"] == len(spans)
    assert substring.substring_dedup(odd).count() == 7
    assert substring.substring_dedup(empty).count() == 0


def test_units_rebuild_the_text():
    text = "One two three four five six. Yes.\nNo. Short\n\nSeven eight nine ten eleven! End"
    assert "".join(m.group() for m in substring.UNIT.finditer(text)) == text
    found = {text[a:b]: what for a, b, what in substring.units(text)}
    assert " Yes.\n" in found and "No." not in found and " End" in found
    passage = "alpha beta gamma delta epsilon zeta. Eta. Theta iota kappa lambda mu nu."
    shared = {w for _, _, w in substring.units(f"Some words before it {passage} and then some more words.")} & {w for _, _, w in substring.units(f"{passage}\nElse")}
    assert "theta iota kappa lambda mu nu." in shared


def _rest(texts):
    """What the rule leaves of texts in order, without Spark."""
    seen, out = set(), []
    for t in texts:
        rest, at = "", 0
        for start, end, what in substring.units(t):
            if what in seen:
                rest, at = rest + t[at:start], end
            seen.add(what)
        out.append(rest + t[at:])
    return out


@pytest.mark.parametrize("kind", ["verse", "chinese", "chinese sentences", "thai", "japanese lines", "blob"])
def test_substring_in_short_lines_and_without_spaces(spark, kind):
    rng = random.Random(kind)
    letters = lambda low, high, n: "".join(chr(rng.randint(low, high)) for _ in range(n))
    make = {"verse": lambda: "".join(" ".join(rng.choice(VOCAB) for _ in range(rng.randint(1, 4))) + "\n" for _ in range(30)),
            "chinese": lambda: letters(0x4E00, 0x9F00, 400),
            "chinese sentences": lambda: "".join(letters(0x4E00, 0x9F00, rng.randint(4, 30)) + "。" for _ in range(20)),
            "thai": lambda: letters(0x0E01, 0x0E2E, 400),
            "japanese lines": lambda: "".join(letters(0x3041, 0x3094, rng.randint(3, 12)) + "\n" for _ in range(40)),
            "blob": lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(600))}[kind]
    passage, texts = make(), []
    for i in range(4):
        texts.append(make() + passage + make())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in substring.substring_dedup(docs).orderBy("doc_id").collect()]
    assert got == _rest(texts) and got[0] == texts[0]
    for t, g in zip(texts[1:], got[1:], strict=True):
        assert len(t) - len(g) > 0.6 * len(passage) and len(g) >= len(t) - len(passage) - 40
    assert _rest(["one two", "one two"]) == ["one two"] * 2     # under min_words


def test_no_run_of_over_fifty_words_is_left():
    """Against all windows of 51 words, whatever the sentences and lines around a run are."""
    rng = random.Random(21)
    words = [a + b + c for a in VOCAB for b in VOCAB for c in ("", "s")]
    seps = {"none": [" "], "commas": [" "] * 9 + [", "], "sentences": [" "] * 12 + [". "], "mixed": [" "] * 8 + [". ", "\n", ", "]}
    make = lambda n, sep: "".join(rng.choice(words) + rng.choice(sep) for _ in range(n))
    shared = 0
    for sep in seps.values():
        texts, runs = [], [make(rng.choice([51, 52, 60, 76, 200]), sep) for _ in range(40)]
        for _ in range(150):
            texts.append("".join(make(rng.randint(0, 40), sep) + rng.choice(runs) for _ in range(3)) + make(5, sep))
        texts.append("la " * 300)
        texts.append("so la " + "la " * 200)
        seen = set()
        for t, rest in zip(texts, _rest(texts), strict=True):
            windows = lambda x: {tuple(w[i:i + 51]) for w in [x.lower().split()] for i in range(len(w) - 50)}
            shared += bool(windows(t) & seen)
            assert not windows(rest) & seen
            seen |= windows(t)
    assert shared > 400


def test_a_cut_takes_nothing_but_long_runs():
    """A phrase that long sentences share stays; equal sentences go whole."""
    rng = random.Random(22)
    make = lambda n: " ".join(rng.choice(VOCAB) + rng.choice(VOCAB) for _ in range(n))
    phrase, sentence = make(20), make(45) + "."
    texts = [f"{make(30)} {phrase} {make(30)}." for _ in range(20)]
    assert _rest(texts) == texts
    assert _rest([f"{make(20)}. {sentence} {make(20)}." for _ in range(3)])[1].count(".") == 2


def test_packing(spark, table, odd, empty):
    lengths = (8, 16, 64, 256)
    rows = packing.best_fit_packing(table, lengths, group=40).collect()
    want = {i: len((t or "").encode().split()) + 1 for i, t in _pairs(table)}
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        bins[r["bin_group"], r["bin_no"]].append(r)
    for i, n in want.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    for members in bins.values():
        at = 0
        for r in sorted(members, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_tokens"]
        assert {r["bin_used"] for r in members} == {at} and {r["bin_size"] for r in members} == {min(x for x in lengths if x >= at)}
    assert sum(r["n_tokens"] for r in packing.best_fit_packing(odd).collect()) == 6 + 2 + 1 + 1 + 6 + 0 + 1 + 7
    assert packing.best_fit_packing(empty).count() == 0


def test_packing_counts_ids(spark, table, odd, empty, tmp_path):
    from casebook.llm.queries import QUERIES
    tok = encoder.encoder(encoder.default_vocabulary())
    pairs = [*_pairs(table), (9001, "aGVsbG8gd29ybGQ" * 4000), (9002, "日本語の文章です" * 800)]
    docs = spark.createDataFrame(pairs, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: len(tok.whole([t or ""])[0]) + 1 for i, t in pairs}
    assert want[9001] > packing.LENGTHS[-1]
    rows = QUERIES["op8_best_fit_packing"](spark, str(tmp_path)).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["start"], r["n_tokens"]))
        bins[r["bin_group"], r["bin_no"]].append(r)
    for i, n in want.items():
        at = 0
        for start, size in sorted(pieces[i]):
            assert start == at
            at += size
        assert at == n
    for members in bins.values():
        assert sum(r["n_tokens"] for r in members) == members[0]["bin_used"] <= members[0]["bin_size"]
    path = encoder.default_vocabulary()
    assert sum(r["n_tokens"] for r in packing.best_fit_packing(odd, vocabulary=path).collect()) == sum(len(tok.whole([r["text"] or ""])[0]) + 1 for r in odd.collect())
    assert packing.best_fit_packing(empty, vocabulary=path).count() == 0


def test_best_fit_takes_the_fullest_bin():
    sizes = sorted([7, 6, 5, 5, 4, 3, 3, 2, 1], reverse=True)
    bins, used = packing.best_fit(sizes, (10,), 10)
    open_ = []
    for size, got in zip(sizes, bins, strict=True):
        fits = [b for b, u in enumerate(open_) if u + size <= 10]
        if fits:
            assert open_[got] == max(open_[b] for b in fits)
            open_[got] += size
        else:
            assert got == len(open_)
            open_.append(size)
    assert open_ == used
    assert packing.pack([3, 2], (4, 8))[2] == [8]


def test_language(spark, empty):
    rng = random.Random(2)
    syl = {"aa": "ka lo mi ne".split(), "bb": "tru spo ver dla".split(), "cc": "éa ôu çi ña".split()}
    make = lambda lang: " ".join("".join(rng.choice(syl[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 80))).capitalize()
    rows = [(i, make(lang), lang if i % 10 else None) for i in range(240) for lang in [list(syl)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, per_lang=60)
    assert model.langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert np.mean([got[i]["lang_pred"] == list(syl)[i % 3] for i, _, _ in rows]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(r["rejected"] for r in got.values())
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (2, "123 !!", 0), (3, "Журнал писем и рассказов", 0), (4, "kalomi " * 30_000, 0)], "doc_id long, text string, score int")
    assert langid.predict(odd, model).columns == ["doc_id", "text", "lang_pred", "score", "entropy", "rejected"]
    rows = langid.predict(odd, model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in rows[:3]] == ["und"] * 3 and [r["rejected"] for r in rows] == [True, True, True, True, False]
    assert langid.train(empty) is None and langid.predict(empty, None).count() == 0


def _kneser_ney(texts, order):
    """Probability of a character after those before it, by dictionaries."""
    runs = ["\0" * (order - 1) + re.sub("[^a-z]+", "\0", t).strip("\0") + "\0" for t in texts]
    seen = [collections.Counter(r[i - k + 1:i + 1] for r in runs for i in range(order - 1, len(r))) for k in range(1, order + 1)]
    count = [collections.Counter(g[1:] for g in seen[k]) for k in range(1, order)] + [seen[-1]]
    floor = 1 / (len(seen[0]) + 1)

    def p(gram):
        if not gram:
            return floor
        own = count[len(gram) - 1]
        once, twice = sum(c == 1 for c in own.values()), sum(c == 2 for c in own.values())
        d = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
        after = [c for g, c in own.items() if g[:-1] == gram[:-1]]
        if not after:
            return p(gram[1:])
        return (max(own[gram] - d, 0) + d * len(after) * p(gram[1:])) / sum(after)

    return p


def test_kneser_ney_against_dictionaries(spark, monkeypatch):
    texts = ["abba cab bac abc ba", "cab, abba!", "ab", "daddy bad cab ad", "c a b"]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts * 3)], "doc_id long, text string, lang string").repartition(2)
    monkeypatch.setattr(langid.F, "pmod", lambda *_: langid.F.lit(1))        # nothing is held back
    for order in (2, 4):
        model, p = langid.train(docs, order=order), _kneser_ney(texts * 3, order)
        for text in ("abba", "bad cab d", "zab q", "ddd abba cab"):
            codes, off = langid.letter_runs(pa.array(["the text before", text]), order)
            run = "\0" * (order - 1) + text.replace(" ", "\0") + "\0"
            got = model.positions(codes)[off[1]:, 0]
            assert len(got) == len(run)
            want = [math.log(p(run[i - order + 1:i + 1])) for i in range(order - 1, len(run))]
            assert got[order - 1:].tolist() == pytest.approx(want, abs=1e-4)
        assert sum(math.exp(model.positions(np.array([*context, c], np.uint32))[-1, 0]) for context in [[97, 98, 98]] for c in [0, *map(ord, "abcdy")]) < 1


def test_language_of_a_text_beside_any_others(spark, table):
    from corpus_pipeline import language
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "substr(text, 1, 12) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(10_000 + i, "lo", None, "", 2) for i in range(6)], docs.schema))
    model = langid.train(docs)
    got = [sorted(map(tuple, langid.predict(docs.repartition(n), model).collect()), key=str) for n in (1, 7, 37)]
    assert got[0] == got[1] == got[2]
    assert len({(r[5], r[6]) for r in got[0] if r[1] == "lo"}) == 1
    kept = [sorted(map(tuple, language(spark, docs.repartition(n), "").collect()), key=str) for n in (1, 7)]
    assert kept[0] == kept[1]
    few = docs.filter("doc_id < 3").withColumn("lang", langid.F.lit("en"))
    assert all(langid.train(few.filter(f"doc_id = {i}")) is not None for i in range(3))


def test_toxicity(spark, empty):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        words = [rng.choice(VOCAB) for _ in range(rng.randint(10, 60))]
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "scum", "veju" + rng.choice(VOCAB)]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "idiot scum"), (5000, None), (5001, ""), (5001, "")], "doc_id long, text string")
    given = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (0, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs.filter("doc_id % 5 != 0"), given)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 5 == 0]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 9 == 0) for r in held]) > 0.97
    assert [r["predicted"] for r in got if r["doc_id"] is None] == [1]
    assert toxicity.train(empty, given) is None and toxicity.score(empty, None).count() == 0


def test_toxicity_sample_is_of_the_training_rows(spark):
    """Labels of documents that are not there, or have no text, do not use up the sample."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(30)) + (" idiot scum" if i % 4 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame([*rows, *[(i, None) for i in range(200, 2000)]], "doc_id long, text string")
    given = spark.createDataFrame([(i, int(i % 4 == 0 and i < 200)) for i in range(20_000)], "doc_id long, toxic int")
    model = toxicity.train(docs, given, sample=200)
    assert model is not None
    got = toxicity.score(docs.filter("doc_id < 200"), model).collect()
    assert np.mean([r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got]) > 0.95


def _least_capacity(sizes, shards):
    def fits(c):
        n, held = 1, 0
        for s in sizes:
            if s > c:
                return False
            if held + s > c:
                n, held = n + 1, 0
            held += s
        return n <= shards
    low, high = 1, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [3, 24])
def test_sharding(spark, table, odd, empty, shards, monkeypatch):
    monkeypatch.setattr(sharding, "KNOWN", 8)       # several rounds of refinement
    pairs = _pairs(table)
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    size = {i: len((t or "").encode()) + 8 for i, t in pairs}
    sizes = [sum(size[i] for i in g) for g in groups.values()]
    got = {r["doc_id"]: r for r in sharding.contiguous_shards(table, shards).collect()}
    assert {i: (r["size"], r["text_crc32"]) for i, r in got.items()} == {i: (size[i], zlib.crc32((t or "").encode())) for i, t in pairs}
    held = collections.Counter()
    for r in got.values():
        held[r["shard"]] += r["size"]
    assert max(held.values()) == _least_capacity(sizes, shards) and all(0 <= s < shards for s in held)
    order = [got[i]["shard"] for g in groups.values() for i in g]
    assert order == sorted(order) and all(len({got[i]["shard"] for i in g}) == 1 for g in groups.values())
    for s in held:
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(order.count(s)))
    assert sharding.contiguous_shards(odd, 2).count() == 7
    assert sharding.contiguous_shards(empty, 4).count() == 0


def test_minimax_cuts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "KNOWN", 16)
    rng = random.Random(9)
    for shards in (1, 5):
        sizes = [rng.choice([1, 5, 30, 400]) for _ in range(300)]
        ends = np.cumsum(sizes).tolist()
        least, cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], max(sizes), shards)
        assert least == _least_capacity(sizes, shards) and set(cuts) <= set(ends) and cuts[-1] == ends[-1]


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 3000):
        ids = rng.integers(0, 50_000 if n % 2 else 7, n).astype(np.uint32)
        m = wavelet.WaveletMatrix.build(ids)
        m = wavelet.from_bytes(wavelet.to_bytes(np.arange(3), np.array([0, 1, 0]), np.array([0, 1, n]), m))[3]
        assert m.decode().tolist() == ids.tolist()
        for i in range(0, n, 97):
            v = int(ids[i])
            assert m.access(i) == v and m.rank(v, i) == int((ids[:i] == v).sum())
            where = np.flatnonzero(ids == v).tolist()
            assert m.count(v) == len(where) and m.occurrences(v)[:5] == where[:5] and m.select(v, len(where)) == -1
        assert m.count(60_000_000) == 0


def test_token_store(spark, table, odd, empty):
    tok = encoder.encoder(encoder.default_vocabulary())
    pairs = _pairs(table)
    ids = [[*tok.whole([t or ""])[0], 2] for _, t in pairs]
    got = sorted(map(tuple, wavelet.token_store(table, shard_rows=40, file_tokens=3000).collect()))
    starts = np.cumsum([0] + [len(x) for x in ids])
    assert got == [(i, int(s), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), s, x in zip(pairs, starts, ids, strict=False)]
    rows = wavelet.token_store(odd).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (False, 2), (False, 7), (True, 0), (True, 0)]
    assert wavelet.token_store(empty).count() == 0


def test_round_trip(spark, table, empty):
    tok = encoder.encoder(encoder.default_vocabulary())
    for r in bpe.round_trip(table, chunk=32).join(table.select("doc_id", "text"), "doc_id").collect():
        ids = tok.whole([r["text"] or ""])[0]
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(tok.tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(empty).count() == 0


def test_encoder_against_the_library():
    coder, rng = encoder.Encoder(encoder.default_vocabulary()), random.Random(5)
    parts = ["a", "Z", "é", "×", " ", "  ", "\n", "\t", " ", "　", "'s", "n't", ".", ",", "!", "<|endoftext|>", "|", "1", "日本", "\x1c", "\x85", "the", " of", " ,", "İ", "ß"]
    for _ in range(15):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 60, 400]))) for _ in range(60)]
        want = [e.ids for e in coder.tok.encode_batch(texts, add_special_tokens=False)]
        for _, _, data, off in kernels.blocks(pa.array(texts)):
            for cuts in (None, bpe.chunk_cuts(data, off, 15)):
                ids, ends = coder.encode(data, off, cuts)
                assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_tables_make_room():
    t = encoder.Table(10)
    for i in range(30):
        t.add(np.array([i * 7 + 1, i * 7 + 2], np.uint64), np.array([1, 2]), np.array([i, i, i]))
        assert len(t.hash) <= 12
        found = t.find(np.array([i * 7 + 2, 3], np.uint64))
        assert found[1] == -1 and t.ids[t.start[found[0]]:][:t.size[found[0]]].tolist() == [i, i]


def test_bm25(spark, table, odd, empty, monkeypatch):
    pairs = _pairs(table)
    tf = {i: collections.Counter((t or "").encode().lower().split()) for i, t in pairs}
    df = collections.Counter(w for c in tf.values() for w in c)
    n, mean = len(tf), sum(sum(c.values()) for c in tf.values()) / len(tf)

    def score(q, d):
        dl = sum(tf[d].values())
        return sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[d][w] * 2.2 / (tf[d][w] + 1.2 * (0.25 + 0.75 * dl / mean)) for w in tf[q] if w in tf[d])

    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in bm25.top_k(table, table.filter("doc_id % 4 = 0"), 5).collect()}
    for q in (i for i in tf if i % 4 == 0):
        want = sorted((-round(s, 6), d) for d in tf if (s := score(q, d)) > 0)[:5]
        assert [got.get((q, r + 1)) for r in range(len(want))] == [(d, pytest.approx(-s, abs=2e-6)) for s, d in want]
        assert (q, len(want) + 1) not in got
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    bags = [collections.Counter((t or "").split()) for _, t in texts]
    df = collections.Counter(w for c in bags for w in c)
    n, mean = len(bags), sum(sum(c.values()) for c in bags) / len(bags)
    asked = {i: {w for j, t in texts if j == i for w in (t or "").split()} for i in (1, 2, 7)}      # a repeated id asks once for each term
    weigh = lambda q, c: sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in q if w in c)
    got = bm25.top_k(odd, odd, 3).collect()
    for q, words in asked.items():
        want = sorted((round(weigh(words, c), 6) for c in bags if weigh(words, c) > 0), reverse=True)[:3]
        assert [r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == pytest.approx(want, abs=2e-6)
    whole = sorted(map(tuple, bm25.top_k(table, table.filter("doc_id % 4 = 0"), 5).collect()))
    for name, value in (("HELD", 7), ("SHARD", 9), ("POSTINGS", 3), ("DENSE_BYTES", 4000)):
        monkeypatch.setattr(bm25, name, value)
    assert sorted(map(tuple, bm25.top_k(table, table.filter("doc_id % 4 = 0"), 5).collect())) == whole
    assert bm25.top_k(empty, empty).count() == 0 and bm25.top_k(table, empty).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(VOCAB) for _ in range(rng.randint(8, 60))) + ".", "en", "s", 1) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "s", 1) for i in range(10)]
    rows += [(200 + i, rows[i][1] + " " + rng.choice(VOCAB), "en", "s", 1) for i in range(10, 20)]
    rows += [(300, None, "en", "s", 0), (301, "12345 67", None, "s", 8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] == {r[0] for r in rows} - {300, 301}
    assert kept[1] == kept[0] - set(range(100, 110))
    sets = _sets([(r[0], r[1]) for r in rows], 5)
    near = {200 + i for i in range(10, 20) if 100 * len(sets[i] & sets[200 + i]) >= 80 * len(sets[i] | sets[200 + i])}
    assert kept[2] == kept[1] - near and kept[3] == kept[2]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[3]
    odd = [(None, rows[0][1], "en", "s", 1, "x"), (5, rows[0][1], "en", "s", 1, "x"), (5, rows[1][1], "en", "s", 1, "x"), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long, TEXT string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted([(5, rows[0][1]), (5, rows[1][1])])
    none = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).collect() == []


def test_sf_tables_match_their_sql(spark):
    import duckdb

    from casebook.llm.queries import ORACLES, QUERIES
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    for name, sql in ORACLES.items():
        got, want = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(sql).df()
        names = sorted(want.columns)
        assert sorted(got.columns) == names
        assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist())), name
