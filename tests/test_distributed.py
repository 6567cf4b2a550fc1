"""Bucketed global-order helpers, splits, curves and similarities against brute force."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from casebook.operators import evaluation as EV
from casebook.operators import recommend as RC
from casebook.operators.prefix import scan
from casebook.operators.splits import split_hash, split_stratified


@pytest.mark.parametrize("parts", [1, 7, None])
def test_scan_matches_windows(spark, parts):
    rng = np.random.default_rng(0)
    rows = [(i, int(g) if g < 3 else None, float(x) if x > -1.5 else None, "s" * int(g)) for i, (g, x) in enumerate(zip(rng.integers(0, 4, 600), rng.normal(size=600)))]
    df = spark.createDataFrame(rows, "id long, g int, x double, s string").withColumn("one", F.lit(1)).repartition(5)
    got = scan(df, [F.col("x").desc()], {"one": "rank", "x": "sum"}, {"x": "px", "s": "ps", "id": "pid"}, ["g"], {"one": "n", "x": "all"}, parts)
    assert got.columns == ["id", "g", "x", "s", "one", "rank", "sum", "px", "ps", "pid", "n", "all"]
    w = Window.partitionBy("g").orderBy(F.col("x").desc(), "id")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.row_number().over(w).alias("rank"), F.coalesce(F.sum("x").over(run), F.lit(0.0)).alias("sum"), F.lag("x").over(w).alias("px"),
                     F.lag("s").over(w).alias("ps"), F.lag("id").over(w).alias("pid"), F.count("*").over(Window.partitionBy("g")).alias("n"),
                     F.sum("x").over(Window.partitionBy("g")).alias("all"))
    key = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(map(key, got.collect()), key=str) == sorted(map(key, want.collect()), key=str)


def test_scan_splits_two_distinct_keys(spark):
    """Equal order keys are spread over tasks, and no window sees raw rows."""
    df = spark.range(20_000).select("id", (F.col("id") % 2).alias("k"), F.lit(1).alias("one"))
    got = scan(df, [F.col("k")], {"one": "rank"}, {"id": "before"}, parts=8)
    local = [f for f in got.inputFiles() if "scan" in f]
    sizes = [r["count"] for r in spark.read.parquet(*local).groupBy("_part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 20_000 / 8
    rows = sorted(got.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 20_001)) and [r["k"] for r in rows] == [0] * 10_000 + [1] * 10_000
    assert [r["before"] for r in rows] == [None, *[r["id"] for r in rows[:-1]]]


def test_scan_of_equal_rows_and_empty_frames(spark):
    same = spark.createDataFrame([(1, 2)] * 50, "k int, v int")
    assert sorted(r["s"] for r in scan(same, [F.col("k")], {"v": "s"}, parts=4).collect()) == list(range(2, 102, 2))
    assert scan(same.limit(0), [F.col("k")], {"v": "s"}, {"v": "p"}, ["k"], {"v": "t"}).collect() == []
    odd = spark.createDataFrame([(1, float("nan")), (2, 1.5), (3, None), (4, 2.0)], "k int, v double")
    assert [r["s"] for r in scan(odd, [F.col("k")], {"v": "s"}, parts=2).orderBy("k").collect()] == [0.0, 1.5, 1.5, 3.5]


def test_hash_split_is_reproducible(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a_tr, a_te = split_hash(df, "k", 30)
    b_tr, b_te = split_hash(df.repartition(7), "k", 30)
    assert sorted(r[0] for r in a_te.collect()) == sorted(r[0] for r in b_te.collect())
    assert a_tr.count() + a_te.count() == 1000


def test_stratified_split_exact_counts(spark):
    df = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "k long, y int")
    train, test = split_stratified(df, "k", "y", 0.3, parts=8)
    counts = {r["y"]: r["count"] for r in test.groupBy("y").count().collect()}
    assert counts == {1: 30, 0: 90}
    assert train.count() + test.count() == 400


SCORES8 = [(1, 0.9), (1, 0.8), (0, 0.8), (1, 0.6), (0, 0.55), (0, 0.3), (1, 0.3), (0, 0.1)]


def _brute_auc(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def test_auc_and_roc_against_brute_force(spark):
    df = spark.createDataFrame(SCORES8, "y int, s double")
    assert EV.auc(df, "y", "s", parts=3).first()["auc"] == pytest.approx(_brute_auc(SCORES8))
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in EV.roc_curve(df, "y", "s", parts=3).collect()}
    for th, (fpr, tpr) in roc.items():
        tp = sum(1 for y, s in SCORES8 if y == 1 and s >= th)
        fp = sum(1 for y, s in SCORES8 if y == 0 and s >= th)
        assert (fpr, tpr) == (round(fp / 4, 6), round(tp / 4, 6))
    perfect = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "y int, s double")
    assert EV.auc(perfect, "y", "s").first()["auc"] == 1.0
    const = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.5), (0, 0.5)], "y int, s double")
    assert EV.auc(const, "y", "s").first()["auc"] == 0.5


def test_confusion_identities(spark):
    df = spark.createDataFrame(SCORES8, "y int, s double").withColumn("p", EV.predict_label("s", 0.5))
    c = EV.confusion(df, "y", "p").first()
    assert c["tp"] + c["fn"] == 4 and c["tn"] + c["fp"] == 4
    tab = {r["cutoff"]: r for r in EV.cutoff_table(df, "y", "s", [0.0, 0.5]).collect()}
    assert (tab[0.5]["tp"], tab[0.5]["fp"]) == (c["tp"], c["fp"])


RATINGS4 = [(1, "i1", 5.0), (1, "i2", 3.0), (1, "i3", 4.0), (2, "i1", 4.0), (2, "i2", 2.0),
            (3, "i3", 1.0), (4, "i1", 3.0), (4, "i2", 3.0), (4, "i3", 3.0)]
ITEMS = ["i1", "i2", "i3"]


def _dense(rows):
    users = sorted({u for u, _, _ in rows})
    m = np.zeros((len(users), len(ITEMS)))
    for u, i, r in rows:
        m[users.index(u), ITEMS.index(i)] = r
    return users, m


def _cos(m):
    n = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
    return u @ u.T


@pytest.mark.parametrize("key", ["long", "string"])
def test_user_similarity_and_prediction_vs_numpy(spark, key):
    df = spark.createDataFrame(RATINGS4, "usr long, item string, rating double").withColumn("usr", F.col("usr").cast(key))
    users, m = _dense(RATINGS4)
    S = _cos(m)
    targets = df.select("usr").distinct()
    sims = RC.user_similarity(df, targets, clip=True)
    got = {(int(r["a"]), int(r["b"])): r["sim"] for r in sims.collect()}
    for (a, b), v in got.items():
        assert v == pytest.approx(max(S[users.index(a), users.index(b)], 0))
    shared = {(a, b) for a in users for b in users if (m[users.index(a)] * m[users.index(b)]).any()}
    assert set(got) == shared                          # every pair with a common item, no item list
    P = np.maximum(S, 0) @ m
    pred = {(int(r["usr"]), r["item"]): r["score"] for r in RC.predict_user_based(sims, df).collect()}
    for u in users:
        for i in ITEMS:
            assert pred.get((u, i), 0.0) == pytest.approx(P[users.index(u), ITEMS.index(i)])


@pytest.mark.parametrize("center", [None, "observed", "zero_filled"])
def test_item_similarity_vs_numpy(spark, center):
    df = spark.createDataFrame(RATINGS4, "usr long, item string, rating double")
    users, m = _dense(RATINGS4)
    if center == "zero_filled":
        m = m - m.mean(axis=0)
    elif center == "observed":
        mask = m > 0
        means = m.sum(axis=0) / mask.sum(axis=0)
        m = np.where(mask, m - means, 0.0)
    S = _cos(m.T)
    got = {(r["a"], r["b"]): r["sim"] for r in RC.item_similarity(df, ITEMS, center=center).collect()}
    assert len(got) == 9
    for (a, b), v in got.items():
        assert v == pytest.approx(S[ITEMS.index(a), ITEMS.index(b)], abs=1e-9)


def test_item_similarity_reads_items_from_the_data(spark):
    df = spark.createDataFrame(RATINGS4, "usr long, item string, rating double")
    listed = {(r["a"], r["b"]): r["sim"] for r in RC.item_similarity(df, ITEMS).collect()}
    found = {(r["a"], r["b"]): r["sim"] for r in RC.item_similarity(df).collect()}
    assert found == pytest.approx({k: v for k, v in listed.items() if v}) and len(found) > len(ITEMS)
    more = df.unionByName(spark.createDataFrame([(1, "new", 4.0), (2, "new", 2.0)], df.schema))
    grown = {(r["a"], r["b"]) for r in RC.item_similarity(more).collect()}
    assert ("new", "new") in grown and set(found) < grown
    twice = {(r["a"], r["b"]) for r in RC.item_similarity(more, min_overlap=3).collect()}
    assert ("new", "new") not in twice


def test_uncorated_items_of_zero_filled_centring(spark, monkeypatch):
    rows = [(1, "i1", 5.0), (2, "i2", 4.0), (3, "i3", 2.0), (3, "i1", 1.0), (4, "i4", 3.0)]
    df = spark.createDataFrame(rows, "usr long, item string, rating double")
    names = ["i1", "i2", "i3", "i4"]
    m = np.zeros((4, 4))
    for u, i, r in rows:
        m[u - 1, names.index(i)] = r
    S = _cos((m - m.mean(axis=0)).T)
    got = {(r["a"], r["b"]): r["sim"] for r in RC.item_similarity(df, center="zero_filled").collect()}
    assert got == pytest.approx({(a, b): S[i, j] for i, a in enumerate(names) for j, b in enumerate(names)}) and got["i1", "i2"] < 0
    some = {(r["a"], r["b"]): r["sim"] for r in RC.item_similarity(df, center="zero_filled", least=0.1).collect()}
    assert some == pytest.approx({k: v for k, v in got.items() if v >= 0.1})
    monkeypatch.setattr(RC, "ALL_PAIRS", 3)
    with pytest.raises(ValueError, match="4 items"):
        RC.item_similarity(df, center="zero_filled")
    assert {(r["a"], r["b"]) for r in RC.item_similarity(df, center="zero_filled", clip=True).where("sim > 0").collect()} == {k for k, v in got.items() if v > 0}


def test_item_scores_beyond_the_broadcast_bound(spark, monkeypatch):
    df = spark.createDataFrame(RATINGS4, "usr long, item string, rating double")
    sim = RC.item_similarity(df)
    score = lambda: {(r["usr"], r["item"]): r["score"] for r in RC.predict_item_based(df, sim).collect()}
    sent = score()
    monkeypatch.setattr(RC, "BROADCAST_ROWS", 0)
    assert score() == pytest.approx(sent)


def _taste(spark, users=300, groups=40, size=30, own=10, others=1, seed=3):
    """Users rate ten items of their own group of thirty and one of any other."""
    rng = np.random.default_rng(seed)
    rows = []
    for u in range(users):
        mine = (u % groups) * size + rng.choice(size, own, replace=False)
        rows += [(u, int(i), float(rng.integers(1, 6))) for i in {*mine.tolist(), *rng.choice(groups * size, others).tolist()}]
    return spark.createDataFrame(rows, "usr long, item long, rating double")


def _all_scores(df, sim, n, digits=None):
    s = RC.mask_seen(RC.predict_item_based(df, sim), df)
    return RC.topn(s if digits is None else s.withColumn("score", F.round("score", digits)), n)


def _ranked(rows):
    return {(r["usr"], r["rank"]): (r["item"], round(r["score"], 7)) for r in rows.collect()}


def test_top_unseen_scores_few_pairs(spark):
    df = _taste(spark)
    sim = RC.item_similarity(df).cache()
    want = _ranked(_all_scores(df, sim, 3, 6))
    assert len(want) == 900 and _ranked(RC.top_unseen(df, sim, 3, digits=6, depth=16)) == want
    cells, pairs = df.withColumnRenamed("rating", "_v"), sim.withColumnRenamed("a", "item")
    scored = RC._candidates(cells, df.select("usr", "item"), pairs, 3, 1e-6, 16, "usr", "item").count()
    every = RC.mask_seen(RC.predict_item_based(df, sim), df).count()
    assert scored < every / 3 and scored < 300 * 1200 / 50      # users x neighbours, users x items


@pytest.mark.parametrize("center,depth,n", [(None, 2, 4), ("zero_filled", 2, 4), ("zero_filled", 500, 60)])
def test_top_unseen_of_any_sign_and_ties(spark, center, depth, n):
    df = _taste(spark, users=40, groups=4, size=12, own=6, others=2, seed=5)
    df = df.withColumn("rating", F.when(F.col("item") % 5 == 0, -F.col("rating")).otherwise(F.col("rating")))
    sim = RC.item_similarity(df, center=center).cache()
    if center is None:
        sim = sim.withColumn("sim", F.round("sim", 1))            # many ties
        df = df.withColumn("rating", F.signum("rating"))
    assert _ranked(RC.top_unseen(df, sim, n, digits=4, depth=depth)) == _ranked(_all_scores(df, sim, n, 4))


@pytest.mark.parametrize("center,least", [(None, 0.5), ("observed", 0.3), ("zero_filled", 0.45)])
def test_prefix_index_finds_all_similar_pairs(spark, center, least):
    """Ten users who rated all items: the index meets few pairs, the result is that of the full join."""
    df = _taste(spark, users=120, groups=20, size=10, own=5, others=0)
    items = df.select("item").distinct()
    hot = spark.range(1000, 1010).withColumnRenamed("id", "usr").join(items, how="cross").withColumn("rating", (F.hash("usr", "item") % 2 + 3) / 4.0)
    df = df.unionByName(hot)
    rows = lambda **more: {(r["a"], r["b"]): round(r["sim"], 9) for r in RC.item_similarity(df, center=center, least=least, **more).collect()}
    want = rows()
    assert len(want) > items.count() + 20 and rows(prefix=True) == want
    if center is None:
        cells = df.withColumnRenamed("rating", "_v")
        met = RC._prefix_pairs(cells, cells.groupBy("item").agg(F.sum(F.col("_v") ** 2).alias("_q")), least, 1.0, "usr", "item").count()
        assert met < items.count() ** 2 / 8


def test_prefix_index_edges(spark):
    df = _taste(spark, users=4, groups=2, size=12)
    assert RC.item_similarity(df.limit(0), least=0.5, prefix=True).collect() == []
    for bad in ({}, {"least": 0.0}, {"least": 0.5, "items": [1, 2]}):
        with pytest.raises(ValueError):
            RC.item_similarity(df, prefix=True, **bad)
    with pytest.raises(ValueError):
        RC.item_similarity(df.withColumn("rating", -F.col("rating")), center="zero_filled", least=0.5, prefix=True)


@pytest.mark.parametrize("key", ["long", "string"])
def test_flat_lists_are_scored_in_tiles(spark, monkeypatch, key):
    """After the first round users with flat lists are scored in several tiles, a few users at a time, with ties."""
    df = _taste(spark, users=60, groups=2, size=20, own=6, others=3, seed=9)
    df = df.withColumn("rating", F.when(F.col("item") % 5 == 0, -F.col("rating")).otherwise(F.col("rating")))
    df = df.select(F.col("usr").cast(key), F.col("item").cast(key), "rating")
    df = df.unionByName(df.where(F.col("usr").cast("int") < 9).select("usr", F.lit("7").cast(key).alias("item"), F.lit(None).cast("double").alias("rating")))
    sim = RC.item_similarity(df.where("rating is not null"), center="zero_filled").withColumn("sim", F.round("sim", 1)).cache()
    want = _ranked(_all_scores(df, sim, 4, 4))
    for name, value in {"BROADCAST_ROWS": 0, "TILE_RATINGS": 100, "TILE_PAIRS": 300, "TILE_GAIN": 0, "TILE": 64}.items():
        monkeypatch.setattr(RC, name, value)
    names = []
    monkeypatch.setattr(RC, "stored", lambda frame, name, keep=RC.stored: names.append(name) or keep(frame, name))
    assert _ranked(RC.top_unseen(df, sim, 4, digits=4, depth=2)) == want
    assert names.count("top-pairs") == 1


@pytest.mark.parametrize("positive", [True, False])
def test_flat_lists_form_no_round_and_tiles_are_scored_once(spark, monkeypatch, positive):
    """Where tiles are less work than the rows of one round, no round is formed, and the tiles are not scored again."""
    df = _taste(spark, users=60, groups=2, size=20, own=6, others=3, seed=9)
    sim = RC.item_similarity(df, center=None if positive else "zero_filled", clip=not positive).withColumn("sim", F.round("sim", 1))
    sim = sim.where("sim > 0" if positive else "true").cache()
    want = _ranked(_all_scores(df, sim, 4, 4))
    monkeypatch.setattr(RC, "BROADCAST_ROWS", 0)
    names = []
    monkeypatch.setattr(RC, "stored", lambda frame, name, keep=RC.stored: names.append(name) or keep(frame, name))
    assert _ranked(RC.top_unseen(df, sim, 4, digits=4, depth=16)) == want
    assert names == ["top-tiles"]


def test_index_that_spares_nothing_is_not_looked_up(spark, monkeypatch):
    df = _taste(spark, users=60, groups=2, size=20, own=6, others=3, seed=9)
    rows = lambda **more: {(r["a"], r["b"]): round(r["sim"], 9) for r in RC.item_similarity(df, least=0.1, **more).collect()}
    monkeypatch.setattr(RC, "_index_pairs", None)
    assert rows(prefix=True) == rows()


def test_few_items_do_not_deal_the_ratings(spark, monkeypatch):
    df = _taste(spark, users=40, groups=4, size=12, own=6, others=2, seed=5)
    seen = {}
    monkeypatch.setattr(RC, "stored", lambda frame, name, keep=RC.stored: seen.setdefault(name, frame._jdf.queryExecution().optimizedPlan().toString()) and keep(frame, name))
    RC.top_unseen(df, RC.item_similarity(df), 3, digits=6, depth=2)
    assert seen["top-pairs"].count("strategy=broadcast") >= 2


def test_top_unseen_edges(spark):
    df = spark.createDataFrame([("u", "a", 2.0), ("u", "a", 3.0), ("u", "c", None), ("u", "d", float("nan")), (None, "a", 1.0), ("v", None, 1.0),
                                ("w", "z", 4.0)], "usr string, item string, rating double").withColumn("b", F.lit(1)).withColumn("score", F.lit(2))
    sim = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5), ("a", "c", 0.9), ("a", "d", 0.8), ("a", "e", None), ("c", "b", 0.7), ("a", "f", float("nan"))],
                                "a string, b string, sim double")
    got = [tuple(r) for r in RC.top_unseen(df, sim, 5, depth=1).select("usr", "item", "score", "rank").collect()]
    assert got == [("u", "b", 2.5, 1)]
    assert RC.top_unseen(df.limit(0), sim, 5).collect() == [] and RC.top_unseen(df, sim.limit(0), 5).collect() == []


def test_targeted_scoring_equals_full_restricted(spark):
    df = spark.createDataFrame(RATINGS4, "usr long, item string, rating double")
    targets = spark.createDataFrame([(1,), (3,)], "usr long")
    full = RC.predict_user_based(RC.user_similarity(df, df.select("usr")), df)
    part = RC.predict_user_based(RC.user_similarity(df, targets), df)
    full = {(r["usr"], r["item"]): r["score"] for r in full.collect() if r["usr"] in (1, 3)}
    part = {(r["usr"], r["item"]): r["score"] for r in part.collect()}
    assert set(part) == set(full)
    for k, v in part.items():
        assert v == pytest.approx(full[k])


def test_statistics_of_constant_and_collinear_columns(spark):
    from casebook.operators import aggregates as A, evaluation as EV, stats as ST
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 3))
    df = spark.createDataFrame([(float(a), float(b), float(2 * b), float(c), 1.0) for a, b, c in x], "a double, b double, b2 double, c double, one double")
    corr = {(r["a"], r["b"]): r["corr"] for r in ST.corr_long(df, ["a", "b", "one"]).collect()}
    assert corr["a", "one"] is None and corr["a", "b"] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1], abs=1e-6)
    vif = {r["feature"]: r["vif"] for r in ST.vif(df, ["a", "b", "b2", "c"]).collect()}
    assert vif["b"] == vif["b2"] == float("inf") and 1 <= vif["a"] < 1.2 and 1 <= vif["c"] < 1.2
    plain = {r["feature"]: r["vif"] for r in ST.vif(df, ["a", "b", "c"], intercept=False).collect()}
    m = x.T @ x
    d = np.sqrt(np.diag(m))
    want = np.diag(np.linalg.inv(m / np.outer(d, d)))
    assert [plain[c] for c in "abc"] == pytest.approx(list(want), abs=1e-5)
    assert EV.r2_score(df, "one", "a").first()["r2"] is None
    p = spark.createDataFrame([("g", "x"), ("g", "y"), ("g", "z"), ("h", "x")], "k string, v string")
    got = {r["k"]: (r["x"], r["y"]) for r in A.pivot_row_percent(p, ["k"], "v", ["x", "y"]).collect()}
    assert got == {"g": (33.3, 33.3), "h": (100.0, None)}


def test_partitioned_write_splits_a_hot_value(spark, tmp_path):
    from casebook.sources.sinks import write_partitioned
    df = spark.range(300_000, numPartitions=6).select(F.lit(7).alias("k"), "id", F.sha2(F.col("id").cast("string"), 256).alias("s"))
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        write_partitioned(df, f"{tmp_path}/t", ["k"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    back = spark.read.orc(f"{tmp_path}/t")
    assert back.count() == 300_000 and len(back.inputFiles()) > 1
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_latin1_write_refuses_other_characters(spark, tmp_path):
    from casebook.sources.sinks import write_csv
    write_csv(spark.createDataFrame([("é",)], "s string"), f"{tmp_path}/a", encoding="ISO-8859-1")
    assert spark.read.csv(f"{tmp_path}/a", header=True, encoding="ISO-8859-1").first()["s"] == "é"
    with pytest.raises(Exception, match="(?i)charac"):
        write_csv(spark.createDataFrame([("日",)], "s string"), f"{tmp_path}/b", encoding="ISO-8859-1")
