"""2.17 Collaborative filtering on ratings = lineitem ⋈ orders ⋈ part:
user = o_custkey, item = p_brand, rating = round(avg(l_quantity) / 10, 4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from casebook.operators import recommend as RC
from casebook.operators.stats import safe_corr
from casebook.operators.splits import hash_pct
from casebook.session import cut_lineage
from casebook.plans.registry import query
from casebook.plans.shaping_q import RATINGS_SQL, ratings
from casebook.plans.sqlfn import rnd
from casebook.plans.tables import t

ITEM_SHARE, USER_SHARE = 0.3, 0.4


def shared_ratings(spark, d):
    """The ratings table feeds several branches of each query (similarity,
    predictions, masks); it is computed once and checkpointed to the shared
    folder so the three-way join is not re-run per branch."""
    return cut_lineage(ratings(spark, d))


@query("reco_prepare", f"""
WITH {RATINGS_SQL},
ic AS (SELECT item, count(*) AS n FROM ratings GROUP BY 1),
r1 AS (SELECT * FROM ratings WHERE item IN (SELECT item FROM ic WHERE n > (SELECT quantile_cont(n, {ITEM_SHARE}) FROM ic))),
uc AS (SELECT usr, count(*) AS n FROM r1 GROUP BY 1)
SELECT * FROM r1 WHERE usr IN (SELECT usr FROM uc WHERE n > (SELECT quantile_cont(n, {USER_SHARE}) FROM uc))""")
def reco_prepare(spark, d):
    return RC.min_count_share_filter(ratings(spark, d), ITEM_SHARE, USER_SHARE)


#: users that recommendations are asked for
TARGETS = (1, 2, 4, 5, 7, 8, 10, 11, 13, 14)
_IN = f"IN ({', '.join(map(str, TARGETS))})"


def _targets(spark):
    return spark.createDataFrame([(u,) for u in TARGETS], "usr long")


def _pairs_sql(value: str, src: str = "ratings", more: str = "") -> str:
    return f"""{RATINGS_SQL}{more},
c AS (SELECT usr, item, {value} AS v FROM {src}),
nrm AS (SELECT usr, sqrt(sum(v * v)) AS nv FROM c GROUP BY usr),
dots AS (SELECT x.usr AS a, y.usr AS b, sum(x.v * y.v) AS dot, count(*) AS overlap
         FROM c x JOIN c y ON x.item = y.item WHERE x.usr {_IN} GROUP BY x.usr, y.usr),
sims AS (SELECT a, b, coalesce(dot / nullif(na.nv * nb.nv, 0), 0.0) AS sim, CAST(overlap AS INTEGER) AS overlap
         FROM dots JOIN nrm na ON na.usr = a JOIN nrm nb ON nb.usr = b)"""


@query("reco_user_cosine", f"""WITH {_pairs_sql("rating")} SELECT a, b, {rnd("sim", 6)} AS sim, overlap FROM sims WHERE a <> b""")
def reco_user_cosine(spark, d):
    s = RC.user_similarity(shared_ratings(spark, d), _targets(spark)).where("a != b")
    return s.select("a", "b", F.round("sim", 6).alias("sim"), "overlap")


_CENTRED = "rating - avg(rating) OVER (PARTITION BY usr)"


@query("reco_user_adjusted_cosine", f"""WITH {_pairs_sql(_CENTRED)} SELECT a, b, {rnd("sim", 4)} AS sim, overlap FROM sims WHERE a <> b""")
def reco_user_adjusted_cosine(spark, d):
    r = RC.centre(shared_ratings(spark, d), "usr", "rating", "v")
    s = RC.user_similarity(r, _targets(spark), value="v").where("a != b")
    # centred dot products cancel heavily; 4 digits keeps both engines on the same side of a rounding edge
    return s.select("a", "b", F.round("sim", 4).alias("sim"), "overlap")


def _item_sim_sql(center: str, clip: bool, src: str = "ratings") -> str:
    """Item-item cosine in SQL over all item pairs (diagonal included)."""
    items = "iitems AS (SELECT DISTINCT item FROM " + src + ")"
    if center == "zero_filled":
        base = f"""{items}, nu AS (SELECT count(DISTINCT usr) AS n FROM {src}),
sums AS (SELECT item, sum(rating) AS s, sum(rating * rating) AS ss FROM {src} GROUP BY item),
co AS (SELECT x.item AS a, y.item AS b, sum(x.rating * y.rating) AS d FROM {src} x JOIN {src} y ON x.usr = y.usr GROUP BY ALL),
dot AS (SELECT ia.item AS a, ib.item AS b, coalesce(co.d, 0) - sa.s * sb.s / n AS dot,
               (sa.ss - sa.s * sa.s / n) AS na, (sb.ss - sb.s * sb.s / n) AS nb
        FROM iitems ia CROSS JOIN iitems ib CROSS JOIN nu JOIN sums sa ON sa.item = ia.item JOIN sums sb ON sb.item = ib.item
        LEFT JOIN co ON co.a = ia.item AND co.b = ib.item)"""
    else:
        val = "rating - avg(rating) OVER (PARTITION BY item)" if center == "observed" else "rating"
        base = f"""{items}, cv AS (SELECT usr, item, {val} AS v FROM {src}),
sq AS (SELECT item, sum(v * v) AS ss FROM cv GROUP BY item),
co AS (SELECT x.item AS a, y.item AS b, sum(x.v * y.v) AS d FROM cv x JOIN cv y ON x.usr = y.usr GROUP BY ALL),
dot AS (SELECT ia.item AS a, ib.item AS b, coalesce(co.d, 0) AS dot, sa.ss AS na, sb.ss AS nb
        FROM iitems ia CROSS JOIN iitems ib JOIN sq sa ON sa.item = ia.item JOIN sq sb ON sb.item = ib.item
        LEFT JOIN co ON co.a = ia.item AND co.b = ib.item)"""
    sim = "coalesce(dot / nullif(sqrt(na * nb), 0), 0.0)"
    if clip:
        sim = f"greatest({sim}, 0.0)"
    return f"{base}, isim AS (SELECT a, b, {sim} AS sim FROM dot)"


@query("reco_item_similarity", f"""WITH {RATINGS_SQL}, {_item_sim_sql("zero_filled", False)}
SELECT a, b, {rnd("sim", 6)} AS sim FROM isim""")
def reco_item_similarity(spark, d):
    s = RC.item_similarity(shared_ratings(spark, d), center="zero_filled")
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


@query("reco_clip_negative", f"""WITH {RATINGS_SQL}, {_item_sim_sql("observed", True)}
SELECT a, b, {rnd("sim", 6)} AS sim FROM isim""")
def reco_clip_negative(spark, d):
    s = RC.item_similarity(shared_ratings(spark, d), center="observed", clip=True)
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


_USER_PRED_SQL = f"""{_pairs_sql(_CENTRED)},
upred AS (SELECT a AS usr, item, sum(greatest(sim, 0.0) * rating) AS score FROM sims JOIN ratings ON ratings.usr = b GROUP BY ALL)"""


def _user_pred(spark, d):
    r = shared_ratings(spark, d)
    sims = RC.user_similarity(RC.centre(r, "usr", "rating", "v"), _targets(spark), value="v", clip=True)
    return RC.predict_user_based(sims, r)


@query("reco_predict_user_based", f"""WITH {_USER_PRED_SQL} SELECT usr, item, {rnd("score", 6)} AS score FROM upred""")
def reco_predict_user_based(spark, d):
    return _user_pred(spark, d).select("usr", "item", F.round("score", 6).alias("score"))


_ITEM_PRED_SQL = f"""{RATINGS_SQL}, {_item_sim_sql("zero_filled", True)},
ipred AS (SELECT usr, isim.b AS item, sum(rating * sim) AS score FROM ratings JOIN isim ON ratings.item = isim.a GROUP BY ALL)"""


def _item_pred(spark, d, r=None):
    r = shared_ratings(spark, d) if r is None else r
    sim = RC.item_similarity(r, center="zero_filled", clip=True)
    return RC.predict_item_based(r, sim)


@query("reco_predict_item_based", f"""WITH {_ITEM_PRED_SQL} SELECT usr, item, {rnd("score", 6)} AS score FROM ipred""")
def reco_predict_item_based(spark, d):
    return _item_pred(spark, d).select("usr", "item", F.round("score", 6).alias("score"))


@query("reco_mask_seen", f"""WITH {_ITEM_PRED_SQL}
SELECT usr, item, {rnd("score", 6)} AS score FROM ipred
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.usr = ipred.usr AND r.item = ipred.item)""")
def reco_mask_seen(spark, d):
    r = shared_ratings(spark, d)
    s = RC.mask_seen(_item_pred(spark, d, r), r, "unseen")
    return s.select("usr", "item", F.round("score", 6).alias("score"))


@query("reco_topn", f"""WITH {_ITEM_PRED_SQL},
un AS (SELECT * FROM ipred WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.usr = ipred.usr AND r.item = ipred.item)),
rk AS (SELECT usr, item, {rnd("score", 6)} AS score, CAST(row_number() OVER (PARTITION BY usr ORDER BY round(score, 6) DESC, item) AS INTEGER) AS rank FROM un)
SELECT * FROM rk WHERE rank <= 5""")
def reco_topn(spark, d):
    r = shared_ratings(spark, d)
    return RC.top_unseen(r, RC.item_similarity(r, center="zero_filled", clip=True), 5, digits=6)


@query("reco_topn_suppliers", f"""
WITH ratings AS (SELECT o_custkey AS usr, l_suppkey AS item, {rnd("avg(l_quantity) / 10", 4)} AS rating
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey), {_item_sim_sql("zero_filled", True)},
un AS (SELECT usr, isim.b AS item, {rnd("sum(rating * sim)", 6)} AS score FROM ratings r JOIN isim ON r.item = isim.a
       WHERE NOT EXISTS (SELECT 1 FROM ratings q WHERE q.usr = r.usr AND q.item = isim.b) GROUP BY ALL),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY usr ORDER BY score DESC, item) AS INTEGER) AS rank FROM un)
SELECT * FROM rk WHERE rank <= 5""")
def reco_topn_suppliers(spark, d):
    """The five best new suppliers of every customer: neighbour lists longer than a round reads, so some users go on."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    r = cut_lineage(li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("usr"), F.col("l_suppkey").alias("item"))
                    .agg(F.round(F.avg("l_quantity") / 10, 4).alias("rating")))
    return RC.top_unseen(r, RC.item_similarity(r, center="zero_filled", clip=True), 5, digits=6)


@query("reco_item_neighbours", f"""
WITH ratings AS (SELECT o_custkey AS usr, l_partkey AS item, {rnd("avg(l_quantity) / 10", 4)} AS rating
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey),
nrm AS (SELECT item, sqrt(sum(rating * rating)) AS n FROM ratings GROUP BY item),
dots AS (SELECT x.item AS a, y.item AS b, sum(x.rating * y.rating) AS d FROM ratings x JOIN ratings y ON x.usr = y.usr AND x.item < y.item GROUP BY ALL)
SELECT a, b, {rnd("d / (na.n * nb.n)", 6)} AS sim FROM dots JOIN nrm na ON na.item = a JOIN nrm nb ON nb.item = b WHERE d / (na.n * nb.n) >= 0.2""")
def reco_item_neighbours(spark, d):
    """Pairs of parts with a cosine of at least 0.2 over the customers that bought them."""
    li, o = t(spark, d, "lineitem"), t(spark, d, "orders")
    r = li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("usr"), F.col("l_partkey").alias("item")) \
          .agg(F.round(F.avg("l_quantity") / 10, 4).alias("rating"))
    return RC.item_similarity(r, least=0.2, prefix=True).where("a < b").select("a", "b", F.round("sim", 6).alias("sim"))


_SPLIT = "('0x' || substr(md5(CAST(usr AS VARCHAR) || '|' || item), 1, 8))::BIGINT % 100"


_FOLDS = f"train AS (SELECT * FROM ratings WHERE {_SPLIT} >= 30), test AS (SELECT * FROM ratings WHERE {_SPLIT} < 30)"
_RMSE_SQL = f"""pairs AS (SELECT pred.usr, pred.item, score, test.rating FROM pred JOIN test USING (usr, item) WHERE score > 0),
mm AS (SELECT item, min(score) AS mn, max(score) AS mx FROM pairs GROUP BY item),
sc AS (SELECT rating, CASE WHEN mx = mn THEN 1.0 ELSE (score - mn) / (mx - mn) * 4.0 + 1.0 END AS s FROM pairs JOIN mm USING (item))
SELECT {rnd("sqrt(avg((rating - s) ^ 2))", 6)} AS rmse, count(*) AS n_pairs FROM sc"""


def _folds(spark, d):
    r = shared_ratings(spark, d)
    h = hash_pct(F.concat(F.col("usr").cast("string"), F.lit("|"), F.col("item")))
    return r.where(h >= 30), r.where(h < 30)


@query("reco_scaled_rmse", f"""WITH {RATINGS_SQL},
{_FOLDS},
{_item_sim_sql("zero_filled", True, "train")},
pred AS (SELECT usr, isim.b AS item, sum(rating * sim) AS score FROM train JOIN isim ON train.item = isim.a GROUP BY ALL),
{_RMSE_SQL}""")
def reco_scaled_rmse(spark, d):
    train, test = _folds(spark, d)
    pred = _item_pred(spark, d, train)          # similarity from train (not from test)
    return RC.scaled_rmse(pred, test, 1.0, 5.0)


@query("reco_scaled_rmse_test_similarity", f"""WITH {RATINGS_SQL},
{_FOLDS},
{_item_sim_sql("zero_filled", True, "test")},
pred AS (SELECT test.usr, isim.b AS item, sum(rating * sim) AS score FROM test JOIN isim ON test.item = isim.a GROUP BY ALL),
{_RMSE_SQL}""")
def reco_scaled_rmse_test_similarity(spark, d):
    """The evaluation that takes similarities and scores from the test ratings themselves, so that each rating has a
    part in its own score: a comparison figure, not an error on unseen ratings."""
    _, test = _folds(spark, d)
    return RC.scaled_rmse(_item_pred(spark, d, test), test, 1.0, 5.0)


@query("reco_profile_similarity", f"""WITH {_USER_PRED_SQL},
top AS (SELECT usr, round(score, 6) AS s, row_number() OVER (PARTITION BY usr ORDER BY round(score, 6) DESC, item) AS rk FROM upred),
ten AS (SELECT * FROM top WHERE rk <= 10)
SELECT x.usr AS a, y.usr AS b, {rnd("corr(x.s, y.s)", 6)} AS top10_corr FROM ten x JOIN ten y ON x.rk = y.rk AND x.usr < y.usr
GROUP BY x.usr, y.usr""")
def reco_profile_similarity(spark, d):
    """The listed users among each other, by their ten best scores."""
    ten = cut_lineage(RC.topn(_user_pred(spark, d).withColumn("score", F.round("score", 6)), 10))
    x = ten.select(F.col("usr").alias("a"), "rank", F.col("score").alias("sa"))
    y = ten.select(F.col("usr").alias("b"), "rank", F.col("score").alias("sb"))
    return x.join(y, "rank").where("a < b").groupBy("a", "b").agg(F.round(safe_corr("sa", "sb"), 6).alias("top10_corr"))


@query("reco_scaled_rmse_user_based", f"""WITH {_pairs_sql(_CENTRED, "train", ", " + _FOLDS)},
pred AS (SELECT a AS usr, item, sum(greatest(sim, 0.0) * rating) AS score FROM sims JOIN train ON train.usr = b GROUP BY ALL),
{_RMSE_SQL}""")
def reco_scaled_rmse_user_based(spark, d):
    """The user-based model on the test ratings of the listed users."""
    train, test = _folds(spark, d)
    sims = RC.user_similarity(RC.centre(train, "usr", "rating", "v"), _targets(spark), value="v", clip=True)
    return RC.scaled_rmse(RC.predict_user_based(sims, train), test, 1.0, 5.0)


#: items that are compared with each other
ITEMS = tuple(f"Brand#{i}" for i in range(1, 11))


@query("reco_item_profile_similarity", f"""WITH {_ITEM_PRED_SQL},
top AS (SELECT item, round(score, 6) AS s, row_number() OVER (PARTITION BY item ORDER BY round(score, 6) DESC, usr) AS rk FROM ipred
        WHERE item IN {ITEMS}),
ten AS (SELECT * FROM top WHERE rk <= 10)
SELECT x.item AS a, y.item AS b, {rnd("corr(x.s, y.s)", 6)} AS top10_corr FROM ten x JOIN ten y ON x.rk = y.rk AND x.item < y.item
GROUP BY x.item, y.item""")
def reco_item_profile_similarity(spark, d):
    """The listed items among each other, by their ten best scores."""
    scores = _item_pred(spark, d).where(F.col("item").isin(*ITEMS)).withColumn("score", F.round("score", 6))
    ten = cut_lineage(RC.topn(scores, 10, user="item", item="usr"))
    x = ten.select(F.col("item").alias("a"), "rank", F.col("score").alias("sa"))
    y = ten.select(F.col("item").alias("b"), "rank", F.col("score").alias("sb"))
    return x.join(y, "rank").where("a < b").groupBy("a", "b").agg(F.round(safe_corr("sa", "sb"), 6).alias("top10_corr"))


@query("reco_recommend_targets", f"""WITH {_USER_PRED_SQL}, {_item_sim_sql("zero_filled", True)},
ipred AS (SELECT usr, isim.b AS item, sum(rating * sim) AS score FROM ratings JOIN isim ON ratings.item = isim.a WHERE usr {_IN} GROUP BY ALL),
p AS (SELECT 'user' AS model, * FROM upred UNION ALL SELECT 'item', * FROM ipred),
un AS (SELECT model, usr, item, {rnd("score", 6)} AS score FROM p
       WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.usr = p.usr AND r.item = p.item)),
rk AS (SELECT *, CAST(row_number() OVER (PARTITION BY model, usr ORDER BY score DESC, item) AS INTEGER) AS rank FROM un)
SELECT * FROM rk WHERE rank <= 5""")
def reco_recommend_targets(spark, d):
    """The five best unseen items of each listed user, by both models."""
    r = shared_ratings(spark, d)
    mine = r.join(_targets(spark), "usr", "left_semi")
    sims = RC.user_similarity(RC.centre(r, "usr", "rating", "v"), _targets(spark), value="v", clip=True)
    by_user = RC.predict_user_based(sims, r)
    by_item = RC.predict_item_based(mine, RC.item_similarity(r, center="zero_filled", clip=True))
    best = lambda s, m: RC.topn(RC.mask_seen(s, mine).withColumn("score", F.round("score", 6)), 5) \
        .select(F.lit(m).alias("model"), "usr", "item", "score", "rank")
    return best(by_user, "user").unionByName(best(by_item, "item"))
