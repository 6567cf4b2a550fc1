"""Neighbourhood collaborative filtering on long ratings (user, item, rating).

Two shapes of work:

* **item × item**: each user's ratings meet each other once (a < b), and a grouped
  sum per pair of items, combined map-side, gives the dot products. Only pairs
  that some user rated exist, keys have any type, and the items come from the data.
* **user × user** (users are many): the feature is a list of target users. Their
  ratings join all ratings on the item, a grouped sum per (target, user) gives the
  dot products, and a second join with the ratings gives the scores. Nothing is
  formed for pairs without a target.

NULL / NaN rules: a user or item with a zero norm has similarity 0 with every
other one; the self-similarity (1) is kept.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casebook.operators.prefix import scan
from casebook.session import cut_lineage, stored

BROADCAST_ROWS = 200_000    # item pairs that every task may hold
ALL_PAIRS = 5_000           # items of which every pair may be a row
TILE_RATINGS, TILE_PAIRS = 500_000, 500_000     # ratings and similarities in a task that multiplies them
TILE, TILE_GAIN = 1 << 18, 4                    # scores and products held at once; rows sent that cost about as much as a row read
TILE_PRODUCTS = 64                              # products of a tile that cost about as much as a row sent


def min_count_filter(ratings: DataFrame, item_min: int, user_min: int, user: str = "usr",
                     item: str = "item") -> DataFrame:
    """Keep items with more than ``item_min`` ratings, then users with more than
    ``user_min`` ratings among those (in that order). Counts come from grouped
    aggregates joined back by key (left-semi), so a hot key costs one row."""
    ic = ratings.groupBy(item).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > item_min).select(item)
    r1 = ratings.join(ic, item, "left_semi")
    uc = r1.groupBy(user).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > user_min).select(user)
    return r1.join(uc, user, "left_semi")


def min_count_share_filter(ratings: DataFrame, item_share: float, user_share: float, user: str = "usr",
                           item: str = "item") -> DataFrame:
    """The same with counts as quantiles: items above the ``item_share`` quantile of ratings per item, then users above
    the ``user_share`` quantile of the ratings left per user, so the result does not depend on the size of the table."""
    def above(rows: DataFrame, key: str, share: float) -> DataFrame:
        counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        bound = counts.select(F.percentile("_n", F.lit(share))).scalar()      # the map of counts is as long as counts differ
        return counts.where(F.col("_n") > bound).select(key)

    r1 = ratings.join(above(ratings, item, item_share), item, "left_semi")
    return r1.join(above(r1, user, user_share), user, "left_semi")


def centre(ratings: DataFrame, by: str, value: str = "rating", name: str = "centred") -> DataFrame:
    """value − mean of its own group (mean over observed ratings).

    The means are a grouped aggregate (combined map-side) joined back on the
    key, so a hot group is never gathered into one window task; AQE splits a
    skewed join partition."""
    means = ratings.groupBy(by).agg(F.avg(value).alias("_mean"))
    return ratings.join(means, by).withColumn(name, F.col(value) - F.col("_mean")).drop("_mean")


# ---------------------------------------------------------------- item × item
def _prefix_index(cells: DataFrame, norms: DataFrame, least: float, stretch: float, user: str, item: str) -> DataFrame:
    """(user, item): the users by which every pair of items meets whose dot product over ``sqrt(_q_a _q_b)`` can reach ``least``, and few others.

    All items order their users alike, from those of few ratings to those of many. The last users of an item whose
    part of its norm stays below ``least`` are left out of the index (its suffix): if the first common user of two items
    were one of these, all their common users were, and their product fell short. So a user who rated much meets only
    items that nothing rarer tells apart. ``stretch`` is the greatest ratio of an item's length to its ``sqrt(_q)``."""
    order = cells.groupBy(user).agg(F.count(F.lit(1)).alias("_f"))
    shares = cells.join(order, user).join(norms.where("_q > 0"), item).select(user, item, "_f", (F.col("_v") ** 2 / F.col("_q")).alias("_share"))
    run = scan(shares, [F.col("_f").desc(), F.col(user).desc()], {"_share": "_run"}, partition=[item])
    return run.where(F.col("_run") * stretch ** 2 >= least ** 2 * (1 - 1e-9)).select(user, item)


def _index_pairs(index: DataFrame, user: str, item: str) -> DataFrame:
    return index.withColumnRenamed(item, "a").join(index.withColumnRenamed(item, "b"), user).where("a < b").select("a", "b").distinct()


def _prefix_pairs(cells: DataFrame, norms: DataFrame, least: float, stretch: float, user: str, item: str) -> DataFrame:
    """(a, b), a < b: the pairs of items that a prefix index lets meet."""
    return _index_pairs(_prefix_index(cells, norms, least, stretch, user, item), user, item)


def _met(rows: DataFrame, user: str) -> float:
    """Pairs of rows of the same user."""
    counts = rows.groupBy(user).agg(F.count(F.lit(1)).cast("double").alias("_f"))
    return counts.agg(F.coalesce(F.sum(F.col("_f") * (F.col("_f") - 1) / 2), F.lit(0.0)).alias("n")).first()["n"]


def item_similarity(ratings: DataFrame, items: Sequence | None = None, user: str = "usr", item: str = "item",
                    value: str = "rating", center: str | None = None, clip: bool = False,
                    min_overlap: int = 1, least: float | None = None, prefix: bool = False) -> DataFrame:
    """Cosine between items over users, long form (a, b, sim), both directions and
    the diagonal. Without ``items`` the pairs are those that at least
    ``min_overlap`` users rated; with ``items`` every pair of the list has a row.
    ``least`` keeps the pairs of at least that similarity.

    Under 'zero_filled' centring two items that no user rated both are not alike
    by 0 but by -s_a s_b / (n |a| |b|), with s the sums of the ratings. Without
    ``items`` and with ``min_overlap`` 1 these pairs get rows too, from one (sum, norm)
    a pair of items, unless they cannot reach what is asked for: ``clip`` or ``least`` >= 0
    leave out pairs of at most 0, which uncorated items are where no sum is negative.
    A catalogue of more than ``ALL_PAIRS`` items needs one of these or a list.

    center: None (raw), 'observed' (subtract the item mean of observed ratings,
    missing stays 0), 'zero_filled' (missing counts as 0 in the item mean:
    Σ r_a r_b − n·m_a·m_b, n users). Repeated ratings of a cell count as their
    mean. A zero norm gives similarity 0.

    The join is on the user; each user's items meet in one direction and the
    pairs are summed before any shuffle. Adaptive execution splits a user with
    very many ratings, since only sums leave the join.

    ``prefix`` finds the pairs of at least ``least`` (> 0, needed) through an index of the users that tell items apart
    and sums the ratings of these pairs only, with the same rows. It pays for high bounds and users with many ratings;
    for low ones the full join is less work, and is taken after the index was counted. Negative sums under 'zero_filled' raise.
    """
    if prefix and (items is not None or least is None or least <= 0):
        raise ValueError("a prefix index needs a least similarity above 0 and no list of items")
    src = ratings
    if center == "observed":
        src = centre(ratings, item, value, "_c").select(user, item, F.col("_c").alias(value))
    cells = src.groupBy(user, item).agg(F.avg(value).cast("double").alias("_v"))
    if items is not None:
        cells = cells.where(F.col(item).isin(list(items)))
    sums = cells.groupBy(item).agg(F.sum("_v").alias("_s"), F.sum(F.col("_v") ** 2).alias("_q"), F.count(F.lit(1)).alias("_m"))
    if center == "zero_filled":
        n = ratings.select(F.count_distinct(F.col(user))).scalar()
        sums = sums.withColumn("_n", n).withColumn("_q", F.col("_q") - F.col("_s") * F.col("_s") / F.col("_n"))
    stretch = 1.0
    if prefix:
        cells = cut_lineage(cells)
        if center == "zero_filled":
            worst = sums.agg(F.min("_s").alias("low"), F.max(F.when(F.col("_q") > 0, F.sqrt(1 + F.col("_s") ** 2 / F.col("_n") / F.col("_q")))).alias("ratio")).first()
            if worst["low"] is not None and worst["low"] < 0:
                raise ValueError("items with negative sums can be alike without a common user: leave out the prefix index")
            stretch = worst["ratio"] or 1.0
    x = cells.select(user, F.col(item).alias("a"), F.col("_v").alias("_va"))
    y = cells.select(user, F.col(item).alias("b"), F.col("_v").alias("_vb"))
    met = x.join(y, user).where("a < b")
    if prefix:
        index = _prefix_index(cells, sums.select(item, "_q"), least, stretch, user, item)
        # every pair of the index has the ratings of one item looked up; without it all items of a user meet once
        if _met(index, user) * (sums.agg(F.avg("_m").alias("m")).first()["m"] or 0.0) < _met(cells, user):
            met = _index_pairs(index, user, item).join(x, "a").join(y, ["b", user])
    pairs = met.groupBy("a", "b").agg(
        F.sum(F.col("_va") * F.col("_vb")).alias("_d"), F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= min_overlap)
    if items is not None:
        listed = F.array(*[F.lit(i) for i in items])
        grid = ratings.sparkSession.range(1).select(F.explode(listed).alias("a")) \
            .select("a", F.explode(listed).alias("b")).where("a < b")
        pairs = grid.join(pairs, ["a", "b"], "left").na.fill(0.0, subset=["_d"])
    side = lambda s: sums.select(F.col(item).alias(s), *[F.col(c).alias(f"{c}{s}") for c in sums.columns if c not in (item, "_m")])
    if center == "zero_filled" and items is None and min_overlap <= 1:
        facts = sums.agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("low")).first()
        none_below = facts["low"] is None or facts["low"] >= 0
        if not (none_below and (clip or (least is not None and least > 0))):
            if facts["n"] > ALL_PAIRS:
                raise ValueError(f"{facts['n']} items have similarities of every pair: name items, a least similarity or clip")
            names = cut_lineage(sums.select(item))      # at most ALL_PAIRS rows
            grid = names.select(F.col(item).alias("a")).join(F.broadcast(names.select(F.col(item).alias("b"))), F.col("a") < F.col("b"))
            pairs = grid.join(pairs, ["a", "b"], "left").na.fill(0.0, subset=["_d"])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    dot = F.col("_d") - F.col("_sa") * F.col("_sb") / F.col("_na") if center == "zero_filled" else F.col("_d")
    sim = F.coalesce(F.try_divide(dot, F.sqrt(F.col("_qa") * F.col("_qb"))), F.lit(0.0))
    if clip:
        sim = F.greatest(sim, F.lit(0.0))
    half = j.select("a", "b", sim.alias("sim"))
    both = half.select("a", "b", "sim", F.inline(F.array(F.struct(F.col("a").alias("_a"), F.col("b").alias("_b")),
                                                         F.struct(F.col("b").alias("_a"), F.col("a").alias("_b")))))
    own = sums.where(F.col("_m") >= min_overlap) if items is None else sums
    diag = own.select(F.col(item).alias("a"), F.col(item).alias("b"), F.coalesce(
        F.try_divide(F.col("_q"), F.sqrt(F.col("_q") * F.col("_q"))), F.lit(0.0)).alias("sim"))
    out = both.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "sim").unionByName(diag)
    return out if least is None else out.where(F.col("sim") >= least)


def predict_item_based(ratings: DataFrame, sim: DataFrame, user: str = "usr", item: str = "item",
                       value: str = "rating") -> DataFrame:
    """score(u, i) = Σ_j rating(u, j) · sim(j, i) over the items u rated; a pair
    without a row in ``sim`` adds nothing.

    ``sim`` is stored and counted: up to ``BROADCAST_ROWS`` rows are sent to every
    task, so that the scores of a user are summed where that user's ratings are;
    a larger table is joined by item."""
    cells = ratings.groupBy(user, item).agg(F.sum(value).alias("_v"))
    sim = cut_lineage(sim.withColumnRenamed("a", item))
    if sim.count() <= BROADCAST_ROWS:
        j = cells.repartition(user).join(F.broadcast(sim), item)
    else:
        j = cells.join(sim, item)
    return j.groupBy(user, F.col("b").alias(item)).agg(F.sum(F.col("_v") * F.col("sim")).alias("score"))


def _tiling(rated: int, pairs: int) -> tuple[int, int, int]:
    """Hashes of users and of items that :func:`_tiles` takes for so many ratings and similarities, and the rows it sends."""
    rows, columns = -(-rated // TILE_RATINGS) or 1, -(-pairs // TILE_PAIRS) or 1
    return rows, columns, rated * columns + pairs * rows


def _tiles(cells: DataFrame, seen: DataFrame, sim: DataFrame, n: int, slack: float, rows: int, columns: int, user: str,
           item: str) -> DataFrame:
    """(user, b, score) with full scores: per user and hash of the item the ``n`` best unseen items, and those within
    ``slack``. A task multiplies the ratings of one of ``rows`` hashes of users with the similarities to one of
    ``columns`` hashes of items; users in it are taken some at a time."""
    mine = seen.join(cells.select(user).distinct(), user, "left_semi").join(cells, [user, item], "left").select(user, item, "_v")
    left = mine.select(F.pmod(F.xxhash64(user), F.lit(rows)).alias("_r"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("_t"), user, item, "_v")
    right = sim.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(rows - 1).cast("long"))).alias("_r"), F.pmod(F.xxhash64("b"), F.lit(columns)).cast("int").alias("_t"), item, "b", "sim")
    shape = T.StructType([mine.schema[user], sim.schema["b"], T.StructField("score", T.DoubleType())])

    def score(ratings: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({user: ratings[user][:0], "b": pairs["b"][:0], "score": np.zeros(0)})
        if not len(ratings) or not len(pairs):
            return empty
        u, users = pd.factorize(ratings[user])
        items = pd.Index(pairs[item].unique())
        b, targets = pd.factorize(pairs["b"])
        near_i = items.get_indexer(pairs[item])
        order = np.argsort(near_i, kind="stable")
        near_i, near_b, near_s = near_i[order], b[order], pairs["sim"].to_numpy(float)[order]
        begin = np.searchsorted(near_i, np.arange(len(items) + 1))
        known = ratings["_v"].notna().to_numpy()
        i, v, hide = np.where(known, items.get_indexer(ratings[item]), -1), ratings["_v"].to_numpy(float), pd.Index(targets).get_indexer(ratings[item])
        order = np.lexsort((i, u))
        u, i, v, hide = u[order], i[order], v[order], hide[order]
        size = np.where(i >= 0, begin[i + 1] - begin[i], 0)
        positive = bool((near_s > 0).all() and (v[i >= 0] > 0).all())      # then what is met has a sum above 0
        cuts = np.searchsorted(u, np.arange(len(users) + 1))
        upto = np.append(0, np.cumsum(size))[cuts]      # products of all users before
        out, step, low = [], max(1, TILE // len(targets)), 0
        while low < len(users):
            high = max(low + 1, min(low + step, int(np.searchsorted(upto, upto[low] + TILE, "right")) - 1))
            some = slice(cuts[low], cuts[high])
            uu, many, hh = u[some] - low, size[some], hide[some]
            at = np.arange(many.sum()) + np.repeat(begin[i[some]] - (np.cumsum(many) - many), many)
            cell = np.repeat(uu * len(targets), many) + near_b[at]
            cells_n = (high - low) * len(targets)
            sums = np.bincount(cell, np.repeat(v[some], many) * near_s[at], minlength=cells_n).reshape(high - low, -1)
            met = sums > 0 if positive else (np.bincount(cell, minlength=cells_n) > 0).reshape(high - low, -1)
            met[uu[hh >= 0], hh[hh >= 0]] = False
            value = np.where(met, np.where(np.isnan(sums), np.inf, sums), -np.inf)
            nth = np.partition(value, -n, axis=1)[:, -n] if len(targets) > n else np.full(high - low, -np.inf)
            margin = 2 * slack + 1e-9 * np.where(np.isfinite(nth), np.abs(nth), 0.0)
            line, column = np.nonzero(met & (value >= (nth - margin)[:, None]))
            out.append(pd.DataFrame({user: users[line + low], "b": targets[column], "score": sums[line, column]}))
            low = high
        return pd.concat(out)

    return left.groupBy("_r", "_t").cogroup(right.groupBy("_r", "_t")).applyInPandas(score, shape)


def _candidates(cells: DataFrame, seen: DataFrame, sim: DataFrame, n: int, slack: float, depth: int, user: str,
                item: str, few: bool = False) -> DataFrame:
    """(user, b, score): unseen items that can be among a user's ``n`` best, with the score where it is known already.
    ``cells`` has one rating ``_v`` a (user, item); ``sim`` has ``item, b, sim``. With ``few`` rows in ``sim`` they go to
    every task: dealt by item, all ratings of a small catalogue would meet in a few tasks."""
    side = F.broadcast if few else lambda x: x
    size = sim.groupBy(item).agg(F.count(F.lit(1)).cast("double").alias("_size"))
    if not few:
        # a round groups and stores a row for each rating and neighbour, and no user may be done after it
        facts = cells.join(size, item).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in (("read", F.col("_size")), ("first", F.least("_size", F.lit(float(depth)))))]).first()
        rows, columns, sent = _tiling(cells.count(), sim.count())
        if facts["first"] < facts["read"] and sent + facts["read"] / TILE_PRODUCTS < TILE_GAIN * facts["first"]:
            return stored(_tiles(cells, seen, sim, n, slack, rows, columns, user, item).select(user, "b", "score"), "top-tiles")
    lists = scan(sim.withColumn("_one", F.lit(1)), [F.col("sim").desc(), "b"], {"_one": "_rank"}, partition=[item]).drop("_one")
    facts = lists.agg(F.max("_rank").alias("longest"), F.max(F.abs("sim")).alias("most")).first()
    longest, most = facts["longest"] or 0, facts["most"] or 0.0
    least = lists.groupBy(item).agg(F.least(F.min("sim"), F.lit(0.0)).alias("_low"))
    open_, found = cells, []
    while True:
        tails = lists.where(F.col("_rank") == depth + 1).select(item, F.greatest("sim", F.lit(0.0)).alias("_high")).join(least, item)
        ends = [F.col("_v") * F.col("_high"), F.col("_v") * F.col("_low")]
        mine = open_.join(side(tails), item, "left").select(user, item, "_v", F.coalesce(F.greatest(*ends), F.lit(0.0)).alias("_up"),
                                                      F.coalesce(F.least(*ends), F.lit(0.0)).alias("_down"),
                                                      F.col("_high").isNotNull().cast("int").alias("_tail"))
        sums = [F.sum(c).alias(f"{c}s") for c in ("_up", "_down", "_tail")]
        whole = mine.groupBy(user).agg(*[F.sum(c).alias(f"{c}_all") for c in ("_up", "_down", "_tail")],
                                       (F.sum(F.abs("_v")) * most * 1e-9 + slack).alias("_slack"))
        heads = lists.where(F.col("_rank") <= depth).select(item, "b", "sim")
        parts = mine.join(side(heads), item).groupBy(user, "b").agg(F.sum(F.col("_v") * F.col("sim")).alias("_part"), *sums)
        left = lambda c: F.col(f"{c}_all") - F.col(f"{c}s")  # noqa: E731   what the lists without this item can still add
        pairs = stored(parts.join(seen.withColumnRenamed(item, "b"), [user, "b"], "left_anti").join(whole, user).select(
            user, "b", F.when(left("_tail") == 0, F.col("_part")).alias("score"), (F.col("_part") + left("_down")).alias("_from"),
            (F.col("_part") + left("_up")).alias("_to")), "top-pairs")
        best = Window.partitionBy(user).orderBy(F.col("_from").desc())
        nth = pairs.select(user, "_from", F.row_number().over(best).alias("_k")).where(F.col("_k") <= n) \
                   .groupBy(user).agg(F.when(F.count(F.lit(1)) == n, F.min("_from")).alias("_nth"))
        state = stored(whole.join(nth, user, "left").select(user, "_nth", "_slack", F.coalesce(
            (F.col("_tail_all") == 0) | (F.col("_up_all") + F.col("_slack") < F.col("_nth")), F.lit(False)).alias("_closed")), "top-users")
        found.append(pairs.join(state.where("_closed"), user).where("_nth is null or _to + _slack >= _nth").select(user, "b", "score"))
        if depth >= longest or state.where("not _closed").isEmpty():
            return reduce(DataFrame.unionAll, found)
        open_ = stored(open_.join(state.where("not _closed"), user, "left_semi"), "top-open")
        # reading the lists whole makes a row for each rating and neighbour; tiles send ratings and neighbours several times
        facts = open_.join(size, item).agg(F.coalesce(F.sum("_size"), F.lit(0.0)).alias("read")).first()
        rows, columns, sent = _tiling(open_.count(), sim.count())
        if TILE_GAIN * sent < facts["read"]:
            tiles = stored(_tiles(open_, seen, sim, n, slack, rows, columns, user, item).select(user, "b", "score"), "top-tiles")
            return reduce(DataFrame.unionAll, [*found, tiles])
        depth *= 4


def top_unseen(ratings: DataFrame, sim: DataFrame, n: int, digits: int | None = None, depth: int = 32, user: str = "usr",
               item: str = "item", value: str = "rating") -> DataFrame:
    """The ``n`` best items of each user that the user has not rated: (user, item, score, rank), equal to
    :func:`predict_item_based`, :func:`mask_seen` and :func:`topn` (ties by item; ``digits`` rounds scores before they
    are ranked), without a score for every user and item that share a neighbour.

    Neighbour lists are ordered by similarity. A round reads the first ``depth`` of each list that a user rated, which
    gives every item met a least and a greatest score: a list that did not show the item adds at most the rating times
    its next similarity, and at least the rating times its least one. A user is done once the ``n``-th best least score
    beats what an item that no list showed can reach; only items whose greatest score reaches that ``n``-th best are
    scored in full. Other users go on with lists four times as long, so flat lists are read whole; where that makes many
    more rows than sending ratings and lists to tiles of (users, items), these users are scored there in full
    (:func:`_tiles`). Exact for ratings and similarities of any sign.

    Repeated ratings of a cell are added up, as there. A row with a NULL or NaN rating marks its item as seen and adds
    nothing; a pair of ``sim`` with a NULL or NaN similarity adds nothing. A user with fewer candidates gets them all;
    empty inputs give no rows. Extra columns are ignored.
    """
    known = ratings.where(F.col(user).isNotNull() & F.col(item).isNotNull()).select(user, item, F.col(value).cast("double").alias("_v"))
    seen = known.select(user, item).distinct()
    cells = cut_lineage(known.where("_v is not null and not isnan(_v)").groupBy(user, item).agg(F.sum("_v").alias("_v")))
    pairs = cut_lineage(sim.select(F.col("a").alias(item), "b", F.col("sim").cast("double").alias("sim"))
                        .where("b is not null and sim is not null and not isnan(sim)"))
    slack = 0.0 if digits is None else 10.0 ** -digits
    few = pairs.count() <= BROADCAST_ROWS
    found = _candidates(cells.repartition(user) if few else cells, seen, pairs, n, slack, depth, user, item, few)
    asked = found.where("score is null").select(user, "b")
    side = F.broadcast(pairs) if few else pairs
    scored = asked.join(cells, user).join(side, [item, "b"]).groupBy(user, "b").agg(F.sum(F.col("_v") * F.col("sim")).alias("score"))
    scores = found.where("score is not null").select(user, "b", "score").unionByName(scored.select(user, "b", "score"))
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return topn(scores.withColumnRenamed("b", item), n, user, item)


# ---------------------------------------------------------------- user × user
def user_similarity(ratings: DataFrame, targets: DataFrame, user: str = "usr", item: str = "item",
                    value: str = "rating", min_overlap: int = 1, clip: bool = False) -> DataFrame:
    """Cosine of each target user with every user that co-rates at least
    ``min_overlap`` items: (a, b, sim, overlap), a in ``targets``, also a = b.

    The targets' ratings join all ratings on the item and group by (a, b), so the
    work is linear in the ratings for a fixed list of targets; keys may have any
    type and no item list is needed. Repeated ratings of a cell count as their
    mean. A zero norm gives similarity 0."""
    cells = ratings.groupBy(user, item).agg(F.avg(value).alias("_v"))
    norms = cells.groupBy(user).agg(F.sqrt(F.sum(F.col("_v") ** 2)).alias("_norm"))
    mine = cells.join(targets.select(user).distinct(), user, "left_semi") \
                .select(F.col(user).alias("a"), item, F.col("_v").alias("_va"))
    dots = mine.join(cells.select(F.col(user).alias("b"), item, F.col("_v").alias("_vb")), item) \
               .groupBy("a", "b").agg(F.sum(F.col("_va") * F.col("_vb")).alias("_dot"), F.count(F.lit(1)).cast("int").alias("overlap"))
    sims = dots.join(norms.select(F.col(user).alias("a"), F.col("_norm").alias("_na")), "a") \
               .join(norms.select(F.col(user).alias("b"), F.col("_norm").alias("_nb")), "b")
    sim = F.coalesce(F.try_divide(F.col("_dot"), F.col("_na") * F.col("_nb")), F.lit(0.0))
    sim = F.greatest(sim, F.lit(0.0)) if clip else sim
    return sims.where(F.col("overlap") >= min_overlap).select("a", "b", sim.alias("sim"), "overlap")


def predict_user_based(sims: DataFrame, ratings: DataFrame, user: str = "usr", item: str = "item",
                       value: str = "rating") -> DataFrame:
    """score(u, i) = Σ_v sim(u, v) · rating(v, i) over the users v of ``sims``
    (:func:`user_similarity`), not divided by Σ sim; items that no neighbour rated
    have no row."""
    cells = ratings.groupBy(user, item).agg(F.avg(value).alias("_v")).withColumnRenamed(user, "b")
    return sims.join(cells, "b").groupBy(F.col("a").alias(user), item).agg(F.sum(F.col("sim") * F.col("_v")).alias("score"))


# ---------------------------------------------------------------- scoring helpers
def mask_seen(scores: DataFrame, ratings: DataFrame, keep: str = "unseen", user: str = "usr",
              item: str = "item") -> DataFrame:
    """keep='unseen' drops (u, i) the user already rated; 'seen' keeps only those."""
    how = "left_anti" if keep == "unseen" else "left_semi"
    return scores.join(ratings.select(user, item), [user, item], how)


def topn(scores: DataFrame, n: int, user: str = "usr", item: str = "item", score: str = "score") -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.col(score).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def scaled_rmse(scores: DataFrame, actual: DataFrame, lo: float = 1.0, hi: float = 5.0, user: str = "usr",
                item: str = "item", value: str = "rating", digits: int = 6) -> DataFrame:
    """Scale positive scores to [lo, hi] per item (min / max over the item's
    positive scores on the evaluated pairs), then RMSE against the actual ratings.
    An item whose positive scores are all equal scales to ``lo``."""
    pairs = scores.where(F.col("score") > 0).join(actual.select(user, item, value), [user, item])
    mm = pairs.groupBy(item).agg(F.min("score").alias("_mn"), F.max("score").alias("_mx"))
    j = pairs.join(mm, item)
    scaled = F.when(F.col("_mx") == F.col("_mn"), F.lit(lo)).otherwise(
        (F.col("score") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * (hi - lo) + lo)
    return j.agg(F.round(F.sqrt(F.avg((F.col(value) - scaled) ** 2)), digits).alias("rmse"),
                 F.count(F.lit(1)).alias("n_pairs"))
