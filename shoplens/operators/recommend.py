"""Recommenders: neighbour-based (REC3), similar products (REC4a/b),
popularity fallback (REC5), implicit ratings (REC8), offline evaluation
(REC7), recommendation analytics (AGG8), per-user documents (RPT2) and the
event -> recommendation lookup (JN6).

All users are served in one job; nothing is computed per request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens import constants as C
from shoplens.functions import scalars as S
from shoplens.operators.sequence import with_global_sequence
from shoplens.operators.prefix_index import top_k_sparse
from shoplens.operators.similarity import top_k_similar
from shoplens.operators.trending import check_limit


def interaction_sets(events: DataFrame, user: str = "user_id", item: str = "product_id") -> DataFrame:
    """Distinct (user_id, product_id) with both present."""
    return (events.select(F.col(user).cast("string").alias("user_id"),
                          F.col(item).cast("string").alias("product_id"))
            .where(F.coalesce(F.col("user_id") != "", F.lit(False))
                   & F.coalesce(F.col("product_id") != "", F.lit(False)))
            .distinct())


def user_neighbours(sets: DataFrame, k: int = C.TOP_NEIGHBOURS,
                    threshold: float = C.JACCARD_THRESHOLD, method: str = "blocks", **kw) -> DataFrame:
    """JN2 + SET1 + WIN1: the top-k users by Jaccard similarity (> threshold).
    Both methods give the same rows: ``blocks`` compares blocks of users (dense
    sets), ``index`` only users whose rarest products meet (sparse sets)."""
    if method not in ("blocks", "index"):
        raise ValueError("method must be blocks or index")
    top = top_k_similar if method == "blocks" else top_k_sparse
    return (top(sets, "user_id", "product_id", k, "jaccard", threshold, **kw)
            .select("user_id", F.col("neighbour_user_id").alias("neighbour_id"), "similarity",
                    "common", "rank"))


def neighbour_recommendations(sets: DataFrame, neighbours: DataFrame,
                              k: int = C.TOP_RECOMMENDATIONS) -> DataFrame:
    """JN3 + WIN2: products of the neighbours the user has not seen, scored by
    the sum of the neighbours' similarities; top k per user (ties: product).

    Each user reads at most k neighbours' sets, so the candidate table is
    bounded by k x the largest set per user.
    """
    nb = neighbours.select("user_id", F.col("neighbour_id").alias("_nb"), "similarity")
    cand = nb.join(sets.withColumnRenamed("user_id", "_nb"), "_nb")
    unseen = cand.join(sets, ["user_id", "product_id"], "left_anti")
    scored = (unseen.groupBy("user_id", "product_id")
              .agg(S.round_half_up(F.sum("similarity"), 6).alias("score")))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("product_id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def describe_recommendations(recs: DataFrame, product_profiles: DataFrame) -> DataFrame:
    """JN4 + SCL8-SCL10: attach product statistics, confidence and reason."""
    pp = product_profiles.select("product_id", F.col("avg_rating").alias("_avg"),
                                 F.col("reviews").alias("total_reviews"), "unique_users")
    j = recs.join(pp, "product_id", "left")
    return j.select(
        "user_id", "rank", "product_id", "score",
        S.neighbour_confidence("score").alias("confidence"),
        S.predicted_rating("_avg").alias("predicted_rating"),
        F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        F.coalesce("unique_users", F.lit(0)).alias("unique_users"),
        S.reason_text("score").alias("reason"))


def recommend_for_users(sets: DataFrame, product_profiles: DataFrame, **kw) -> DataFrame:
    """REC3: the whole neighbour recommender for every user at once."""
    nb = user_neighbours(sets, **kw)
    return describe_recommendations(neighbour_recommendations(sets, nb), product_profiles)


def popularity(actions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Popularity score = sum of action weights; rank 1..n over every product
    (products without actions follow with score 0, ties by product id).

    The rank is a global sequence from a distributed sort, not a
    single-partition window.
    """
    return with_global_sequence(popularity_scores(actions, products),
                                [F.desc("popularity"), F.asc("product_id")], "pop_rank")


def popularity_scores(actions: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """(product_id, popularity): the sum of action weights."""
    scores = (actions.where(F.col("product_id").isNotNull())
              .groupBy("product_id").agg(F.sum(S.action_weight("action")).alias("popularity")))
    if products is not None:
        scores = (products.select("product_id").distinct()
                  .join(scores, "product_id", "full")
                  .select("product_id", F.coalesce("popularity", F.lit(0.0)).alias("popularity")))
    return scores


def fill_with_popular(users: DataFrame, recs: DataFrame, seen: DataFrame, popular: DataFrame,
                      k: int = C.TOP_RECOMMENDATIONS) -> DataFrame:
    """REC5: every user gets k recommendations: their own (source
    'collaborative') first, then the most popular products they have neither
    seen nor been recommended (source 'popularity').

    Exact without a cap: a user with e excluded products needs at most the
    first ``need + e`` popularity ranks, so each user expands exactly that
    many ranks (linear in the data), removes the excluded ones by an anti-join
    on (user, rank) and keeps the first ``need``.
    """
    own = recs.select("user_id", "product_id", "rank", F.col("score").cast("double").alias("score"))
    # one row per product; a product seen by a third of all users is a skewed key
    # that adaptive execution splits, the side of one row being repeated
    ranked = popular.select("product_id", "pop_rank", "popularity")
    excluded = (seen.select("user_id", "product_id").unionByName(own.select("user_id", "product_id"))
                .distinct().join(ranked, "product_id").select("user_id", "pop_rank"))
    n_own = own.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_own"))
    n_exc = excluded.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_exc"))
    need = (users.select("user_id").distinct().join(n_own, "user_id", "left").join(n_exc, "user_id", "left")
            .select("user_id", (F.lit(k) - F.coalesce("n_own", F.lit(0))).alias("need"),
                    F.coalesce("n_exc", F.lit(0)).alias("n_exc"))
            .where(F.col("need") > 0))
    cand = need.select("user_id", "need", F.explode(F.sequence(F.lit(1).cast("long"),
                                                               (F.col("need") + F.col("n_exc")).cast("long")))
                       .alias("pop_rank"))
    free = cand.join(excluded, ["user_id", "pop_rank"], "left_anti")
    w = Window.partitionBy("user_id").orderBy("pop_rank")
    fill = (free.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= F.col("need"))
            .join(ranked, "pop_rank")
            .select("user_id", "product_id", F.col("popularity").alias("score"),
                    (F.lit(k) - F.col("need") + F.col("_i")).alias("rank"),
                    F.lit("popularity").alias("source")))
    mine = own.select("user_id", "product_id", "score", F.col("rank").cast("long").alias("rank"),
                      F.lit("collaborative").alias("source"))
    return mine.unionByName(fill.withColumn("rank", F.col("rank").cast("long")))


def cold_start(scores: DataFrame, k: int = C.TOP_RECOMMENDATIONS) -> DataFrame:
    """REC5 for an unknown user: the k most popular products of ``popularity_scores``
    (a distributed top-k; the window numbers its k rows)."""
    by = [F.desc("popularity"), F.asc("product_id")]
    return (scores.orderBy(*by).limit(k)
            .select(F.row_number().over(Window.orderBy(*by)).cast("long").alias("rank"), "product_id", F.col("popularity").alias("score"),
                    F.lit("popularity").alias("source")))


def implicit_ratings(actions: DataFrame) -> DataFrame:
    """REC8: implicit rating = sum of action weights per (user, product)."""
    return (actions.where(F.col("user_id").isNotNull() & F.col("product_id").isNotNull())
            .groupBy("user_id", "product_id")
            .agg(F.sum(S.action_weight("action")).alias("rating"), F.count(F.lit(1)).alias("events")))


def similar_products_by_users(sets: DataFrame, k: int = 10, **kw) -> DataFrame:
    """REC4a: item-item cosine of co-interaction, n_ab / sqrt(n_a n_b), top k."""
    check_limit("similar", k)
    return (top_k_similar(sets, "product_id", "user_id", k, "cosine", 0.0, **kw)
            .select("product_id", F.col("neighbour_product_id").alias("similar_product_id"),
                    S.round_half_up("similarity", 6).alias("similarity_score"), "common", "rank"))


def similar_products_by_content(dimension: DataFrame, k: int = 10) -> DataFrame:
    """REC4b: same category, closest price.  similarity = min(p_a, p_b) /
    max(p_a, p_b); ranked by similarity desc, catalogue distance asc, id asc.

    Within a category similarity falls monotonically with distance in the
    (category, price, id) order on each side, so the k best lie within k
    positions either side.  Positions come from a distributed global sort and
    the neighbours are found by an equi-join on position (uniform keys, no
    per-category partition).
    """
    check_limit("similar", k)
    d = (dimension.select("product_id", "category", "price")
         .where(F.col("category").isNotNull() & F.col("price").isNotNull() & (F.col("price") > 0)))
    pos = with_global_sequence(d, ["category", "price", "product_id"], "pos")
    offsets = [o for o in range(-k, k + 1) if o != 0]
    probe = pos.select(F.col("product_id"), F.col("category"), F.col("price"), F.col("pos"),
                       F.explode(F.array(*[F.lit(o) for o in offsets])).alias("off"))
    probe = probe.withColumn("other_pos", F.col("pos") + F.col("off"))
    other = pos.select(F.col("pos").alias("other_pos"), F.col("product_id").alias("similar_product_id"),
                       F.col("category").alias("_cat"), F.col("price").alias("_price"))
    j = probe.join(other, "other_pos").where(F.col("_cat") == F.col("category"))
    sim = S.round_half_up(F.least("price", "_price") / F.greatest("price", "_price"), 6)
    j = j.select("product_id", "similar_product_id", sim.alias("similarity_score"),
                 F.abs("off").alias("distance"))
    w = Window.partitionBy("product_id").orderBy(F.desc("similarity_score"), F.asc("distance"),
                                                 F.asc("similar_product_id"))
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("product_id", "similar_product_id", "similarity_score", "rank"))


PRICE_BAND = 100.0  # width of a price band in tastes


def content_cells(dimension: DataFrame) -> DataFrame:
    """(product_id, category, band): a product's cell is its category and price band."""
    return (dimension.select("product_id", "category", F.floor(F.col("price") / PRICE_BAND).cast("long").alias("band"))
            .where(F.col("category").isNotNull() & F.col("band").isNotNull()))


def taste_vectors(actions: DataFrame, dimension: DataFrame) -> DataFrame:
    """(user_id, category, band, taste): the share of a user's action weight in each cell (6 places)."""
    known = actions.where(F.coalesce(F.col("user_id") != "", F.lit(False)))
    weights = (known.groupBy("user_id", "product_id").agg(F.sum(S.action_weight("action")).alias("w"))
               .join(content_cells(dimension), "product_id")
               .groupBy("user_id", "category", "band").agg(F.sum("w").alias("w")))
    total = weights.groupBy("user_id").agg(F.sum("w").alias("total"))
    return weights.join(total, "user_id").select(
        "user_id", "category", "band", S.round_half_up(F.col("w") / F.col("total"), 6).alias("taste"))


def content_recommendations(actions: DataFrame, dimension: DataFrame, popularity_of: DataFrame,
                            k: int = C.TOP_RECOMMENDATIONS) -> DataFrame:
    """REC7's content recommender: unseen products of the user's favourite cells.

    Ordered by the user's taste for the cell, then the product's place in its
    cell (popularity desc, id asc), then cell and id.  A cell's products are
    ranked once; a user who has seen s products of a cell needs at most its first
    k + s, so each (user, cell) expands that many places (linear in the data),
    joins them to the index by (cell, place), drops what was seen and keeps k.
    """
    cells = content_cells(dimension)
    by = Window.partitionBy("category", "band").orderBy(F.desc("popularity"), F.asc("product_id"))
    index = cells.join(popularity_of.select("product_id", "popularity"), "product_id", "left") \
        .fillna(0.0, ["popularity"]).withColumn("place", F.row_number().over(by)) \
        .select("category", "band", "place", "product_id")
    seen = interaction_sets(actions)
    seen_in = seen.join(cells, "product_id").groupBy("user_id", "category", "band").agg(F.count(F.lit(1)).alias("n_seen"))
    wants = taste_vectors(actions, dimension).join(seen_in, ["user_id", "category", "band"], "left") \
        .select("user_id", "category", "band", "taste", F.explode(F.sequence(
            F.lit(1), (F.lit(k) + F.coalesce("n_seen", F.lit(0))).cast("int"))).alias("place"))
    found = wants.join(index, ["category", "band", "place"]).join(seen, ["user_id", "product_id"], "left_anti")
    w = Window.partitionBy("user_id").orderBy(F.desc("taste"), "place", "category", "band", "product_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("user_id", "product_id", F.col("taste").alias("score"), "rank"))


def evaluate(recs: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """REC7 metrics of one recommender: users with relevant items, hit rate,
    mean precision@k and mean recall@k (4 places)."""
    rel = relevant.select("user_id", "product_id").distinct()
    n_rel = rel.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rel"))
    top = recs.where(F.col("rank") <= k).select("user_id", "product_id")
    hits = top.join(rel, ["user_id", "product_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("hits"))
    per = n_rel.join(hits, "user_id", "left").fillna(0, ["hits"])
    return per.agg(
        F.count(F.lit(1)).alias("users"),
        S.round_half_up(F.avg((F.col("hits") > 0).cast("double")), 4).alias("hit_rate"),
        S.round_half_up(F.avg(F.col("hits") / F.lit(float(k))), 4).alias("precision_at_k"),
        S.round_half_up(F.avg(F.col("hits") / F.col("n_rel")), 4).alias("recall_at_k"))


def recommendation_analytics(recs: DataFrame) -> DataFrame:
    """AGG8 from the actual output: users served, recommendations produced and
    the mean per user (2 places)."""
    per = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("users_with_recommendations"),
                   F.coalesce(F.sum("n"), F.lit(0)).alias("recommendations_generated"),
                   S.round_half_up(F.avg("n"), 2).alias("avg_recommendations_per_user"))


def recommendation_documents(recs: DataFrame, user_profiles: DataFrame) -> DataFrame:
    """RPT2: one document per user: profile summary and the ranked list.

    The list per user is at most k entries (bounded), sorted by rank.
    """
    items = F.struct("rank", "product_id", "confidence", "predicted_rating", "total_reviews",
                     "unique_users", "reason")
    lists = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(items)).alias("recommendations"))
    up = user_profiles.select("user_id", F.struct(
        F.col("reviews").alias("total_reviews"),
        S.round_half_up("avg_rating", 2).alias("avg_rating"),
        F.col("products_count").alias("products_reviewed")).alias("user_profile_summary"))
    return (lists.join(up, "user_id", "left")
            .select("user_id", F.lit(C.RECOMMENDATION_METHOD).alias("method"),
                    "user_profile_summary", "recommendations"))


def event_recommendations(events: DataFrame, recs: DataFrame, n: int = 3) -> DataFrame:
    """JN6: a view by a known user gets the user's top-n precomputed
    recommendations (a left join on user that reads the events once; works on a
    stream against a static table too)."""
    check_limit("recommendations", n)
    top = recs.where(F.col("rank") <= n).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("recommendations_generated"),
        F.min_by("product_id", "rank").alias("top_recommendation"))
    # only views of known users can match; any other event gets a key of its own that
    # matches nothing, so that the many without a user do not meet in one task
    is_view = F.coalesce((F.col("action") == "view") & (F.col("user_id").cast("string") != "0"), F.lit(False))
    own = F.xxhash64(*[c for c in events.columns if c != "action"]).cast("string")
    keyed = events.withColumns({"_view": is_view, "_key": F.when(is_view, F.col("user_id").cast("string")).otherwise(own)})
    found = keyed.join(top.select(F.col("user_id").cast("string").alias("_key"), F.lit(True).alias("_view"), "recommendations_generated",
                                  "top_recommendation"), ["_key", "_view"], "left")
    return found.select(*events.columns, F.when(F.col("_view"), F.coalesce("recommendations_generated", F.lit(0)).cast("long"))
                        .alias("recommendations_generated"), "top_recommendation")
