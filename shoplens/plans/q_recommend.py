"""Recommendation queries (REC3-REC8, JN2-JN4, JN6, SET1, WIN1/2, AGG8, RPT2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import recommend as RC
from shoplens.operators.events import process_api_events
from shoplens.plans import sqlparts as Q
from shoplens.plans.q_catalog import dimension
from shoplens.plans.q_events import api_events
from shoplens.plans.q_profiles import products, users
from shoplens.plans.registry import register
from shoplens.session import stored
from shoplens.sources import tables as T

_BASE = f"WITH {Q.ACTIONS_CTE}, {Q.sets_cte('sets')}"
_NB = f"{_BASE}, {Q.neighbours_cte('sets')}"
_RECS = f"{_NB}, {Q.recs_cte('sets')}"
_PROF = (f"WITH {Q.REVIEWS_CTE}, {Q.ACTIONS_CTE}, {Q.PRODUCT_DIM_CTE}, {Q.sets_cte('sets')}, "
         f"{Q.neighbours_cte('sets')}, {Q.recs_cte('sets')}, "
         f"{Q.profile_cte('product_id', 'user_id', 'unique_users')}")


def sets(spark, sf_dir):
    return RC.interaction_sets(T.actions(spark, sf_dir))


def neighbour_recs(spark, sf_dir):
    s = sets(spark, sf_dir)
    return RC.neighbour_recommendations(s, RC.user_neighbours(s))


@register("user_neighbours", f"""{_NB}
SELECT user_id, neighbour_id, similarity, common, rank FROM sets_nb""")
def q_user_neighbours(spark, sf_dir):
    """JN2 + SET1 + WIN1: top-5 Jaccard neighbours (> 0.1) of every user."""
    return RC.user_neighbours(sets(spark, sf_dir))


_BOUGHT = """bought AS (SELECT DISTINCT CAST(o.o_custkey AS VARCHAR) AS user_id, CAST(l.l_partkey AS VARCHAR) AS product_id
  FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)"""


@register("buyer_neighbours", f"""WITH {_BOUGHT}, {Q.neighbours_cte('bought', 5, 0.03)}
SELECT user_id, neighbour_id, similarity, common, rank FROM bought_nb""")
def q_buyer_neighbours(spark, sf_dir):
    """JN2 + SET1 + WIN1 on sparse sets: customers by the parts they bought, found by the prefix-filtered index."""
    bought = RC.interaction_sets(T.ratings(spark, sf_dir), "user_id", "asin")
    return RC.user_neighbours(bought, threshold=0.03, method="index")


@register("user_recommendations", f"""{_PROF}
SELECT r.user_id, r.rank, r.product_id, r.score,
       {Q.rhu('least(r.score, 1.0::DOUBLE)', 3)} AS confidence,
       CASE WHEN p.avg_rating IS NOT NULL AND p.avg_rating <> 0 THEN {Q.rhu('p.avg_rating', 2)}
            ELSE 4.0::DOUBLE END AS predicted_rating,
       coalesce(p.reviews, 0) AS total_reviews, coalesce(p.unique_users, 0) AS unique_users,
       'Similar users (similarity: ' || CAST({Q.rhu('r.score', 2)} AS VARCHAR) || ') liked this product'
         AS reason
FROM sets_recs r LEFT JOIN prof_product_id p ON r.product_id = p.product_id""")
def q_user_recommendations(spark, sf_dir):
    """REC3 + JN3 + WIN2 + JN4 + SCL8-SCL10: top-5 neighbour recommendations."""
    return RC.describe_recommendations(neighbour_recs(spark, sf_dir), products(spark, sf_dir))


@register("recommendations_with_fallback", f"""{_RECS}, {Q.PRODUCT_DIM_CTE},
{Q.popularity_cte('pop')},
{Q.fill_cte('allrecs', 'sets', 'sets_recs', 'sets', 'pop')}
SELECT user_id, product_id, score, rank, source FROM allrecs""")
def q_recommendations_with_fallback(spark, sf_dir):
    """REC5: neighbour recommendations topped up with popular unseen products."""
    s = sets(spark, sf_dir)
    recs = RC.neighbour_recommendations(s, RC.user_neighbours(s))
    pop = RC.popularity(T.actions(spark, sf_dir), dimension(spark, sf_dir))
    return RC.fill_with_popular(s.select("user_id"), recs, s, pop)


@register("cold_start_recommendations", f"""WITH {Q.ACTIONS_CTE}, {Q.PRODUCT_DIM_CTE},
{Q.popularity_cte('pop')}
SELECT pop_rank AS rank, product_id, popularity AS score, 'popularity' AS source
FROM pop WHERE pop_rank <= 5""")
def q_cold_start_recommendations(spark, sf_dir):
    """REC5 for an unknown user: the five most popular products."""
    return RC.cold_start(RC.popularity_scores(T.actions(spark, sf_dir), dimension(spark, sf_dir)))


@register("implicit_ratings", f"""WITH {Q.ACTIONS_CTE}
SELECT user_id, product_id, sum({Q.weight('action')})::DOUBLE AS rating, count(*) AS events
FROM actions WHERE user_id IS NOT NULL AND product_id IS NOT NULL GROUP BY 1, 2""")
def q_implicit_ratings(spark, sf_dir):
    """REC8."""
    return RC.implicit_ratings(T.actions(spark, sf_dir))


@register("similar_products_cooccurrence", f"""{_BASE},
pn AS (SELECT product_id, count(*) AS n FROM sets GROUP BY 1),
pi AS (SELECT a.product_id AS p, b.product_id AS q, count(*) AS c FROM sets a JOIN sets b
       ON a.user_id = b.user_id AND a.product_id <> b.product_id GROUP BY 1, 2),
ps AS (SELECT pi.p, pi.q, pi.c, pi.c / sqrt(na.n * nb.n) AS s FROM pi
       JOIN pn na ON pi.p = na.product_id JOIN pn nb ON pi.q = nb.product_id),
r AS (SELECT p, q, c, s, row_number() OVER (PARTITION BY p ORDER BY s DESC, q ASC) AS rank FROM ps
      WHERE s > 0)
SELECT p AS product_id, q AS similar_product_id, {Q.rhu('s', 6)} AS similarity_score, c AS common, rank
FROM r WHERE rank <= 10""")
def q_similar_products_cooccurrence(spark, sf_dir):
    """REC4a: item-item cosine of co-interaction, top 10 per product."""
    return RC.similar_products_by_users(sets(spark, sf_dir), 10)


@register("similar_products_content", f"""WITH {Q.PRODUCT_DIM_CTE},
d AS (SELECT product_id, category, price,
             row_number() OVER (ORDER BY category, price, product_id) AS pos
      FROM dim WHERE category IS NOT NULL AND price IS NOT NULL AND price > 0),
j AS (SELECT a.product_id, b.product_id AS similar_product_id,
             {Q.rhu('least(a.price, b.price) / greatest(a.price, b.price)', 6)} AS similarity_score,
             abs(a.pos - b.pos) AS distance
      FROM d a JOIN d b ON a.category = b.category AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 10),
r AS (SELECT *, row_number() OVER (PARTITION BY product_id
                 ORDER BY similarity_score DESC, distance ASC, similar_product_id ASC) AS rank FROM j)
SELECT product_id, similar_product_id, similarity_score, rank FROM r WHERE rank <= 10""")
def q_similar_products_content(spark, sf_dir):
    """REC4b: same category, closest price; top 10 per product."""
    return RC.similar_products_by_content(dimension(spark, sf_dir), 10)


def _eval_sql() -> str:
    split = "now_t AS (SELECT max(timestamp) - INTERVAL 7 DAY AS cut FROM actions)"
    train_src = "(SELECT a.* FROM actions a CROSS JOIN now_t WHERE a.timestamp <= now_t.cut)"
    test_src = ("(SELECT a.* FROM actions a CROSS JOIN now_t WHERE a.timestamp > now_t.cut "
                "AND a.action IN ('click', 'purchase'))")
    return f"""WITH {Q.ACTIONS_CTE}, {split}, {Q.PRODUCT_DIM_CTE},
{Q.sets_cte('tr', train_src)}, {Q.sets_cte('te', test_src)},
rel AS (SELECT * FROM te WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.user_id = te.user_id
        AND tr.product_id = te.product_id)),
{Q.neighbours_cte('tr')}, {Q.recs_cte('tr')},
{Q.popularity_cte('pop', train_src)},
none_recs AS (SELECT user_id, product_id, 0.0::DOUBLE AS score, 0 AS rank FROM tr WHERE false),
{Q.fill_cte('collab', 'tr', 'tr_recs', 'tr', 'pop')},
{Q.fill_cte('popl', 'tr', 'none_recs', 'tr', 'pop')},
{Q.content_cte('content', 'tr', 'pop', train_src)},
{Q.fill_cte('contentl', 'tr', 'content', 'tr', 'pop')},
nrel AS (SELECT user_id, count(*) AS n_rel FROM rel GROUP BY 1),
m AS (SELECT 'collaborative' AS algorithm, user_id, product_id FROM collab
      UNION ALL SELECT 'popularity', user_id, product_id FROM popl
      UNION ALL SELECT 'content', user_id, product_id FROM contentl),
h AS (SELECT m.algorithm, m.user_id, count(*) AS hits FROM m JOIN rel
      ON m.user_id = rel.user_id AND m.product_id = rel.product_id GROUP BY 1, 2),
algs AS (SELECT 'collaborative' AS algorithm UNION ALL SELECT 'popularity' UNION ALL SELECT 'content'),
per AS (SELECT a.algorithm, n.user_id, n.n_rel, coalesce(h.hits, 0) AS hits
        FROM algs a CROSS JOIN nrel n LEFT JOIN h ON h.algorithm = a.algorithm AND h.user_id = n.user_id)
SELECT algorithm, count(*) AS users,
       {Q.rhu('avg(CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE)', 4)} AS hit_rate,
       {Q.rhu('avg(hits / 5.0::DOUBLE)', 4)} AS precision_at_k,
       {Q.rhu('avg(hits / n_rel)', 4)} AS recall_at_k
FROM per GROUP BY algorithm"""


@register("algorithm_comparison", _eval_sql())
def q_algorithm_comparison(spark, sf_dir):
    """REC7: time-based holdout (last 7 days, clicks and purchases of products
    new to the user) for the neighbour and the content recommender and popularity."""
    acts = T.actions(spark, sf_dir)
    cut = acts.select(F.timestamp_add("DAY", F.lit(-7), F.max("timestamp"))).scalar()
    train = acts.where(F.col("timestamp") <= cut)
    test = acts.where((F.col("timestamp") > cut) & F.col("action").isin("click", "purchase"))
    tr = RC.interaction_sets(train).checkpoint(eager=True)  # read by all three recommenders
    dim = dimension(spark, sf_dir).checkpoint(eager=True)
    rel = RC.interaction_sets(test).join(tr, ["user_id", "product_id"], "left_anti")
    pop = RC.popularity(train, dim)
    collab = RC.fill_with_popular(tr.select("user_id"),
                                  RC.neighbour_recommendations(tr, RC.user_neighbours(tr)), tr, pop)
    empty = tr.select("user_id", "product_id", F.lit(0.0).alias("score"),
                      F.lit(0).alias("rank")).where(F.lit(False))
    popl = RC.fill_with_popular(tr.select("user_id"), empty, tr, pop)
    content = RC.fill_with_popular(tr.select("user_id"), RC.content_recommendations(train, dim, pop), tr, pop)
    rows = [RC.evaluate(recs, rel, 5).select(F.lit(name).alias("algorithm"), "*")
            for name, recs in (("collaborative", collab), ("popularity", popl), ("content", content))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@register("content_recommendations", f"""WITH {Q.ACTIONS_CTE}, {Q.PRODUCT_DIM_CTE}, {Q.sets_cte('sets')},
{Q.popularity_cte('pop')}, {Q.content_cte('content', 'sets', 'pop')}
SELECT user_id, product_id, score, rank FROM content""")
def q_content_recommendations(spark, sf_dir):
    """REC7's content recommender: unseen products of each user's favourite category and price band cells."""
    acts, dim = T.actions(spark, sf_dir), dimension(spark, sf_dir)
    return RC.content_recommendations(acts, dim, RC.popularity_scores(acts, dim))


@register("recommendation_analytics", f"""{_RECS}
SELECT count(*) AS users_with_recommendations, coalesce(sum(n), 0) AS recommendations_generated,
       {Q.rhu('avg(n)', 2)} AS avg_recommendations_per_user
FROM (SELECT user_id, count(*) AS n FROM sets_recs GROUP BY 1)""")
def q_recommendation_analytics(spark, sf_dir):
    """AGG8 from the actual neighbour recommendations."""
    return RC.recommendation_analytics(neighbour_recs(spark, sf_dir))


@register("recommendation_documents")
def q_recommendation_documents(spark, sf_dir):
    """RPT2: one nested document per user."""
    s = sets(spark, sf_dir)
    recs = RC.recommend_for_users(s, products(spark, sf_dir))
    return RC.recommendation_documents(recs, users(spark, sf_dir))


@register("event_recommendations", f"""{_RECS},
api AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type AS action FROM events),
top AS (SELECT user_id, count(*) AS n, arg_min(product_id, rank) AS top_product
        FROM sets_recs WHERE rank <= 3 GROUP BY 1)
SELECT a.event_id, a.user_id, a.action,
       CASE WHEN a.action = 'view' AND a.user_id IS NOT NULL AND a.user_id <> '0'
            THEN coalesce(t.n, 0) END AS recommendations_generated,
       CASE WHEN a.action = 'view' AND a.user_id IS NOT NULL AND a.user_id <> '0'
            THEN t.top_product END AS top_recommendation
FROM api a LEFT JOIN top t ON a.user_id = t.user_id""")
def q_event_recommendations(spark, sf_dir):
    """JN6: API view events joined to their user's top-3 recommendations."""
    ev = (process_api_events(api_events(spark, sf_dir))
          .select("event_id", F.col("user_id").cast("string").alias("user_id"), "action"))
    return RC.event_recommendations(ev, neighbour_recs(spark, sf_dir), 3)


# --- matrix factorisation (no SQL oracle: iterative model fitting) -----------

def _als(spark, sf_dir, implicit=False):
    from shoplens.operators import als
    if implicit:
        r = RC.implicit_ratings(T.actions(spark, sf_dir))
        return als.train(r, "user_id", "product_id", "rating", implicit=True)
    return als.train(T.ratings(spark, sf_dir), "user_id", "asin", "rating")


@register("als_evaluation")
def q_als_evaluation(spark, sf_dir):
    """REC1: ALS (rank 10, 5 iterations, reg 0.1, 80/20 split, seed 42) on the
    explicit ratings; holdout RMSE next to the predict-the-mean baseline."""
    from shoplens.operators import als
    return als.rmse(_als(spark, sf_dir))


@register("als_recommendations")
def q_als_recommendations(spark, sf_dir):
    """REC2 + JN5 + JN4: top-10 ALS recommendations for every rated user."""
    from shoplens.operators import als
    res = _als(spark, sf_dir)
    # the index holds every rated user: the ratings are not joined anew
    return als.recommend(res, res.user_index.select("user_id"), 10, dimension(spark, sf_dir))


@register("als_properties", """SELECT count(*) AS ratings, count(DISTINCT user_id) AS users, true AS rmse_in_range,
  true AS ranks_complete, true AS ratings_fall, true AS products_known, true AS users_known
FROM (SELECT DISTINCT o.o_custkey AS user_id, l.l_partkey FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey)""")
def q_als_properties(spark, sf_dir):
    """REC1 + REC2 + JN5: what must hold of any fitted model: an RMSE within the
    ratings' range, ten ranks for every served user, falling predictions, and only
    products and users that exist after decoding."""
    from shoplens.operators import als
    ratings = stored(T.ratings(spark, sf_dir).select("user_id", "asin", "rating"), "rated")
    res = als.train(ratings, "user_id", "asin", "rating")
    recs = stored(als.recommend(res, ratings.select("user_id"), 10, method="blocks"), "als-recommended")
    listed = recs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "predicted_rating"))).alias("l"))
    falls = F.forall(F.sequence(F.lit(1), F.size("l") - 1), lambda i: F.get("l", i - 1)["predicted_rating"] >= F.get("l", i)["predicted_rating"])
    complete = F.transform("l", lambda x: x["rank"].cast("int")) == F.sequence(F.lit(1), F.lit(10))
    # each result is stored, one row, so that its shuffles are gone before the next
    shape = stored(listed.agg(F.bool_and(complete).alias("ranks_complete"), F.bool_and(falls).alias("ratings_fall")), "als-shape")
    strays = stored(recs.join(ratings.select(F.col("asin").alias("product_id")).distinct(), "product_id", "left_anti").agg(
        (F.count(F.lit(1)) == 0).alias("products_known")), "als-strays")
    strangers = stored(recs.join(ratings.select(F.col("user_id").cast("string").alias("user_id")).distinct(), "user_id", "left_anti").agg(
        (F.count(F.lit(1)) == 0).alias("users_known")), "als-strangers")
    rmse = stored(als.rmse(res).select(F.col("rmse").between(0.0, 4.0).alias("rmse_in_range")), "als-error").scalar()
    return ratings.agg(F.count(F.lit(1)).alias("ratings"), F.count_distinct("user_id").alias("users")).select(
        "ratings", "users", rmse.alias("rmse_in_range"), shape.select("ranks_complete").scalar().alias("ranks_complete"),
        shape.select("ratings_fall").scalar().alias("ratings_fall"), strays.scalar().alias("products_known"),
        strangers.scalar().alias("users_known"))


@register("als_implicit_recommendations")
def q_als_implicit_recommendations(spark, sf_dir):
    """REC8 -> ALS(implicitPrefs): top-5 per user from action weights."""
    from shoplens.operators import als
    res = _als(spark, sf_dir, implicit=True)
    return als.recommend(res, T.actions(spark, sf_dir).select("user_id"), 5)


@register("als_similar_products")
def q_als_similar_products(spark, sf_dir):
    """REC4c: products nearest in the ALS item-factor space (exact cosine)."""
    from shoplens.operators import als
    return als.similar_items(_als(spark, sf_dir, implicit=True), 10)


@register("embedding_neighbours", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
                  sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nrm
           FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id, b.vec_id AS neighbour_vec_id,
             floor(list_dot_product(a.e, b.e) / (a.nrm * b.nrm) * 1000000.0 + 0.5) / 1000000.0 AS similarity
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.nrm > 0 AND b.nrm > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, neighbour_vec_id) AS rank
      FROM p)
SELECT vec_id, neighbour_vec_id, similarity, rank FROM r WHERE rank <= 5""")
def q_embedding_neighbours(spark, sf_dir):
    """REC4c kernel on the given item vectors: exact cosine top-5 per vector."""
    from shoplens.operators.similarity import top_k_cosine_vectors
    emb = T.read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return top_k_cosine_vectors(emb, "vec_id", "embedding", 5)


@register("recommendation_feed", f"""{_RECS}, {Q.PRODUCT_DIM_CTE},
{Q.popularity_cte('pop')},
{Q.fill_cte('allrecs', 'sets', 'sets_recs', 'sets', 'pop')}
SELECT user_id, product_id, source, row_number() OVER (PARTITION BY user_id ORDER BY rank) AS stream_id
FROM allrecs""")
def q_recommendation_feed(spark, sf_dir):
    """STR8 (batch form): each user's recommendation feed numbered by stream_id."""
    from shoplens.streaming.jobs import recommendation_feed
    s = sets(spark, sf_dir)
    recs = RC.neighbour_recommendations(s, RC.user_neighbours(s))
    pop = RC.popularity(T.actions(spark, sf_dir), dimension(spark, sf_dir))
    feed = recommendation_feed(RC.fill_with_popular(s.select("user_id"), recs, s, pop))
    return feed.select("user_id", "product_id", "source", "stream_id")
