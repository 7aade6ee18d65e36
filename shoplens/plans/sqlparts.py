"""SQL fragments shared by the oracle queries (DuckDB dialect).

They restate the test-data mapping of ``shoplens.sources.tables`` in SQL.
"""

ACTION_WEIGHT_CASE = ("CASE {a} WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 WHEN 'cart_add' THEN 3.0 "
                      "WHEN 'purchase' THEN 5.0 WHEN 'like' THEN 4.0 WHEN 'share' THEN 3.5 ELSE 1.0 END")


def weight(col: str = "action") -> str:
    return ACTION_WEIGHT_CASE.format(a=col)


ACTIONS_CTE = """actions AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
         json_extract_string(props, '$.k') AS product_id, event_type AS action, ts AS timestamp
  FROM events)"""

PRODUCT_DIM_CTE = """stats AS (
  SELECT l_partkey, count(*) AS n_lines, avg(1 + floor((l_quantity - 1) / 10)) AS mean_rating
  FROM lineitem GROUP BY l_partkey),
dim AS (
  SELECT CAST(p.p_partkey AS VARCHAR) AS product_id, p.p_name AS title, p.p_retailprice AS price,
         floor(s.mean_rating * 10 + 0.5) / 10 AS stars, CAST(s.n_lines AS INTEGER) AS reviews,
         CAST(NULL AS BOOLEAN) AS isBestSeller, CAST(NULL AS INTEGER) AS boughtInLastMonth,
         p.p_type AS category
  FROM part p LEFT JOIN stats s ON p.p_partkey = s.l_partkey)"""

# Review rows from documents (see shoplens.sources.tables.review_rows)
REVIEWS_CTE = """reviews AS (
  SELECT 'csv_documents_' || CAST(doc_id AS VARCHAR) AS event_id, doc_id AS row_index,
         CAST(doc_id % 150 AS VARCHAR) AS user_id, CAST(doc_id % 100 AS VARCHAR) AS product_id,
         CAST(1 + doc_id % 5 AS VARCHAR) AS rating, text AS review_text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS timestamp
  FROM documents)"""


def trend_cte(days: int) -> str:
    return f"""now_t AS (SELECT max(ts) AS now FROM events),
tw AS (
  SELECT a.product_id, a.action, a.timestamp AS ts, {weight('a.action')} AS wt, n.now
  FROM actions a CROSS JOIN now_t n WHERE a.product_id IS NOT NULL),
tagg AS (
  SELECT product_id,
         sum(CASE WHEN ts > now - INTERVAL {days} DAY THEN wt ELSE 0.0 END) AS raw,
         sum(CASE WHEN ts > now - INTERVAL {2 * days} DAY AND ts <= now - INTERVAL {days} DAY
                  THEN wt ELSE 0.0 END) AS prev,
         count(*) FILTER (WHERE ts > now - INTERVAL 1 DAY AND action = 'view') AS views_today
  FROM tw WHERE ts > now - INTERVAL {2 * days} DAY GROUP BY product_id),
tmax AS (SELECT max(raw) AS top FROM tagg),
trend AS (
  SELECT product_id, floor(raw * 10000 + 0.5) / 10000 AS raw_score,
         CASE WHEN top > 0 THEN floor(raw / top * 10000 + 0.5) / 10000 ELSE 0.0 END AS trend_score,
         CASE WHEN prev > 0 THEN floor(100.0 * (raw - prev) / prev * 100 + 0.5) / 100 END AS growth_rate,
         views_today
  FROM tagg CROSS JOIN tmax)"""


def is_numeric(col: str) -> str:
    return (f"(coalesce(regexp_matches({col}, '^[0-9.]*[0-9][0-9.]*$'), false) "
            f"AND TRY_CAST({col} AS DOUBLE) IS NOT NULL)")


def rating_value(col: str) -> str:
    return f"(CASE WHEN {is_numeric(col)} THEN TRY_CAST({col} AS DOUBLE) END)"


def rhu(expr: str, digits: int) -> str:
    """round half up, written exactly like shoplens.functions.scalars.round_half_up."""
    scale = 10 ** digits
    x = f"({expr})::DOUBLE"
    return (f"(CASE WHEN abs({x}) < {2 ** 53}.0::DOUBLE / {scale}.0::DOUBLE "
            f"THEN floor({x} * {scale}.0::DOUBLE + 0.5::DOUBLE) / {scale}.0::DOUBLE ELSE {x} END)")


# Python's str.split() blanks, spelled out: the SQL engine's \s is ASCII only.
UNICODE_BLANKS = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")


def word_hits(text: str, words: list[str]) -> str:
    parts = [f"(CASE WHEN contains(lower({text}), '{w}') THEN 1 ELSE 0 END)" for w in words]
    return "(" + " + ".join(parts) + ")"


def sentiment_columns(text: str = "review_text") -> str:
    from shoplens import constants as C
    pos = word_hits(text, C.POSITIVE_WORDS)
    neg = word_hits(text, C.NEGATIVE_WORDS)
    tokens = f"len(list_filter(string_split_regex(coalesce({text}, ''), '{UNICODE_BLANKS}'), lambda x: x <> ''))"
    has = f"(coalesce(lower({text}) <> '', false) AND ({pos} + {neg}) > 0)"
    return f"""CASE WHEN {has} THEN {rhu(f'{pos} / ({pos} + {neg})', 3)} ELSE 0.5::DOUBLE END AS sentiment_score,
  CASE WHEN {has} AND {tokens} > 0 THEN {rhu(f'({pos} + {neg}) / {tokens}', 3)} ELSE 0.0::DOUBLE END AS sentiment_confidence,
  CASE WHEN {has} THEN {pos} END AS positive_words,
  CASE WHEN {has} THEN {neg} END AS negative_words"""


def recommendation_weight(rating: str = "rating", text: str = "review_text") -> str:
    length = f"length(coalesce({text}, ''))"
    w = (f"1.0::DOUBLE * coalesce({rating_value(rating)} / 5.0::DOUBLE, 1.0::DOUBLE) * "
         f"(CASE WHEN {length} > 0 THEN 1.0::DOUBLE + least({length} / 100.0::DOUBLE, 2.0::DOUBLE) "
         f"* 0.2::DOUBLE ELSE 1.0::DOUBLE END)")
    return rhu(w, 3)


def quality_score(rating: str, text: str, meta_count: str) -> str:
    length = f"length(coalesce({text}, ''))"
    s = (f"0.5::DOUBLE + (CASE WHEN coalesce({rating}, '') <> '' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
         f" + (CASE WHEN {length} > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)"
         f" + (CASE WHEN {length} > 50 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"
         f" + least({meta_count} * 0.05::DOUBLE, 0.2::DOUBLE)")
    return rhu(f"least({s}, 1.0::DOUBLE)", 3)


def profile_cte(key: str, other: str, other_name: str) -> str:
    """Profiles of AGG1/AGG2 in SQL (window form of the stale-average rule)."""
    return f"""rv_{key} AS (
  SELECT {key}, {other}, {rating_value('rating')} AS r,
         row_number() OVER (PARTITION BY {key} ORDER BY timestamp, event_id) AS rn
  FROM reviews WHERE coalesce({key} <> '', false)),
ra_{key} AS (
  SELECT {key}, count(*) AS reviews,
         count(DISTINCT CASE WHEN coalesce({other} <> '', false) THEN {other} END) AS {other_name},
         coalesce(sum(r), 0.0::DOUBLE) AS total_rating,
         max(CASE WHEN r IS NOT NULL THEN rn END) AS upto
  FROM rv_{key} GROUP BY {key}),
ia_{key} AS (SELECT {key}, count(*) AS interactions FROM actions
             WHERE coalesce({key} <> '', false) GROUP BY {key}),
prof_{key} AS (
  SELECT coalesce(a.{key}, i.{key}) AS {key}, coalesce(a.reviews, 0) AS reviews,
         coalesce(i.interactions, 0) AS interactions, coalesce(a.{other_name}, 0) AS {other_name},
         coalesce(a.total_rating, 0.0::DOUBLE) AS total_rating,
         CASE WHEN a.upto > 0 THEN a.total_rating / a.upto ELSE 0.0::DOUBLE END AS avg_rating
  FROM ra_{key} a FULL OUTER JOIN ia_{key} i ON a.{key} = i.{key})"""


def money_mean(col: str) -> str:
    c = f"CAST(round({col} * 100.0::DOUBLE) AS BIGINT)"
    return f"(floor(sum({c}) / count({c}) + 0.5::DOUBLE) / 100.0::DOUBLE)"


def sets_cte(name: str, source: str = "actions", where: str = "") -> str:
    extra = f" AND {where}" if where else ""
    return f"""{name} AS (SELECT DISTINCT user_id, product_id FROM {source}
  WHERE coalesce(user_id <> '', false) AND coalesce(product_id <> '', false){extra})"""


def neighbours_cte(s: str, k: int = 5, threshold: float = 0.1) -> str:
    return f"""{s}_n AS (SELECT user_id, count(*) AS n FROM {s} GROUP BY user_id),
{s}_i AS (SELECT a.user_id AS u, b.user_id AS v, count(*) AS c FROM {s} a JOIN {s} b
          ON a.product_id = b.product_id AND a.user_id <> b.user_id GROUP BY 1, 2),
{s}_sim AS (SELECT i.u, i.v, i.c, i.c / (na.n + nb.n - i.c) AS similarity FROM {s}_i i
            JOIN {s}_n na ON i.u = na.user_id JOIN {s}_n nb ON i.v = nb.user_id),
{s}_nb AS (SELECT * FROM (SELECT u AS user_id, v AS neighbour_id, similarity, c AS common,
             row_number() OVER (PARTITION BY u ORDER BY similarity DESC, v ASC) AS rank
           FROM {s}_sim WHERE similarity > {threshold}) WHERE rank <= {k})"""


def recs_cte(s: str, k: int = 5) -> str:
    return f"""{s}_cand AS (
  SELECT nb.user_id, x.product_id, {rhu('sum(nb.similarity)', 6)} AS score
  FROM {s}_nb nb JOIN {s} x ON x.user_id = nb.neighbour_id
  WHERE NOT EXISTS (SELECT 1 FROM {s} y WHERE y.user_id = nb.user_id AND y.product_id = x.product_id)
  GROUP BY 1, 2),
{s}_recs AS (SELECT * FROM (SELECT user_id, product_id, score,
               row_number() OVER (PARTITION BY user_id ORDER BY score DESC, product_id ASC) AS rank
             FROM {s}_cand) WHERE rank <= {k})"""


def popularity_cte(name: str, source: str = "actions", with_dim: bool = True) -> str:
    if with_dim:
        base = f"""SELECT coalesce(d.product_id, s.product_id) AS product_id,
                  coalesce(s.p, 0.0::DOUBLE) AS popularity
           FROM (SELECT DISTINCT product_id FROM dim) d FULL JOIN
                (SELECT product_id, sum({weight('action')})::DOUBLE AS p FROM {source}
                 WHERE product_id IS NOT NULL GROUP BY 1) s ON d.product_id = s.product_id"""
    else:
        base = f"""SELECT product_id, sum({weight('action')})::DOUBLE AS popularity FROM {source}
           WHERE product_id IS NOT NULL GROUP BY 1"""
    return f"""{name} AS (SELECT product_id, popularity,
  row_number() OVER (ORDER BY popularity DESC, product_id ASC) AS pop_rank FROM ({base}))"""


def fill_cte(name: str, users: str, recs: str, seen: str, pop: str, k: int = 5) -> str:
    return f"""{name}_own AS (SELECT user_id, count(*) AS n_own FROM {recs} GROUP BY user_id),
{name}_excl AS (SELECT user_id, product_id FROM {seen} UNION SELECT user_id, product_id FROM {recs}),
{name}_free AS (
  SELECT u.user_id, p.product_id, p.popularity, p.pop_rank, coalesce(o.n_own, 0) AS n_own
  FROM (SELECT DISTINCT user_id FROM {users}) u CROSS JOIN {pop} p
  LEFT JOIN {name}_own o ON o.user_id = u.user_id
  WHERE NOT EXISTS (SELECT 1 FROM {name}_excl e WHERE e.user_id = u.user_id AND e.product_id = p.product_id)),
{name}_fill AS (SELECT * FROM (SELECT user_id, product_id, popularity, n_own,
                  row_number() OVER (PARTITION BY user_id ORDER BY pop_rank) AS i FROM {name}_free)
                WHERE i <= {k} - n_own),
{name} AS (
  SELECT user_id, product_id, CAST(score AS DOUBLE) AS score, CAST(rank AS BIGINT) AS rank,
         'collaborative' AS source FROM {recs}
  UNION ALL
  SELECT user_id, product_id, popularity, CAST(n_own + i AS BIGINT), 'popularity' FROM {name}_fill)"""


def content_cte(name: str, seen: str, pop: str, source: str = "actions", k: int = 5) -> str:
    """Content recommendations over ``seen`` (user, product), ``pop`` and the dimension."""
    return f"""{name}_cells AS (SELECT product_id, category, CAST(floor(price / 100.0::DOUBLE) AS BIGINT) AS band FROM dim
  WHERE category IS NOT NULL AND price IS NOT NULL),
{name}_w AS (SELECT a.user_id, c.category, c.band, sum({weight('a.action')})::DOUBLE AS w FROM {source} a
  JOIN {name}_cells c ON a.product_id = c.product_id WHERE coalesce(a.user_id <> '', false) GROUP BY ALL),
{name}_t AS (SELECT user_id, category, band, {rhu('w / sum(w) OVER (PARTITION BY user_id)', 6)} AS taste FROM {name}_w),
{name}_i AS (SELECT c.*, row_number() OVER (PARTITION BY category, band ORDER BY coalesce(p.popularity, 0) DESC, c.product_id) AS place
  FROM {name}_cells c LEFT JOIN {pop} p ON p.product_id = c.product_id),
{name} AS (SELECT user_id, product_id, taste AS score, rank FROM (
  SELECT t.user_id, i.product_id, t.taste, row_number() OVER (PARTITION BY t.user_id
    ORDER BY t.taste DESC, i.place, t.category, t.band, i.product_id) AS rank
  FROM {name}_t t JOIN {name}_i i ON i.category = t.category AND i.band = t.band
  WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = t.user_id AND s.product_id = i.product_id)) WHERE rank <= {k})"""
