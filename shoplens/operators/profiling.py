"""Data profiling (EDA1-EDA6, TOP4, TOP5, SET3, SET4, JN7).

Each statistic is one aggregate over the table (or one distributed sort for
exact quantiles); results come back in long form (one row per column).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from shoplens.functions.scalars import round_half_up
from shoplens.operators.sequence import with_running_total


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def schema_summary(df: DataFrame) -> DataFrame:
    """EDA1: one row per column: position, name, type; ``rows`` is the table's
    row count (a scalar subquery)."""
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(df.dtypes)],
                                 "position int, column_name string, dtype string")
    return meta.withColumn("rows", df.select(F.count(F.lit(1))).scalar())


def null_counts(df: DataFrame) -> DataFrame:
    """EDA2: nulls and null percentage (2 places) per column, one pass."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    long = agg.selectExpr("_rows", f"stack({len(cols)}, {stack}) as (column_name, nulls)")
    return long.select("column_name", "nulls",
                       round_half_up(F.try_divide(F.lit(100.0) * F.col("nulls"), F.col("_rows")), 2)
                       .alias("null_pct"))


def _long_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, value)")


def exact_quantiles(df: DataFrame, cols: list[str], qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Exact linearly interpolated quantiles (as pandas/DuckDB ``quantile_cont``).

    Equal values are counted first, so a value that fills a third of a column is
    one row; the distinct (column, value) rows are sorted and their counts summed
    up across the sorted partitions.  Only the values that cover the needed ranks
    are kept, and no column's values are gathered in one task."""
    counted = (_long_numeric(df, cols).where(F.col("value").isNotNull())
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("c")))
    upto = with_running_total(counted, ["column_name", "value"], "c", "upto")
    bounds = upto.groupBy("column_name").agg(F.min(F.col("upto") - F.col("c")).alias("before"), F.sum("c").alias("n"))
    # one row per column; value covers the ranks r_first .. r_last (from 0) of its column
    j = (upto.join(F.broadcast(bounds), "column_name")
         .withColumn("r_last", F.col("upto") - F.col("before") - 1)
         .withColumn("r_first", F.col("r_last") - F.col("c") + 1))
    outs = []
    for q in qs:
        h = (F.col("n") - 1) * F.lit(q)
        lo = F.floor(h)
        hi = F.least(lo + 1, F.col("n") - 1)
        pick = j.where(((F.col("r_first") <= lo) & (F.col("r_last") >= lo)) | ((F.col("r_first") <= hi) & (F.col("r_last") >= hi)))
        g = pick.groupBy("column_name").agg(
            F.first("n").alias("n"),
            F.min_by("value", "r_first").alias("v_lo"), F.max_by("value", "r_first").alias("v_hi"))
        hh = (F.col("n") - 1) * F.lit(q)
        val = F.col("v_lo") + (hh - F.floor(hh)) * (F.col("v_hi") - F.col("v_lo"))
        outs.append(g.select("column_name", F.lit(q).alias("q"), val.alias("value")))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False,
             digits: int = 6) -> DataFrame:
    """EDA3: count, mean, sample std, min, 25/50/75 %, max per numeric column.
    ``approx=True`` uses ``percentile_approx`` instead of the exact sort."""
    cols = cols or numeric_columns(df)
    long = _long_numeric(df, cols)
    base = long.groupBy("column_name").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    if approx:
        q = long.groupBy("column_name").agg(
            F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("p"))
        q = q.select("column_name", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"),
                     F.col("p")[2].alias("p75"))
    else:
        qq = exact_quantiles(df, cols)
        q = qq.groupBy("column_name").pivot("q", [0.25, 0.5, 0.75]).agg(F.first("value"))
        q = q.select("column_name", *[F.col(f"`{x}`").alias(n) for x, n in
                                 ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
    r = lambda c: round_half_up(F.col(c), digits).alias(c)
    return (base.join(q, "column_name", "left")
            .select("column_name", "count", r("mean"), r("std"), r("min"), r("p25"), r("p50"), r("p75"),
                    r("max")))


def distinct_counts(df: DataFrame, approx: bool = False) -> DataFrame:
    """EDA4: distinct non-null values per column."""
    cols = df.columns
    fn = F.approx_count_distinct if approx else F.count_distinct
    agg = df.agg(*[fn(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', d{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, distinct_values)")


def sample_exact(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """EDA5: exactly ``n`` rows, repeatable in any engine: the rows with the
    smallest MD5 of key and seed (a top-n, so only n rows per task move)."""
    h = F.md5(F.concat_ws("-", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def missing_summary(df: DataFrame, volume_bytes: int | None = None) -> DataFrame:
    """EDA6: overall missing % (2 places), number of distinct dtypes, columns,
    rows and (when given) the on-disk volume."""
    nulls = null_counts(df)
    rows = df.select(F.count(F.lit(1))).scalar()
    cells = F.lit(len(df.columns)) * rows
    out = nulls.agg(round_half_up(F.try_divide(F.lit(100.0) * F.sum("nulls"), cells), 2)
                    .alias("missing_pct"))
    out = out.select("missing_pct", F.lit(len({t for _, t in df.dtypes})).alias("dtype_kinds"),
                     F.lit(len(df.columns)).alias("columns"), rows.alias("rows"))
    if volume_bytes is not None:
        out = out.withColumn("volume_bytes", F.lit(volume_bytes))
    return out


def top_values(df: DataFrame, cols: list[str], n: int = 3) -> DataFrame:
    """TOP4: the n most frequent non-null values per column (ties: value)."""
    outs = []
    for c in cols:
        g = (df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value"))
             .count().orderBy(F.desc("count"), F.asc("value")).limit(n))
        outs.append(g.select(F.lit(c).alias("column_name"), "value", "count"))
    res = outs[0]
    for o in outs[1:]:
        res = res.unionByName(o)
    return res


def head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """TOP5: the first n rows in key order."""
    return df.orderBy(key).limit(n)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """SET3: rows minus distinct rows (nulls compare equal)."""
    total = df.select(F.count(F.lit(1))).scalar()
    return df.dropDuplicates().agg((total - F.count(F.lit(1))).alias("duplicate_rows"),
                                   total.alias("rows"))


def column_overlap(a: DataFrame, b: DataFrame) -> dict:
    """SET4 + JN7 (names): shared columns, columns naming categories, and the
    union of dtypes -- metadata only, computed on the driver."""
    ca, cb = set(a.columns), set(b.columns)
    return {"shared": sorted(ca & cb),
            "category_like": sorted(c for c in ca | cb if "cat" in c.lower()),
            "dtypes": sorted({t for _, t in a.dtypes} | {t for _, t in b.dtypes})}


def key_overlap(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    """JN7 (data): distinct keys of a, how many of them exist in b (semi join),
    and the match percentage (2 places)."""
    ka = a.select(F.col(a_key).cast("string").alias("k")).where(F.col("k").isNotNull()).distinct()
    kb = b.select(F.col(b_key).cast("string").alias("k"))
    matched = ka.join(kb, "k", "left_semi").select(F.count(F.lit(1))).scalar()
    return ka.agg(F.count(F.lit(1)).alias("keys")).select(
        "keys", matched.alias("matched"),
        round_half_up(F.try_divide(F.lit(100.0) * matched, F.col("keys")), 2).alias("match_pct"))
