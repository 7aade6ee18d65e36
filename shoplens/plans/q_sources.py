"""Source/sink round trips over data derived from the given tables.

Each query writes a table derived from the test data to the shared checkpoint
folder and reads it back through the reader under test, so the reader runs on
data that grows with the inputs.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from shoplens import schemas
from shoplens.operators import catalog
from shoplens.plans import sqlparts as Q
from shoplens.plans.registry import register
from shoplens.session import scratch_path
from shoplens.sinks import writers as W
from shoplens.sources import files as FS
from shoplens.sources import tables as T


def _scratch(spark, sf_dir, name, run=None):
    """A per-call folder under the shared checkpoint folder, so a lazily read
    result of one call is never overwritten by another call."""
    run = run or uuid.uuid4().hex[:12]
    return scratch_path(spark, os.path.join(os.path.basename(os.path.normpath(sf_dir)), run, name))


def _write_catalogue_csv(spark, sf_dir, run=None):
    run = run or uuid.uuid4().hex[:12]
    prod = _scratch(spark, sf_dir, "bronze/products_csv", run)
    cats = _scratch(spark, sf_dir, "bronze/categories_csv", run)
    W.write_csv_sample(T.products_raw(spark, sf_dir), prod)
    W.write_csv_sample(T.categories_raw(spark, sf_dir), cats)
    return prod, cats


@register("csv_catalogue_etl", f"WITH {Q.PRODUCT_DIM_CTE} SELECT * FROM dim")
def q_csv_catalogue_etl(spark, sf_dir):
    """SRC1 + SNK5 + PRJ1/PRJ2/JN1 + SNK1: the catalogue ETL from CSV files
    (bronze) to the written gold dimension, read back."""
    run = uuid.uuid4().hex[:12]
    prod, cats = _write_catalogue_csv(spark, sf_dir, run)
    products = FS.read_csv(spark, prod, schemas.PRODUCT_TEXT)
    categories = FS.read_csv(spark, cats, schemas.CATEGORY)
    gold = _scratch(spark, sf_dir, "gold/products_dimension", run)
    W.write_table(catalog.product_dimension(products, categories), gold, "parquet")
    return spark.read.parquet(gold)


@register("json_document_products", f"""WITH {Q.PRODUCT_DIM_CTE}
SELECT product_id AS asin, title, category, price, stars, reviews, p.p_brand AS brand,
       CAST(NULL AS VARCHAR) AS description, CAST(NULL AS VARCHAR) AS timestamp
FROM dim JOIN part p ON dim.product_id = CAST(p.p_partkey AS VARCHAR)""")
def q_json_document_products(spark, sf_dir):
    """SRC2: products written as JSON array documents, read back multiLine with
    the declared JSON product schema."""
    from shoplens.plans.q_catalog import dimension
    dim = dimension(spark, sf_dir)
    brand = T.read_table(spark, sf_dir, "part", ["p_partkey", "p_brand"]).select(
        F.col("p_partkey").cast("string").alias("product_id"), F.col("p_brand").alias("brand"))
    docs = dim.join(brand, "product_id").select(
        F.col("product_id").alias("asin"), "title", "category", "price", "stars", "reviews", "brand")
    path = _scratch(spark, sf_dir, "bronze/products_json")
    W.write_json_documents(docs, path, rows_per_document=50_000)
    return FS.read_json_documents(spark, path, schemas.JSON_PRODUCT)


@register("source_fallback", f"WITH {Q.PRODUCT_DIM_CTE} SELECT * FROM dim")
def q_source_fallback(spark, sf_dir):
    """SRC3: the object-store copy is missing, so the local CSV copy is used."""
    run = uuid.uuid4().hex[:12]
    prod, cats = _write_catalogue_csv(spark, sf_dir, run)
    missing = _scratch(spark, sf_dir, "object-store/does-not-exist", run)
    products = FS.load_first(spark, [
        lambda s: s.read.schema(schemas.PRODUCT_TEXT).parquet(missing),
        lambda s: FS.read_csv(s, prod, schemas.PRODUCT_TEXT),
    ])
    return catalog.product_dimension(products, FS.read_csv(spark, cats, schemas.CATEGORY))


@register("file_catalogue")
def q_file_catalogue(spark, sf_dir):
    """SRC4 + SRC5: catalogue of the written CSV files with their columns and first lines, largest first."""
    prod, _ = _write_catalogue_csv(spark, sf_dir)
    folder = os.path.dirname(prod)
    cat = FS.with_columns_and_sample(spark, FS.file_catalogue(spark, folder, "*.csv"), folder)
    return cat.orderBy(F.desc("length"), F.asc("path"))


@register("file_catalogue_by_folder", f"""
SELECT 'products_csv' AS folder, '{",".join(f.split()[0] for f in schemas.PRODUCT_TEXT.split(", "))}' AS columns,
  true AS holds_largest, true AS samples_are_rows
UNION ALL SELECT 'categories_csv', 'id,category_name', false, true""")
def q_file_catalogue_by_folder(spark, sf_dir):
    """SRC4 + SRC5: per folder of the catalogue its files' columns, whether the
    largest file lies there, and whether every sampled line is a row of a file."""
    prod, _ = _write_catalogue_csv(spark, sf_dir)
    folder = os.path.dirname(prod)
    cat = FS.with_columns_and_sample(spark, FS.file_catalogue(spark, folder, "*.csv"), folder).withColumn(
        "folder", F.element_at(F.split("path", "/"), -2)).checkpoint(eager=True)
    largest = FS.largest_file(cat).select(F.col("folder").alias("largest"))
    lines = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", True).text(folder) \
        .select(FS.plain_path(F.col("_metadata.file_path")).alias("path"), "value").distinct()
    found = cat.select("folder", "path", F.explode("sample").alias("value")).join(
        lines.withColumn("found", F.lit(True)), ["path", "value"], "left")
    checked = found.groupBy("folder").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("samples_are_rows"))
    heads = cat.groupBy("folder").agg(F.max(F.array_join("columns", ",")).alias("columns"),
                                      F.count_distinct("columns").alias("kinds"))
    return heads.where("kinds = 1").join(checked, "folder").join(F.broadcast(largest), F.col("folder") == F.col("largest"), "left") \
        .select("folder", "columns", F.col("largest").isNotNull().alias("holds_largest"), "samples_are_rows")


@register("mixed_encodings", r"""
SELECT doc_id, text, lang, CASE WHEN doc_id % 2 = 1 AND NOT regexp_matches(coalesce(text, ''), '[^\x00-\x{FF}]')
  AND regexp_matches(coalesce(text, ''), '[\x{80}-\x{FF}]') THEN 'latin-1' ELSE 'utf-8' END AS encoding
FROM documents WHERE text IS NOT NULL AND text <> ''""")
def q_mixed_encodings(spark, sf_dir):
    """SRC6: documents written as CSV files, some in UTF-8 and some in Latin-1,
    read back in one query, each file in its own encoding."""
    docs = T.read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).where("text is not null and text <> ''")
    odd = (F.col("doc_id") % 2 == 1) & ~F.col("text").rlike(r"[^\x{0}-\x{FF}]") & F.col("text").rlike(r"[\x{80}-\x{FF}]")
    encoding = F.when(odd, F.lit("latin-1")).otherwise(F.lit("utf-8"))
    folder = _scratch(spark, sf_dir, "bronze/mixed_csv")
    rows = docs.withColumn("encoding", encoding)
    style = {"escape": '"', "header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    for name, charset in FS.JAVA_CHARSETS.items():
        if name in ("utf-8", "latin-1"):
            rows.where(F.col("encoding") == name).write.options(**style, encoding=charset, lineSep="\n").csv(f"{folder}/{name}")
    return FS.read_csv_any_encoding(spark, folder, "doc_id long, text string, lang string, encoding string",
                                    options={"escape": '"', "multiLine": True})


@register("configured_recommendations", f"""WITH {Q.ACTIONS_CTE}, {Q.sets_cte('sets')}, {Q.neighbours_cte('sets', 5, 0.4)},
{Q.recs_cte('sets', 10)}
SELECT user_id, product_id, score, rank FROM sets_recs""")
def q_configured_recommendations(spark, sf_dir):
    """SRC12: the neighbour recommender with the threshold and the length that a JSON configuration document names."""
    from shoplens.operators import recommend as RC
    path = _scratch(spark, sf_dir, "config/ml")
    settings = [(10, 0.1, 10, 0.4)]
    spark.createDataFrame(settings, schemas.ML_CONFIG).coalesce(1).write.json(path)
    config = FS.read_ml_config(spark, path)
    s = RC.interaction_sets(T.actions(spark, sf_dir))
    near = RC.user_neighbours(s, threshold=config["similarity_threshold"])
    return RC.neighbour_recommendations(s, near, config["recommendation_limit"])
