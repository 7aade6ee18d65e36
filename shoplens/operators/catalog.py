"""Catalogue ETL: clean products, join categories, produce the product dimension.

PRJ1  select / rename / try_cast of the product columns
PRJ2  category rename pair and id drop
JN1   inner equi-join products x categories (orphans drop); categories broadcast
      behind a row-count check
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


DIMENSION_COLUMNS = ["product_id", "title", "price", "stars", "reviews", "isBestSeller",
                     "boughtInLastMonth", "category"]


def clean_products(products: DataFrame) -> DataFrame:
    """PRJ1: typed projection.  ``try_cast`` turns unparseable text into null
    instead of failing the job (ANSI mode raises on a bad ``cast``)."""
    return products.select(
        F.col("asin").alias("product_id"),
        F.col("title"),
        F.col("price").try_cast("double").alias("price"),
        F.col("stars").try_cast("double").alias("stars"),
        F.col("reviews").try_cast("int").alias("reviews"),
        F.col("category_id").try_cast("long").alias("category_id"),
        F.col("isBestSeller").try_cast("boolean").alias("isBestSeller"),
        F.col("boughtInLastMonth").try_cast("int").alias("boughtInLastMonth"),
    )


def rename_categories(categories: DataFrame) -> DataFrame:
    """PRJ2: id -> cat_id, category_name -> category."""
    return categories.withColumnsRenamed({"id": "cat_id", "category_name": "category"})


def product_dimension(products: DataFrame, categories: DataFrame) -> DataFrame:
    """PRJ1 + PRJ2 + JN1: the gold product dimension.

    The join strategy follows measured sizes: the optimizer broadcasts the
    categories when their bytes allow it, else adaptive execution decides.
    """
    cleaned = clean_products(products)
    cats = rename_categories(categories.select(F.col("id").try_cast("long").alias("id"),
                                               "category_name"))
    return (cleaned.join(cats, cleaned.category_id == cats.cat_id, "inner")
            .drop("cat_id", "category_id")
            .select(*DIMENSION_COLUMNS))
