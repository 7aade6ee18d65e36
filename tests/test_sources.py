"""File sources: CSV, encoding fallback, load_first, catalogue, JSON documents."""

import os
import tempfile

import pytest

from shoplens import schemas
from shoplens.operators import events as E
from shoplens.sources import files as FS
from shoplens.sinks import writers as W


def test_encoding_fallback(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-enc-")
    path = os.path.join(folder, "latin.csv")
    with open(path, "wb") as f:
        f.write("name,city\nJosé,Zürich\n".encode("latin-1"))
    df = FS.read_csv_any_encoding(spark, path)
    assert df.collect()[0].asDict() == {"name": "José", "city": "Zürich"}


def test_load_first_and_catalogue(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-src-")
    small = os.path.join(folder, "small.csv")
    big = os.path.join(folder, "big.csv")
    with open(small, "w") as f:
        f.write("user_id,asin,rating\n1,A,4\n")
    with open(big, "w") as f:
        f.write("user_id,asin,rating\n" + "".join(f"{i},B{i},{i % 5 + 1}\n" for i in range(100)))
    df = FS.load_first(spark, [lambda s: s.read.parquet(os.path.join(folder, "nope")),
                               lambda s: FS.read_csv(s, small, "user_id long, asin string, rating float")])
    assert df.count() == 1
    cat = FS.file_catalogue(spark, folder)
    assert cat.count() == 2
    assert FS.largest_file(cat).first().filename == "big.csv"
    by_name = {r.filename: r for r in FS.with_columns_and_sample(spark, cat, folder).collect()}
    assert by_name["big.csv"].columns == ["user_id", "asin", "rating"]
    assert by_name["big.csv"].sample == ["0,B0,1", "1,B1,2", "2,B2,3"] and by_name["small.csv"].sample == ["1,A,4"]
    with pytest.raises(FileNotFoundError):
        FS.load_first(spark, [lambda s: s.read.parquet(os.path.join(folder, "nope"))])


def test_column_resolution():
    assert E.resolve_columns(["reviewerID", "asin", "overall", "reviewText", "x"]) == {
        "user_id": "reviewerID", "product_id": "asin", "rating": "overall", "review_text": "reviewText"}
    assert E.resolve_columns(["a", "b", "c", "d"]) == {"user_id": "a", "product_id": "b", "rating": "c"}
    assert E.resolve_columns(["title", "x"]) == {"title": "title"}


def test_json_documents_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-json-")
    df = spark.createDataFrame([(i, f"A{i}", float(i % 5), None) for i in range(25)],
                               "user_id int, asin string, rating double, timestamp string")
    W.write_json_documents(df, folder, rows_per_document=10)
    back = FS.read_json_documents(spark, folder, schemas.JSON_RATING)
    assert back.count() == 25
    assert back.exceptAll(df).count() == 0


def test_ml_config(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-cfg-")
    path = os.path.join(folder, "ml_config.json")
    with open(path, "w") as f:
        f.write('{"als_max_iter": 10, "als_reg_param": 0.1, "recommendation_limit": 10, '
                '"similarity_threshold": 0.7}')
    assert FS.read_ml_config(spark, path)["als_max_iter"] == 10


def test_json_documents_hold_a_bounded_number_of_equal_rows(spark):
    folder = tempfile.mkdtemp(prefix="shoplens-json-")
    df = spark.createDataFrame([(1, "A", 1.0, None)] * 95, "user_id int, asin string, rating double, timestamp string")
    W.write_json_documents(df, folder, rows_per_document=10)
    back = spark.read.schema(schemas.JSON_RATING).option("multiLine", True).json(folder)
    assert back.count() == 95 and back.groupBy("doc").count().where("count > 10").count() == 0
