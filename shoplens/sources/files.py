"""File sources (SRC1-SRC7, SRC12): CSV, JSON documents, fallbacks, catalogue,
encoding check, and the new-file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from shoplens import constants as C


def read_csv(spark: SparkSession, path: str, schema: str | None = None, encoding: str = "utf-8") -> DataFrame:
    """SRC1: header CSV with a declared schema (no inference pass); malformed
    values become null (PERMISSIVE).  Without a schema every column is text."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("encoding", encoding)
    if schema:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC2: files that each hold one JSON array of objects (multiLine)."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select(*[f.name for f in df.schema.fields if f.name != "doc"])


def load_first(spark: SparkSession, candidates: list) -> DataFrame:
    """SRC3: the first candidate that reads.  A candidate is a callable
    ``spark -> DataFrame``; a missing path (AnalysisException) moves on."""
    errors = []
    for load in candidates:
        try:
            df = load(spark)
            df.schema  # resolve now so a missing path fails here
            return df
        except AnalysisException as e:  # noqa: PERF203
            errors.append(str(e).splitlines()[0])
    raise FileNotFoundError("no source could be read: " + "; ".join(errors))


def file_catalogue(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """SRC4: path, file name, bytes and size in MB (2 places) of every file
    under ``folder`` (recursively, no partition inference), read as file
    metadata only (``content`` is never selected)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(folder)
             .select("path", "length", "modificationTime"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "length",
                        (F.floor(F.col("length") / F.lit(1048576.0) * 100 + 0.5) / 100).alias("size_mb"),
                        "modificationTime")


def plain_path(path) -> F.Column:
    """A file's path as one text: ``file:///x`` and ``file:/x`` name the same file."""
    return F.regexp_replace(path, "^([a-z0-9]+:)/+", "$1/")


def with_columns_and_sample(spark: SparkSession, catalogue: DataFrame, folder: str, pattern: str = "*.csv",
                            sample: int = 3) -> DataFrame:
    """SRC4: the catalogue with each file's header fields and its first lines.

    The header is the line at the file's start; lines are numbered by their place
    in the file's splits, and only the first split's lines are kept, so a file is
    one group of at most ``sample`` + 1 lines after a partial top-k.
    """
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(folder).select(
        plain_path(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), "value").where("start = 0")
    w = Window.partitionBy("path").orderBy("at")
    first = lines.withColumn("row", F.row_number().over(w)).where(F.col("row") <= sample + 1)
    heads = first.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("row", "value"))).alias("lines"))
    fields = F.transform(F.split(F.col("lines")[0]["value"], ","), lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    heads = heads.select("path", fields.alias("columns"), F.slice("lines.value", 2, sample).alias("sample"))
    return catalogue.withColumn("path", plain_path(F.col("path"))).join(heads, "path", "left")


def largest_file(catalogue: DataFrame) -> DataFrame:
    """SRC5: the biggest file (ties: path)."""
    return catalogue.orderBy(F.desc("length"), F.asc("path")).limit(1)


# Java charset names of the encodings Spark's CSV reader accepts; the last one of
# the list that decodes any byte ends the search, so cp1252 is never reached.
JAVA_CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}


def file_encodings(spark: SparkSession, path: str, pattern: str = "*.csv") -> DataFrame:
    """SRC6: (path, encoding) of every file: the first of the encodings that
    decodes all its bytes.  The text source hands lines over as the bytes they
    are, so large files are tested in splits; an empty file counts as UTF-8."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    valid = lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"))
    return valid.groupBy("path").agg(F.bool_and("ok").alias("ok")).select(
        "path", F.when(F.col("ok"), F.lit(C.ENCODINGS[0])).otherwise(F.lit(C.ENCODINGS[1])).alias("encoding"))


def read_csv_any_encoding(spark: SparkSession, path: str, schema: str | None = None, pattern: str = "*.csv",
                          options: dict | None = None) -> DataFrame:
    """SRC6: header CSV files of a folder, each read in its own encoding.

    Both readings are declared; a file's rows are taken from the one that
    ``file_encodings`` names (a join on the file's path, one row per file).
    Without a schema every column is text, in the columns of the first file.
    """
    odd = file_encodings(spark, path, pattern).where(F.col("encoding") != C.ENCODINGS[0]).select("path")

    def read(encoding):
        reader = spark.read.option("header", True).option("mode", "PERMISSIVE").options(**(options or {})) \
            .option("encoding", JAVA_CHARSETS[encoding]).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        df = (reader.schema(schema) if schema else reader).csv(path)
        return df.select("*", F.col("_metadata.file_path").alias("_path"))

    utf8 = read(C.ENCODINGS[0]).join(odd, F.col("_path") == F.col("path"), "left_anti")
    other = read(C.ENCODINGS[1]).join(odd, F.col("_path") == F.col("path"), "left_semi")
    return utf8.unionByName(other).drop("_path")


def new_file_stream(spark: SparkSession, folder: str, columns: list[str], max_files: int | None = None,
                    pattern: str = "*.csv") -> DataFrame:
    """SRC7: each new CSV file in ``folder`` once, every column as text; the
    streaming checkpoint remembers the files already sent."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    reader = spark.readStream.schema(schema).option("header", True).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).csv(folder)


def read_ml_config(spark: SparkSession, path: str) -> dict:
    """SRC12: job parameters from the JSON config document (one small row)."""
    from shoplens import schemas
    row = spark.read.schema(schemas.ML_CONFIG).option("multiLine", True).json(path).first()
    return row.asDict() if row else {}
