"""Scans and Parquet sinks of the batch tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cinefold.schemas import MOVIES, RATINGS

SPLITS = ("train", "test")
SPLIT_RATINGS = StructType([*RATINGS.fields, StructField("split", StringType())])


def _cells(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The columns of a CSV file that the schema names, as text; found by the file's header."""
    # Quotes inside a quoted title are doubled, not escaped by a backslash.
    cells = spark.read.csv(path, header=True, escape='"', inferSchema=False)
    missing = [f.name for f in schema.fields if f.name not in cells.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return cells.select(*schema.names)


def _parsed(field: StructField) -> Column:
    return F.col(field.name).try_cast(field.dataType)


def _read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    if fmt == "csv":
        cells = _cells(spark, path, schema)
        return cells.select(*(_parsed(f).alias(f.name) for f in schema.fields))
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    raise ValueError(f"unknown format {fmt!r}")


def unparsed_cells(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row (column, n) per column of a CSV file: cells that hold text but no such value, which
    are read as null. One scan."""
    cells = _cells(spark, path, schema)
    counts = cells.agg(*(F.count_if(F.col(f.name).isNotNull() & _parsed(f).isNull()).alias(f.name)
                         for f in schema.fields))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).alias("n")) for n in schema.names))
    return counts.select(F.inline(rows))


def read_ratings(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return _read(spark, path, fmt, RATINGS)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """The ratings of all parts under a path that `write_splits` made, with their `split`."""
    return spark.read.schema(SPLIT_RATINGS).parquet(path)


def read_movies(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return _read(spark, path, fmt, MOVIES)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """User features or a training table; the reader's select decides which columns load."""
    return spark.read.parquet(path)


def _write_counted(df: DataFrame, path: str, *partition_by: str) -> int:
    """Overwrite `path` and return its number of rows, which only reads file footers.

    No `Observation`: once a session has used one, Spark 4.1 cannot serialize the
    `transform` of a model fitted in that session.
    """
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).count()


def write_split(df: DataFrame, path: str) -> int:
    """Write one split; returns its row count."""
    return _write_counted(df, path)


def write_splits(df: DataFrame, path: str) -> int:
    """Write all parts of a `split` column in one pass, as path/split=train and so on; a part
    without rows becomes an empty table."""
    n = _write_counted(df, path, "split")
    for name in SPLITS:
        part = f"{path.rstrip('/')}/split={name}"
        try:
            df.sparkSession.read.schema(df.schema).parquet(part)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            df.drop("split").limit(0).write.parquet(part)
    return n


def write_features(df: DataFrame, path: str) -> int:
    """Write user features or a training table; returns its row count."""
    return _write_counted(df, path)
