"""Row counts and schemas as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row (name, n) per table."""
    counts = [
        df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_parts(df: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """One row (name, n) per part, a condition on the rows, all counted in one pass."""
    counted = df.agg(*(F.count_if(when).alias(f"n{i}") for i, when in enumerate(parts.values())))
    rows = F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"n{i}").alias("n"))
                     for i, name in enumerate(parts)))
    return counted.select(F.inline(rows))


def describe_table(df: DataFrame) -> DataFrame:
    """One row (column, type, nullable) per column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, type string, nullable boolean")
