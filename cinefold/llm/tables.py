"""Reading, scratch tables and connected components, as the operators share them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.session import scratch_path


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared scratch folder and read from there: computed once, and whole
    when an executor that made a part of it is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Only the id, as bigint, and the text, so that no other column can clash."""
    return docs.select(docs[id_column].cast("bigint").alias("doc_id"),
                       docs[text_column].cast("string").alias("text"))


# Words of 64 bits in the filters below: at most 4 MB, whatever is put in.
FILTER_WORDS = 1 << 18


def _bit(key: F.Column) -> tuple[F.Column, F.Column]:
    mark = F.xxhash64(key)
    return (F.pmod(mark, F.lit(FILTER_WORDS)),
            F.shiftright(mark, 40).bitwiseAND(F.lit(63)).cast("int"))


def maybe_in(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """`df` with a boolean `maybe`: false only for rows whose `key` is not in `found`, which has
    one column. The filter is a bitmap of fixed size, broadcast as a table of its words, so rows
    that a join would drop need not be shuffled; an exact join has to follow."""
    word, bit = _bit(found[found.columns[0]])
    bits = found.select(word.alias("filter_word"), F.expr("1L").alias("one"), bit.alias("bit"))
    bits = bits.groupBy("filter_word").agg(
        F.bit_or(F.expr("shiftleft(one, bit)")).alias("filter_bits"))
    word, bit = _bit(df[key])
    rows = df.withColumns({"filter_at": word, "filter_bit": bit})
    rows = rows.join(F.broadcast(bits), F.col("filter_at") == F.col("filter_word"), "left")
    hit = F.expr("coalesce(shiftright(filter_bits, filter_bit) & 1, 0) = 1")
    return rows.withColumn("maybe", hit).drop(
        "filter_at", "filter_bit", "filter_word", "filter_bits")


def same(df: DataFrame) -> tuple:
    """A digest of all rows of an edge table, for telling whether a round changed anything."""
    mark = F.xxhash64("child", "parent")
    row = df.agg(F.count("*"), F.coalesce(F.sum(mark.cast("decimal(38,0)")), F.lit(0)),
                 F.bit_xor(mark)).first()
    return tuple(row)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """The smallest node each linked node can reach: columns node, component_id.

    Large-star and small-star steps in turn until nothing changes. Only minima are gathered at a
    node, so a hub of any degree combines on the map side and its rows are split by the skew join.
    Each round is a checkpoint, so that the plan stays short and a lost executor costs one round.
    """
    edges = _down(links.select(F.col(a).alias("x"), F.col(b).alias("y"))).checkpoint()
    mark = same(edges)
    for _ in range(rounds):
        both = edges.select(F.col("child").alias("x"), F.col("parent").alias("y")).union(
            edges.select(F.col("parent").alias("x"), F.col("child").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select(
            "x", F.least("x", "m").alias("m"))
        large = _down(both.filter("y > x").join(least, "x").select(
            F.col("y").alias("x"), F.col("m").alias("y")))
        least = large.groupBy(F.col("child").alias("x")).agg(F.min("parent").alias("m"))
        small = large.select(F.col("child").alias("x"), F.col("parent").alias("y")).join(least, "x")
        edges = _down(small.select(F.col("y").alias("x"), F.col("m").alias("y")).union(
            least.select("x", F.col("m").alias("y")))).checkpoint()
        before, mark = mark, same(edges)
        if mark == before:
            return edges.select(F.col("child").alias("node"), F.col("parent").alias("component_id"))
    raise RuntimeError(f"links did not settle in {rounds} rounds")


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.filter("x <> y").select(
        F.greatest("x", "y").alias("child"), F.least("x", "y").alias("parent")).distinct()
