"""Request streams in and out: Kafka, text files, or a table with an order column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KAFKA_DEFAULTS = {"startingOffsets": "earliest"}


def arrival(at: Column | None = None, source: Column | None = None,
            block: Column | None = None, seq: Column | None = None) -> Column:
    """A request's place in its source; the parts left out are equal for all requests."""
    zero = F.lit(0)
    return F.struct(
        F.coalesce(at if at is not None else zero, zero).cast("bigint").alias("at"),
        F.coalesce(source if source is not None else F.lit(""), F.lit("")).alias("source"),
        F.coalesce(block if block is not None else zero, zero).cast("bigint").alias("block"),
        F.coalesce(seq if seq is not None else zero, zero).cast("bigint").alias("seq"),
    )


def kafka_requests(raw: DataFrame) -> DataFrame:
    """Requests from the columns of the Kafka source."""
    partition = F.lpad(F.col("partition").cast("string"), 10, "0")
    return raw.select(
        arrival(
            at=F.unix_micros("timestamp"), source=F.concat_ws("/", "topic", partition),
            seq=F.col("offset"),
        ).alias("arrival"),
        F.col("value").cast("string").alias("value"),
    )


def request_stream(spark: SparkSession, fmt: str, options: dict[str, str]) -> DataFrame:
    """A stream of (arrival, value) with UTF-8 values, from `kafka` or `text`.

    Kafka needs `kafka.bootstrap.servers` and `subscribe`, starts at the earliest offset on
    the first run, and keeps each request's time, partition and offset; `latest_rows` tells their order. Text takes a
    `path`; its lines are numbered within each micro-batch by `with_line_order`.
    """
    if fmt == "kafka":
        return kafka_requests(
            spark.readStream.format("kafka").options(**{**KAFKA_DEFAULTS, **options}).load()
        )
    if fmt == "text":
        options = dict(options)
        path = options.pop("path")
        return spark.readStream.format("text").options(**options).load(path).select(
            arrival(
                at=F.unix_micros("_metadata.file_modification_time"),
                source=F.col("_metadata.file_path"),
                block=F.col("_metadata.file_block_start"),
            ).alias("arrival"),
            "value",
        )
    raise ValueError(f"unknown request format {fmt!r}")


def with_line_order(batch: DataFrame) -> DataFrame:
    """Number the lines of a text micro-batch, increasing within each block of a file."""
    return batch.withColumn(
        "arrival", F.col("arrival").withField("seq", F.monotonically_increasing_id())
    )


def requests_from(df: DataFrame, order: str) -> DataFrame:
    """Requests of a table, batch or stream, whose column `order` gives their sequence."""
    return df.select(arrival(seq=F.col(order)).alias("arrival"), F.col("value"))


def write_requests(df: DataFrame, fmt: str, options: dict[str, str]) -> None:
    """Send request texts to a Kafka `topic`, or append them as lines under a text `path`."""
    if fmt == "kafka":
        df.select(F.col("value").cast("binary")).write.format("kafka").options(**options).save()
    elif fmt == "text":
        df.select("value").write.mode("append").text(options["path"])
    else:
        raise ValueError(f"unknown request format {fmt!r}")
