"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of `block_words`. The
mix is a sequence of slots, each one block, in output shards. The source counts of a shard are a
multinomial draw; it is made from what each source still has to give, so the totals of all shards
are exactly the planned ones. Slot k of a source takes block `permutation(k mod blocks)`, with
another pseudorandom permutation for each pass over the source, and blocks are joined by index.
No block, and so no word, is taken more often than its source's target makes necessary: at most
`most` times.

Targets: the sources in order of code points, null last, weigh 5, 2, 1 and so on in turn and share
the size of all; no target exceeds `most` times the source's size, and the excess goes to the
others by weight until none is above.

All draws come from the seed, the ids and the texts' digests, so a rerun gives the same rows.
Null texts have no words; rows without words, and rows with a null id, which count as any other,
are returned too. Rows that agree in all columns read here are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cinefold.llm.tables import read, stored
from cinefold.llm.words import Words, blocks, mix

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK_WORDS = 64
SEED = 11
# The source table and the counts by shard pass the driver; both are bounded here.
MAX_SOURCES = 100_000
MAX_SHARDS, MIN_SHARD_SLOTS = 1 << 14, 1 << 12
TASK_SLOTS = 1 << 16
# Documents of one source are placed in chunks of so many words, or more of them where a source
# would get more than MAX_CHUNKS.
CHUNK_WORDS, MAX_CHUNKS = 1 << 18, 1 << 16


def targets(sizes: Sequence[int], weights: Sequence[float], most: int = MOST) -> list[float]:
    """Each source's words in the mix."""
    total, found = float(sum(sizes)), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[i] for i in free)
        above = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not above:
            for i in free:
                found[i] = left * weights[i] / weight
            break
        for i in above:
            found[i] = float(most * sizes[i])
        left = total - sum(found[i] for i in range(len(sizes)) if i not in free or i in above)
        free -= above
    return found


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """A pseudorandom permutation of range(size) for each key, by a Feistel network on the next
    even number of bits; what falls outside the range goes through again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2)
    half = half.astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        low, high = out[todo] & mask[todo], out[todo] >> half[todo]
        for turn in range(rounds):
            spread = mix(low ^ mix(key[todo] + np.uint64(turn)))
            low, high = (high ^ spread) & mask[todo], low
        out[todo] = low | (high << half[todo])
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, a digest of the text, and size, its number of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), batch.column("low"),
                 pa.array(Words(batch.column("text")).counts)],
                names=["doc_id", "source", "low", "size"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"),
                       docs["source"].cast("string").alias("source"),
                       F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("low"),
                       docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, low bigint, size bigint")


class Mix:
    """The mix of `docs`: `placed` has a row per document, `slots` a row per slot of the mix."""

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST,
                 block_words: int = BLOCK_WORDS, seed: int = SEED):
        self.spark, self.block_words, self.seed = docs.sparkSession, block_words, seed
        sized = stored(_sized(docs), "sized")
        self.sources = self._plan(sized, weights, most)
        self.placed = stored(self._place(sized), "placed")

    def _plan(self, sized: DataFrame, weights: Sequence[float], most: int) -> pd.DataFrame:
        rows = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1)
        rows = sorted(rows.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
        if len(rows) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        sizes = [r["size"] for r in rows]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], most)
        count = [-(-n // self.block_words) for n in sizes]
        take = [min(most * b, int(b * t / n + 0.5)) if n else 0
                for n, t, b in zip(sizes, goal, count)]
        return pd.DataFrame({"s": range(len(rows)), "source": [r["source"] for r in rows],
                             "source_size": sizes, "target": goal, "blocks": count, "take": take})

    def _place(self, sized: DataFrame) -> DataFrame:
        """Each row's place, `start`, in the words of its source."""
        table = self.spark.createDataFrame(
            [tuple(r) for r in self.sources[["s", "source", "source_size", "target"]].astype(
                object).itertuples(index=False)],
            "s int, named string, source_size bigint, target double")
        rows = sized.join(F.broadcast(table), F.col("source").eqNullSafe(F.col("named")))
        words = F.greatest(F.lit(CHUNK_WORDS), F.col("source_size") / MAX_CHUNKS)
        rows = rows.withColumn("chunk", F.pmod(
            F.xxhash64("doc_id", "low"), F.ceil((F.col("source_size") + 1) / words)))
        order = Window.partitionBy("s", "chunk").orderBy("doc_id", "low", "size")
        before = order.rowsBetween(Window.unboundedPreceding, -1)
        chunks = rows.groupBy("s", "chunk").agg(F.sum("size").alias("words"))
        ahead = Window.partitionBy("s").orderBy("chunk").rowsBetween(
            Window.unboundedPreceding, -1)
        chunks = chunks.select("s", "chunk", F.coalesce(F.sum("words").over(ahead), F.lit(0))
                               .alias("base"))
        inside = rows.withColumn("inside", F.coalesce(F.sum("size").over(before), F.lit(0)))
        return inside.join(chunks, ["s", "chunk"]).select(
            "doc_id", "low", "s", "size", "source_size", "target",
            (F.col("base") + F.col("inside")).alias("start"))

    def pieces(self) -> DataFrame:
        """The part of each block that lies in each document: words `first` to `stop`, from 0."""
        size = self.block_words
        rows = self.placed.filter("size > 0").withColumn("block", F.explode(F.sequence(
            F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))))
        return rows.select(
            "s", "block", "doc_id", "low", "start",
            F.greatest(F.lit(0), F.col("block") * size - F.col("start")).alias("first"),
            F.least(F.col("size"), (F.col("block") + 1) * size - F.col("start")).alias("stop"))

    def _counts(self) -> pd.DataFrame:
        """A row per shard and source: slots, and how many of the source came before."""
        left = self.sources["take"].to_numpy(np.int64).copy()
        total = int(left.sum())
        per_shard = max(MIN_SHARD_SLOTS, -(-total // MAX_SHARDS))
        draw, rows = np.random.default_rng(self.seed), []
        done = np.zeros_like(left)
        for shard in range(-(-total // per_shard)):
            want = min(per_shard, int(left.sum()))
            counts = np.zeros_like(left)
            while want > counts.sum():  # what a source could not give is drawn again
                rest = left - counts
                counts += draw.multinomial(want - counts.sum(), rest / rest.sum())
                counts = np.minimum(counts, left)
            at = np.cumsum(counts) - counts
            rows += [(shard, int(i), int(counts[i]), int(done[i]), int(at[i]))
                     for i in np.flatnonzero(counts)]
            left, done = left - counts, done + counts
        return pd.DataFrame(rows, columns=["shard", "s", "n", "before", "at"])

    def slots(self) -> DataFrame:
        """shard, slot, s, block: which block of which source each slot of the mix is."""
        counts, seed, step = self._counts(), self.seed, MIN_SHARD_SLOTS
        count = dict(zip(self.sources["s"], self.sources["blocks"]))
        if counts.empty:
            return self.spark.createDataFrame([], "shard bigint, slot bigint, s int, block bigint")
        counts["blocks"] = counts["s"].map(count)
        rows = self.spark.createDataFrame(
            counts, "shard bigint, s int, n bigint, before bigint, at bigint, blocks bigint")
        parts = rows.withColumn("part", F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(step).cast("bigint"))))
        tasks = 1 + int(counts["n"].sum()) // TASK_SLOTS
        parts = parts.repartition(tasks, "shard", "s", "part")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    i = np.arange(r["part"], min(r["n"], r["part"] + step))
                    k = r["before"] + i
                    size = np.full(len(k), r["blocks"])
                    key = mix(mix(np.full(len(k), seed * 1_000_003 + r["s"], np.uint64))
                              ^ (k // size).astype(np.uint64))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(k), r["shard"])), pa.array(r["at"] + i),
                         pa.array(np.full(len(k), r["s"], np.int32)),
                         pa.array(permute(k % size, size, key))],
                        names=["shard", "slot", "s", "block"])

        return parts.mapInArrow(run, "shard bigint, slot bigint, s int, block bigint")

    def mixed(self) -> DataFrame:
        """The mix: each slot's block as parts of documents, in order of shard, slot, start."""
        # The planner does not see how far documents are cut up, so it must not choose to broadcast.
        return self.slots().join(self.pieces().hint("merge"), ["s", "block"])

    def taken(self) -> DataFrame:
        """Per row of `docs`: how many words the mix takes, repeats counted."""
        found = self.mixed().groupBy("s", "start").agg(
            F.sum(F.col("stop") - F.col("first")).alias("words"))
        # Only rows with words have a place of their own.
        found = found.withColumn("full", F.lit(True))
        rows = self.placed.withColumn("full", F.col("size") > 0)
        return rows.join(found, ["s", "start", "full"], "left").select(
            "doc_id", "size", "source_size", "target",
            F.coalesce("words", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` with all its columns as the mix takes them: a text holds its words as often as they
    are taken, pass after pass, joined by one space; one that is taken whole and once is as it
    was, and a document the mix leaves out is dropped. Rows alike in id and text are taken as the
    first of them is."""
    found = Mix(docs, **options)
    times = found.mixed().groupBy("s", "start", "doc_id", "low", "first", "stop").agg(
        F.count("*").alias("times"))
    parts = times.groupBy("doc_id", "low", "s", "start").agg(
        F.sort_array(F.collect_list(F.struct("first", "stop", "times"))).alias("parts"))
    parts = parts.groupBy("doc_id", "low").agg(
        F.min(F.struct("s", "start", "parts")).alias("at")).select("doc_id", "low", "at.parts")
    parts = parts.select(F.col("doc_id").alias("id"), F.col("low").alias("digest"), "parts")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].alias("text"),
                       docs["doc_id"].cast("bigint").alias("doc_id"),
                       F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("low"))
    rows = rows.join(parts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("low") == F.col("digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = Words(batch.column("text"))
            texts = [_taken_text(w, i, parts) for i, parts in
                     enumerate(batch.column("parts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string())], names=["row", "mixed"])

    kind = rows.schema["row"].dataType
    made = rows.select("row", "text", "parts").mapInArrow(
        run, StructType([StructField("row", kind), StructField("mixed", StringType())]))
    row = F.col("row").withField("text", F.coalesce("mixed", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(
            F.col("mixed").isNotNull(), F.char_length("mixed").cast(docs.schema["n_chars"].dataType)
        ).otherwise(F.col("row.n_chars")))
    return made.select(row.alias("row")).select("row.*")


def _taken_text(w: Words, i: int, parts: list[dict]) -> str | None:
    """The words of text i that `parts` take; null if that is the text itself, once."""
    low, high = int(w.first[i]), int(w.first[i + 1])
    if sum((p["stop"] - p["first"]) * p["times"] for p in parts) == high - low and all(
            p["times"] == 1 for p in parts):
        return None
    words = [w.word(j) for j in range(low, high)]
    passes = range(max(p["times"] for p in parts))
    return b" ".join(word for turn in passes for p in parts if p["times"] > turn
                     for word in words[p["first"]:p["stop"]]).decode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(read(spark, sf_dir, "documents")).taken()
