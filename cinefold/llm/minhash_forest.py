"""Near-duplicate documents by an LSH forest, confirmed on full sets.

A text's set holds the hashes of its distinct two-word shingles, A-Z lower-cased; a text of fewer
words has its whole word sequence as the one member. Equal sets are collapsed to their smallest id
first, so copies cost one row however many there are.

Each representative gets a signature of TREES x DEPTH minima. A tree orders the texts by DEPTH of
them; texts that share a prefix form a region, and the neighbours of a text by longest common
prefix, being those of its region, are its candidates. The depth adapts to each region: it starts
at MIN_DEPTH and grows while more than REGION_ROWS texts share the prefix. Regions with the same
texts are taken once, whatever trees they come from. Inside a region all intersections are exact
counts, and only a spanning forest of its links leaves it.

Nothing is capped. A region that is too large at MIN_DEPTH is taken in two passes. The first finds
most of its links cheaply: besides being cut deeper, it is dealt into blocks that each meet the
region's hub (the text nearest to the most common minima), and so is one too large at full depth.
The second leaves out only what can tell nothing new: all texts of the region that the first did
not put into the region's largest component meet each other and that component, pair of blocks by
pair of blocks, except sets too different in size to be alike. So two alike texts that share
MIN_DEPTH minima in some tree are in one component, however many others share them too.

Rows with a null id, a null text or no words are linked with nothing and kept. Rows that share an
id are one document. A null id has a null component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import components, documents, maybe_in, read, stored
from cinefold.llm.words import Words, blocks, mix, run_hashes

SHINGLE_WORDS = 2
TREES, DEPTH, MIN_DEPTH = 16, 8, 3
REGION_ROWS = 256
# Members of all sets of a region that are multiplied at a time.
_COLUMNS = 4_096
# Members of all sets of a block in the second pass, about.
_BLOCK_MEMBERS = 1 << 17


def shingle_sets(texts: pa.Array, words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, in one array, and the bounds of each text."""
    w = Words(texts, lower=True)
    whole = w.runs(words)
    text, keys = w.text[whole], w.run_hashes(words)[whole]
    for few in range(1, words):
        at = w.first[:-1][w.counts == few]
        text = np.concatenate([text, w.text[at]])
        keys = np.concatenate([keys, run_hashes(w.hashes, few)[at]])
    order = np.lexsort((keys, text))
    text, keys = text[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    text, keys = text[fresh], keys[fresh]
    return keys, np.searchsorted(text, np.arange(len(texts) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray, size: int = TREES * DEPTH) -> np.ndarray:
    """The minima of `size` hash functions over each set, as uint32; sets must not be empty."""
    out = np.empty((len(bounds) - 1, size), np.uint32)
    if not len(out):
        return out
    factors = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)
    for i, factor in enumerate(factors):
        ranks = ((keys * factor) >> np.uint64(32)).astype(np.uint32)
        out[:, i] = np.minimum.reduceat(ranks, bounds[:-1])
    return out


def sign(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row of (doc_id, text): the set's size, a 128-bit digest of it, and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, bounds = shingle_sets(batch.column("text"), words)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            low = np.zeros(len(sizes), np.uint64)
            high = np.zeros(len(sizes), np.uint64)
            minima: list[bytes | None] = [None] * len(sizes)
            if len(full):
                low[full] = np.add.reduceat(mix(keys), bounds[full])
                high[full] = np.add.reduceat(mix(~keys), bounds[full])
                for i, row in zip(full, signatures(keys, np.append(bounds[full], len(keys)))):
                    minima[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(low.view(np.int64)),
                 pa.array(high.view(np.int64)), pa.array(minima, pa.binary())],
                names=["doc_id", "n_shingles", "low", "high", "minima"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, low bigint, high bigint, "
                                "minima binary")


def _prefixes(signed: DataFrame) -> DataFrame:
    """A row per text and tree: hashes of its prefixes, MIN_DEPTH to DEPTH minima long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            minima = np.frombuffer(b"".join(batch.column("minima").to_pylist()), np.uint32)
            minima = minima.reshape(rows, TREES, DEPTH).astype(np.uint64)
            keys = np.empty((rows, TREES, DEPTH), np.uint64)
            state = np.broadcast_to(mix(np.arange(TREES, dtype=np.uint64)), (rows, TREES))
            for depth in range(DEPTH):
                state = keys[:, :, depth] = mix(state ^ mix(minima[:, :, depth] + np.uint64(1)))
            flat = keys[:, :, MIN_DEPTH - 1:].reshape(-1).view(np.int64)
            wide = DEPTH - MIN_DEPTH + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.asarray(batch.column("doc_id")), TREES)),
                 pa.array(np.tile(np.arange(TREES, dtype=np.int32), rows)),
                 pa.ListArray.from_arrays(
                     pa.array(np.arange(0, len(flat) + 1, wide, dtype=np.int32)), pa.array(flat))],
                names=["doc_id", "tree", "keys"])

    return signed.select("doc_id", "minima").mapInArrow(
        run, "doc_id bigint, tree int, keys array<bigint>")


def _block(seed: int) -> F.Column:
    """The block of a text in a region of `n` texts, none above REGION_ROWS on average."""
    return F.pmod(F.xxhash64("key", "doc_id", F.lit(seed)), F.ceil(F.col("n") / REGION_ROWS))


def forest(signed: DataFrame) -> DataFrame:
    """A row per tree for each text that shares its first MIN_DEPTH minima: doc_id, tree, keys,
    key (the first of keys) and n (the texts that have it)."""
    rows = _prefixes(signed).withColumn("key", F.col("keys")[0])
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(counts, "key")


def regions(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """Candidates of the first pass as (region, doc_id), at least two texts a region."""
    sparse = rows.filter(F.col("n") <= REGION_ROWS).select(F.col("key").alias("region"), "doc_id")
    dense = rows.filter(F.col("n") > REGION_ROWS)

    deeper = dense.select("doc_id", "tree", F.posexplode("keys").alias("level", "key"))
    sizes = deeper.groupBy("key").agg(F.count("*").alias("n"))
    fits = (F.col("n") <= REGION_ROWS) | (F.col("level") == DEPTH - MIN_DEPTH)
    cut = (
        deeper.join(sizes, "key").filter(fits)
        .groupBy("tree", "doc_id").agg(F.min(F.struct("level", "key", "n")).alias("at"))
        .select("doc_id", "at.key", "at.n").filter("n > 1")
        .withColumn("region", F.when(F.col("n") <= REGION_ROWS, F.col("key"))
                    .otherwise(F.xxhash64("key", _block(1))))
    )
    around = _around_hubs(dense, signed)
    found = sparse.union(cut.select("region", "doc_id")).union(around).distinct()
    found = stored(found, "regions")
    alike = found.groupBy("region").agg(F.count("*").alias("n"),
                                        F.bit_xor(F.xxhash64("doc_id")).alias("texts"),
                                        F.sum(F.xxhash64("doc_id", F.lit(1)) % (1 << 40)).alias("more"))
    once = alike.filter("n > 1").groupBy("n", "texts", "more").agg(F.min("region").alias("region"))
    return found.join(once.select("region"), "region", "left_semi")


def _around_hubs(dense: DataFrame, signed: DataFrame) -> DataFrame:
    """Blocks of each dense region, every block with the region's hub in it."""
    members = dense.select("key", "doc_id", "n").join(signed.select("doc_id", "minima"), "doc_id")
    # About REGION_ROWS texts a region tell its most common minima.
    usual = members.filter(_block(2) == 0).groupBy("key").applyInArrow(
        _usual_minima, "key bigint, usual binary")

    def nearness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32)
                .reshape(batch.num_rows, -1) for c in ("minima", "usual"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"),
                 pa.array((ours == theirs).sum(axis=1).astype(np.int32))],
                names=["key", "doc_id", "near"])

    hubs = (
        members.select("key", "doc_id", "minima").join(usual, "key")
        .mapInArrow(nearness, "key bigint, doc_id bigint, near int")
        .groupBy("key").agg(F.max(F.struct("near", -F.col("doc_id"))).alias("hub"))
        .select("key", (-F.col("hub.col2")).alias("doc_id"))
    )
    dealt = dense.select(F.xxhash64("key", _block(3)).alias("region"), "doc_id")
    sizes = dense.groupBy("key").agg(F.first("n").alias("n"))
    every = hubs.join(sizes, "key").select("key", "doc_id", F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / REGION_ROWS) - 1)).alias("block"))
    return dealt.union(every.select(F.xxhash64("key", "block").alias("region"), "doc_id"))


def _usual_minima(rows: pa.Table) -> pa.Table:
    minima = np.frombuffer(b"".join(rows.column("minima").to_pylist()), np.uint32)
    minima = np.sort(minima.reshape(rows.num_rows, -1), axis=0)
    usual = np.empty(minima.shape[1], np.uint32)
    for i in range(minima.shape[1]):
        values, counts = np.unique(minima[:, i], return_counts=True)
        usual[i] = values[counts.argmax()]
    return pa.table({"key": rows.column("key")[:1], "usual": pa.array([usual.tobytes()], pa.binary())})


def unmet(rows: DataFrame, signed: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Candidates of the second pass as (region, doc_id): of each dense region, all pairs of texts
    in different components of `found` of which one is not in the region's largest component.

    Texts are graded by size, so that alike ones are in the same grade or the next. A region here is
    a pair of blocks, each of one grade, inside or outside of the largest component.
    """
    # A hair wider than the ratio of the sizes of two alike sets, and never 0.
    width = max(math.log(100 / percent), 1e-3) * (1 + 1e-9) if percent > 0 else math.inf
    grade = F.floor(F.log("n_shingles") / F.lit(width)).cast("int")
    texts = signed.select("doc_id", grade.alias("grade")).join(
        found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    member = stored(
        rows.filter(F.col("n") > REGION_ROWS).select("key", "doc_id").join(texts, "doc_id")
        .withColumn("component_id", F.coalesce("component_id", "doc_id")).distinct(), "dense")
    families = member.groupBy("key", "component_id").agg(F.count("*").alias("n"))
    largest = families.groupBy("key").agg(
        F.count("*").alias("families"), F.max(F.struct("n", "component_id")).alias("most")
    ).filter("families > 1").select("key", F.col("most.component_id").alias("largest"))
    member = member.join(largest, "key").select(
        "key", "doc_id", "grade", (F.col("component_id") != F.col("largest")).alias("outside"))
    cell = ["key", "outside", "grade"]
    # As many texts of the grade's size as a block may hold.
    size = F.exp(F.col("grade") * F.lit(width if math.isfinite(width) else 0.0))
    per = F.greatest(F.lit(1), F.least(F.lit(REGION_ROWS), F.floor(_BLOCK_MEMBERS / size)))
    cells = member.groupBy(cell).agg(F.count("*").alias("n")).withColumn(
        "parts", F.ceil(F.col("n") / per))
    name = F.xxhash64(*cell, F.col("part").cast("bigint"))
    dealt = member.join(cells, cell).withColumn(
        "part", F.pmod(F.xxhash64("key", "doc_id", F.lit(4)), "parts")
    ).select(name.alias("block"), "doc_id")
    every = stored(
        cells.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        .select(*cell, name.alias("block")), "blocks")
    a, b = every.filter("outside").alias("a"), every.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key"))
                   & (F.abs(F.col("a.grade") - F.col("b.grade")) <= 1)
                   & (~F.col("b.outside") | (F.col("a.block") <= F.col("b.block"))))
    region = F.xxhash64("a.block", "b.block")
    return (
        pairs.select(region.alias("region"),
                     F.explode(F.array_distinct(F.array("a.block", "b.block"))).alias("block"))
        .join(dealt, "block").select("region", "doc_id").distinct()
    )


def sets(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """Each text's whole set, as sorted 64-bit hashes in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            keys, bounds = shingle_sets(batch.column("text"), words)
            members = [keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(members, pa.binary())],
                names=["doc_id", "members"])

    return docs.mapInArrow(run, "doc_id bigint, members binary")


def similar(members: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union."""
    sizes = np.array([len(m) for m in members])
    keys = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    # What only one set has is in no intersection but that with itself.
    equal = keys[1:] == keys[:-1]
    shared = np.append(equal, False) | np.append(False, equal)
    keys, owner = keys[shared], owner[shared]
    place = np.cumsum(np.append(False, keys[1:] != keys[:-1])[:len(keys)])
    common = np.zeros((len(members), len(members)), np.int64)
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, _COLUMNS):
        part = slice(*np.searchsorted(place, (low, low + _COLUMNS)))
        grid = np.zeros((len(members), _COLUMNS), np.float32)
        grid[owner[part], place[part] - low] = 1
        common += (grid @ grid.T).astype(np.int64)
    np.fill_diagonal(common, sizes)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def links(candidates: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Confirmed links of each region as a forest: every linked text with the smallest id."""

    def confirm(rows: pa.Table) -> pa.Table:
        ids = np.asarray(rows.column("doc_id").combine_chunks())
        found = similar([np.frombuffer(m, np.uint64) for m in rows.column("members").to_pylist()],
                        percent)
        root = ids.copy()
        while True:
            lower = np.where(found, root[None, :], np.iinfo(np.int64).max).min(axis=1)
            lower = np.minimum(root, lower)
            if (lower == root).all():
                break
            root = lower
        linked = root < ids
        return pa.table({"a": root[linked], "b": ids[linked]})

    return candidates.join(members, "doc_id").select("region", "doc_id", "members").groupBy(
        "region").applyInArrow(confirm, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = SHINGLE_WORDS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (true for one document a component)."""
    docs = documents(docs)
    signed = stored(sign(docs, words), "signed")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    firsts = usable.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("first_id"))
    firsts = stored(firsts, "firsts")
    distinct = stored(usable.join(firsts.select(F.col("first_id").alias("doc_id")), "doc_id",
                                  "left_semi").dropDuplicates(["doc_id", "low", "high"]), "distinct")
    rows = stored(forest(distinct), "forest")

    def confirmed(candidates: DataFrame) -> DataFrame:
        wanted = maybe_in(docs, "doc_id", candidates.select("doc_id")).filter("maybe")
        return links(candidates, sets(wanted.select("doc_id", "text"), words), percent)

    found = components(confirmed(stored(regions(rows, distinct), "candidates")))
    if not rows.filter(F.col("n") > REGION_ROWS).isEmpty():
        rest = stored(unmet(rows, distinct, found, percent), "unmet")
        more = stored(confirmed(rest), "more-links")
        if not more.isEmpty():
            found = components(more.union(found.select("component_id", "node")))
    # Different sets under one id make that id their common node.
    return (
        signed.select("doc_id", "n_shingles", "low", "high")
        .join(firsts, ["n_shingles", "low", "high"], "left")
        .join(found.withColumnRenamed("node", "first_id"), "first_id", "left")
        .select("doc_id", "n_shingles",
                F.when(F.col("doc_id").isNotNull(),
                       F.coalesce("component_id", "first_id", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80,
                         words: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of `docs`, all columns as they are, less the near-duplicates of a kept one."""
    gone = near_duplicates(docs, percent, words).filter("NOT kept").select(
        F.col("doc_id").alias("id")).distinct()
    gone = stored(gone, "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       docs["doc_id"].cast("bigint").alias("id"))
    rows = maybe_in(rows, "id", gone)
    left = rows.filter("maybe").join(gone, "id", "left_anti")
    return rows.filter("NOT maybe").select("row.*").union(left.select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
