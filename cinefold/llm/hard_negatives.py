"""Hard negatives: for each anchor and each of its nearest rows of the same label, the nearest rows
of other labels whose score lies in a window below that positive's.

Vectors become whole numbers, floor(scale * component), and a score is the inner product of two such
vectors, exact as an int64. Rows are packed into tiles, matrices of anchors or of candidates. A cell
is a bounded number of tiles of both kinds; every anchor tile meets every candidate tile in one cell,
where their product is taken by Strassen's recursive multiplication with zero padding of odd sides.
What a cell finds is kept in heaps of fixed size, one per anchor for positives and one per anchor and
positive for the window, and heaps of one anchor tile merge in any order. Positives come first, as
the windows follow from them.

Higher scores come first, ties by the smaller id. Rows without an id, a label or a vector, and rows
with a null or non-finite component, take no part. Vectors of unequal length are filled up with
zeros. Rows that repeat an id are rows of their own, but never positives of an anchor with that id;
an anchor row that is repeated is answered as often. An anchor without a positive, and a positive
without a negative, give no row; an empty table gives none. Components whose whole number does not
fit into an int64, or products that do not, are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import read, stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
# The window: at least so many hundredths of the positive's score.
LOW_PCT = 80
ANCHOR_TILE, CANDIDATE_TILE = 256, 1024
# Rows of a cell: what one task multiplies.
CELL_ANCHORS, CELL_CANDIDATES = 1 << 14, 1 << 16
# Products with a side up to this length are taken directly.
LEAF = 16
# Heaps of one anchor tile that are merged at once.
FAN = 256
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_TILE = "tile bigint, rows bigint, most bigint, width bigint, kind string, ids binary, " \
        "labels binary, data binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2 ** 64, so exact where the result fits."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, h = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * h), np.int64)
    out[:i, :h] = p1 + p4 - p5 + p7
    out[:i, h:] = p3 + p5
    out[i:, :h] = p2 + p4
    out[i:, h:] = p1 - p2 + p3 + p6
    return out[:m, :n]


class Heaps:
    """For each of `count` owners the best `size` entries so far, the best first."""

    def __init__(self, count: int, size: int):
        self.scores = np.full((count, size), _NONE, np.int64)
        self.ids = np.full((count, size), _LAST, np.int64)

    def push(self, owner: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        size = self.scores.shape[1]
        worst = self.scores[owner, -1]
        better = (scores > worst) | ((scores == worst) & (ids < self.ids[owner, -1]))
        owner, scores, ids = owner[better], scores[better], ids[better]
        if not len(owner):
            return
        touched = np.unique(owner)
        owner = np.concatenate([owner, np.repeat(touched, size)])
        scores = np.concatenate([scores, self.scores[touched].ravel()])
        ids = np.concatenate([ids, self.ids[touched].ravel()])
        # ~score falls as the score rises, and has no overflow.
        order = np.lexsort((ids, ~scores, owner))
        owner = owner[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        kept = rank < size
        order, owner, rank = order[kept], owner[kept], rank[kept]
        self.scores[owner, rank], self.ids[owner, rank] = scores[order], ids[order]

    def merge(self, other: Heaps) -> None:
        owner = np.repeat(np.arange(len(other.scores)), other.scores.shape[1])
        self.push(owner, other.scores.ravel(), other.ids.ravel())

    def pack(self) -> bytes:
        return self.scores.tobytes() + self.ids.tobytes()

    @classmethod
    def unpack(cls, raw: bytes, count: int, size: int) -> Heaps:
        out = cls(count, size)
        both = np.frombuffer(raw, np.int64).reshape(2, count, size)
        out.scores, out.ids = both[0].copy(), both[1].copy()
        return out


class Tile:
    """A matrix of rows with their ids and labels."""

    def __init__(self, row: dict):
        self.tile, self.rows, self.most, self.width = (row[k] for k in ("tile", "rows", "most", "width"))
        self.ids, self.labels = (np.frombuffer(row[k], np.int64) for k in ("ids", "labels"))
        data = np.frombuffer(row["data"], row["kind"]).reshape(self.rows, self.width)
        self.data = data.astype(np.int64)

    def scores(self, other: Tile) -> np.ndarray:
        width = max(self.width, other.width)
        a = np.pad(self.data, ((0, 0), (0, width - self.width)))
        b = np.pad(other.data, ((0, 0), (0, width - other.width)))
        if width * self.most * other.most <= _LAST:
            return strassen(a, np.ascontiguousarray(b.T))
        # Values so large that a sum might wrap: exact numbers of any size, checked.
        exact = a.astype(object) @ b.T.astype(object)
        if max(map(abs, exact.ravel().tolist()), default=0) > _LAST:
            raise OverflowError("a score does not fit into 64 bits")
        return exact.astype(np.int64)


def whole(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Ids, labels and whole-number vectors of the rows that take part."""
    ids, labels, vectors = [], [], []
    for i, label, vector in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(),
                                batch.column("vector")):
        if i is None or label is None or not vector.is_valid:
            continue
        values = vector.values
        if values.null_count:
            continue
        values = np.asarray(values.to_numpy(zero_copy_only=False), np.float64)
        if not np.isfinite(values).all():
            continue
        numbers = np.floor(scale * values)
        if len(numbers) and not np.abs(numbers).max() < 2.0 ** 63:
            raise OverflowError(f"a component of {i} does not fit into 64 bits")
        ids.append(i)
        labels.append(label)
        vectors.append(numbers.astype(np.int64))
    return np.array(ids, np.int64), np.array(labels, np.int64), vectors


def tiles(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Rows (id, label, vector) as tiles of up to `size` rows, packed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, labels, vectors = [], [], []

        def tile(count: int) -> pa.RecordBatch:
            nonlocal number
            width = max(len(v) for v in vectors[:count])
            data = np.zeros((count, width), np.int64)
            for k, v in enumerate(vectors[:count]):
                data[k, :len(v)] = v
            most = int(np.abs(data).max(initial=0))
            kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
            row = {"tile": number, "rows": count, "most": most, "width": width, "kind": kind,
                   "ids": np.array(ids[:count], np.int64).tobytes(),
                   "labels": np.array(labels[:count], np.int64).tobytes(),
                   "data": data.astype(kind).tobytes()}
            del ids[:count], labels[:count], vectors[:count]
            number += 1
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            more = whole(batch, scale)
            for held, new in zip((ids, labels, vectors), more):
                held.extend(new.tolist() if isinstance(new, np.ndarray) else new)
            while len(ids) >= size:
                yield tile(size)
        if ids:
            yield tile(len(ids))

    return rows.mapInArrow(run, _TILE)


class Miner:
    """The tiles of a table and what cells find in them."""

    def __init__(self, rows: DataFrame, positives: int, negatives: int, low_pct: int, scale: int,
                 cell_anchors: int, cell_candidates: int):
        self.positives, self.negatives, self.low_pct = positives, negatives, low_pct
        self.candidates = stored(tiles(rows.drop("anchor"), CANDIDATE_TILE, scale), "candidates")
        self.anchors = stored(tiles(rows.filter("anchor").drop("anchor"), ANCHOR_TILE, scale), "anchors")
        size = F.coalesce(F.sum("rows"), F.lit(0)).alias("n")
        spread = rows.sparkSession.sparkContext.defaultParallelism
        self.parts = max(spread, -(-self.candidates.agg(size).first()["n"] // cell_candidates))
        self.groups = max(1, -(-self.anchors.agg(size).first()["n"] // cell_anchors))

    def _found(self, anchors: DataFrame, search, size_of) -> DataFrame:
        """Per anchor tile the merged heaps of all cells."""
        side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n: F.pmod(F.xxhash64("tile", "ids"), F.lit(n)).cast("int")
        left = anchors.withColumns({"group": dealt(self.groups), "part": side(self.parts)})
        right = self.candidates.withColumns({"part": dealt(self.parts), "group": side(self.groups)})

        def cell(a: pa.Table, b: pa.Table) -> pa.Table:
            out, others = [], [Tile(r) for r in b.to_pylist()]
            for row in a.to_pylist() if others else []:
                heaps = Heaps(*size_of(row["rows"]))
                anchor = Tile(row)
                for other in others:
                    search(heaps, row, anchor, other)
                out.append((row["tile"], row["part"], row["rows"], heaps.pack()))
            return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(
                [("tile", pa.int64()), ("part", pa.int32()), ("rows", pa.int64()),
                 ("heaps", pa.binary())])})

        def merge(table: pa.Table) -> pa.Table:
            count = table.column("rows")[0].as_py()
            heaps = Heaps(*size_of(count))
            for raw in table.column("heaps"):
                heaps.merge(Heaps.unpack(raw.as_py(), *size_of(count)))
            return table.slice(0, 1).set_column(3, "heaps", pa.array([heaps.pack()], pa.binary()))

        schema = "tile bigint, part int, rows bigint, heaps binary"
        found = left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(
            cell, schema)
        parts = self.parts
        while parts > 1:
            parts = -(-parts // FAN)
            found = found.withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
            found = found.groupBy("tile", "part").applyInArrow(merge, schema)
        return found.drop("part", "rows")

    def nearest(self) -> DataFrame:
        """The positives of each anchor tile, as heaps."""
        wanted = self.positives

        def search(heaps: Heaps, row: dict, anchor: Tile, other: Tile) -> None:
            scores = anchor.scores(other)
            fits = (anchor.labels[:, None] == other.labels) & (anchor.ids[:, None] != other.ids)
            owner, at = np.nonzero(fits & (scores >= heaps.scores[:, -1:]))
            heaps.push(owner, scores[owner, at], other.ids[at])

        return self._found(self.anchors, search, lambda rows: (rows, wanted))

    def windows(self, positives: DataFrame) -> DataFrame:
        """Per anchor tile, its positives and the heaps of their windows."""
        count, wanted, low_pct = self.positives, self.negatives, self.low_pct
        anchors = self.anchors.join(positives.withColumnRenamed("heaps", "near"), "tile")

        def search(heaps: Heaps, row: dict, anchor: Tile, other: Tile) -> None:
            scores = anchor.scores(other)
            differs = anchor.labels[:, None] != other.labels
            near = Heaps.unpack(row["near"], anchor.rows, count)
            for k in range(count):
                high, slot = near.scores[:, k], slice(k, None, count)
                tens, rest = np.divmod(high, 100)
                low = low_pct * tens - (-low_pct * rest) // 100
                least = np.maximum(low, heaps.scores[slot, -1])
                fits = differs & (near.ids[:, k, None] != _LAST)
                owner, at = np.nonzero(fits & (scores <= high[:, None]) & (scores >= least[:, None]))
                heaps.push(owner * count + k, scores[owner, at], other.ids[at])

        found = self._found(anchors, search, lambda rows: (rows * count, wanted))
        return anchors.select("tile", "ids", "near").join(found, "tile")


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low_pct: int = LOW_PCT, scale: int = SCALE,
                   id_column: str = "vec_id", vector_column: str = "embedding",
                   label: Column | str = "label", cell_anchors: int = CELL_ANCHORS,
                   cell_candidates: int = CELL_CANDIDATES) -> DataFrame:
    """The negatives of each positive of each row for which `anchor` is true."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"),
        (F.col(label) if isinstance(label, str) else label).cast("bigint").alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"), anchor.alias("anchor"))
    miner = Miner(rows, positives, negatives, low_pct, scale, cell_anchors, cell_candidates)
    near = stored(miner.nearest(), "positives")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                pos = Heaps.unpack(row["near"], len(ids), positives)
                neg = Heaps.unpack(row["heaps"], len(ids) * positives, negatives)
                owner, rank = np.nonzero(neg.ids != _LAST)
                at, slot = np.divmod(owner, positives)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (
                        ids[at], pos.ids[at, slot], (rank + 1).astype(np.int32), neg.ids[owner, rank],
                        pos.scores[at, slot], neg.scores[owner, rank])],
                    names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                           "negative_score"])

    return miner.windows(near).mapInArrow(
        run, "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, "
             "positive_score bigint, negative_score bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.col("label").cast("bigint")
    label = F.when(F.col("vec_id") % 7 == 0, (wide + 1) % 10).otherwise(wide)
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


ORACLE_SQL = """
with given as (
  select vec_id, case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as label,
         cast(embedding as double[]) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null),
good as (
  select vec_id, label, list_transform(v, lambda x: floor(256 * x)) as v from given
  where len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0),
whole as materialized (
  select vec_id, label, list_resize(v, (select max(len(v)) from good), cast(0 as double)) as v
  from good),
pairs as materialized (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same,
         cast(list_dot_product(a.v, b.v) as bigint) as score
  from whole a cross join whole b where a.vec_id % 100 = 0),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from pairs
  where same and other_id <> anchor_id
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, positive_id,
       cast(row_number() over (partition by p.anchor_id, positive_id
                               order by score desc, other_id) as integer) as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives p join pairs n on p.anchor_id = n.anchor_id and not same
     and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5"""
