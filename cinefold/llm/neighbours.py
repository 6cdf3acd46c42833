"""Nearest neighbours by inner product: a neighbour graph by NN-descent, greedy search on it.

Equal vectors are one node, named by their smallest id. Nodes are dealt by hash into blocks of
about `BLOCK_NODES`; a block is one row with the ids, vectors and neighbour lists of its nodes, and
all steps are joins of messages with blocks by block number, so a vector is sent once to each block
that holds a candidate for it, never once per candidate.

The graph starts from `TREES` random trees: planes between two nodes of a bounded sample deal all
nodes into cells, a cell is halved by further planes into leaves of at most `LEAF_NODES`, and each
node gets its best neighbours in its leaves. A round of NN-descent gives each node its reverse
neighbours and scores any two nodes around it of which one is new there; a block fetches the vectors
around its nodes once, and sends on only what beats a node's worst neighbour, the best `degree` of
each. Rounds end when less than the share `SETTLED` of all entries changed. Lists of neighbours have
a fixed length by the method, reverse ones too (the best are kept), so a hub's list is bounded. For
vectors of unequal length the graph is that of the vectors extended to equal length, whose
neighbours are also those by inner product.

A query starts at its own node and repeatedly expands the `step` best nodes of its beam that were
not expanded, until the `beam` best are; the search is on all nodes, and scores are double
precision on the original vectors. The result is approximate: `beam` sets the recall, which a test
measures against brute force.

Vectors that are null, of zero length or with null or non-finite components take no part, nor do
rows with a null id; of vectors of several dimensions the most frequent one counts. Equal rows are
one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinefold.llm.katz import pack, unpack
from cinefold.llm.tables import read, stored

BLOCK_NODES = 8_192
LEAST_BLOCKS = 16
DEGREE = 32
TREES, LEAF_NODES = 4, 1_024
MOST_CELLS, CELL_SAMPLE = 2_048, 32
SETTLED = 0.1
BEAM, STEP = 640, 96
NEAREST, EVERY = 20, 20

_LOCAL = 20  # bits of a node's place in its block; the bits above are the block
_PLACES = np.int64((1 << _LOCAL) - 1)
_CHUNK = 1 << 17
_MESSAGE = "block int, sender int, kind string, body binary"
_STATE = ("block int, ids binary, vectors binary, near binary, sims binary, fresh binary, "
          "around binary, changed bigint")
_PAIRS = 1 << 22


def _write(arrays: list[np.ndarray]) -> bytes:
    """Arrays in one binary; ascending int64 ones are packed."""
    parts = []
    for x in arrays:
        sorted_ = x.dtype == np.int64 and x.ndim == 1 and len(x) > 1 and x[0] >= 0 and bool(
            (np.diff(x) >= 0).all())
        parts.append((sorted_, x.dtype.str, list(x.shape),
                      pack(x.view(np.uint64)) if sorted_ else np.ascontiguousarray(x).tobytes()))
    kind = pa.list_(pa.struct([("sorted", pa.bool_()), ("kind", pa.string()),
                               ("shape", pa.list_(pa.int64())), ("data", pa.binary())]))
    rows = [dict(zip(("sorted", "kind", "shape", "data"), p)) for p in parts]
    batch = pa.RecordBatch.from_arrays([pa.array([rows], kind)], names=["arrays"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(body: bytes) -> list[np.ndarray]:
    with pa.ipc.open_stream(body) as source:
        rows = source.read_all().column("arrays")[0].as_py()
    return [unpack(r["data"], r["shape"][0]).view(np.int64) if r["sorted"] else
            np.frombuffer(r["data"], np.dtype(r["kind"])).reshape(r["shape"]) for r in rows]


class Nodes:
    """One block's row."""

    def __init__(self, row: dict, degree: int):
        self.block = row["block"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, -1)
        self.near = np.frombuffer(row["near"], np.int64).reshape(n, degree)
        self.sims = np.frombuffer(row["sims"], np.float32).reshape(n, degree)
        # Marks of what is new in `around` or, without it, in `near`.
        self.fresh = np.frombuffer(row["fresh"], bool).reshape(n, -1)
        self.around = np.frombuffer(row["around"], np.int64).reshape(n, -1) if row["around"] else None
        self.changed = row["changed"]

    @classmethod
    def begin(cls, block: int, ids: np.ndarray, vectors: np.ndarray, degree: int) -> Nodes:
        near = np.full((len(ids), degree), -1, np.int64)
        sims = np.full(near.shape, -np.inf, np.float32)
        return cls({"block": block, "ids": ids.tobytes(), "vectors": vectors.tobytes(),
                    "near": near.tobytes(), "sims": sims.tobytes(),
                    "fresh": np.zeros(near.shape, bool).tobytes(), "around": b"", "changed": 0},
                   degree)

    def table(self) -> pa.Table:
        around = b"" if self.around is None else self.around.tobytes()
        return pa.table({
            "block": pa.array([self.block], pa.int32()), "ids": [self.ids.tobytes()],
            "vectors": [self.vectors.tobytes()], "near": [self.near.tobytes()],
            "sims": [self.sims.astype(np.float32).tobytes()], "fresh": [self.fresh.tobytes()],
            "around": [around], "changed": pa.array([self.changed], pa.int64())})

    @property
    def codes(self) -> np.ndarray:
        return (np.int64(self.block) << _LOCAL) | np.arange(len(self.ids), dtype=np.int64)


def _top(owner: np.ndarray, codes: np.ndarray, sims: np.ndarray,
         most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The `most` best different codes of each owner: owner, place, code, similarity."""
    order = np.lexsort((-sims, codes, owner))
    owner, codes, sims = owner[order], codes[order], sims[order]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1])
    owner, codes, sims = owner[fresh], codes[fresh], sims[fresh]
    order = np.lexsort((codes, -sims, owner))
    owner, codes, sims = owner[order], codes[order], sims[order]
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    kept = place < most
    return owner[kept], place[kept], codes[kept], sims[kept]


def _best(owner: np.ndarray, codes: np.ndarray, sims: np.ndarray, count: int,
          most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` best different codes of each owner, as rows filled up with -1 and -inf."""
    owner, place, codes, sims = _top(owner, codes, sims, most)
    near = np.full((count, most), -1, np.int64)
    found = np.full((count, most), -np.inf, sims.dtype)
    near[owner, place] = codes
    found[owner, place] = sims
    return near, found


def _dots(left: np.ndarray, a: np.ndarray, right: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), left.dtype)
    for low in range(0, len(a), _CHUNK):
        part = slice(low, low + _CHUNK)
        out[part] = np.einsum("ij,ij->i", left[a[part]], right[b[part]])
    return out


def _outgoing(sender: int, kind: str, to: np.ndarray,
              body: Callable[[np.ndarray], list[np.ndarray]]) -> list[tuple]:
    """One message for each block in `to`, made of the rows that go there."""
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    return [(int(to[part[0]]), sender, kind, _write(body(part)))
            for part in np.split(order, cuts[1:]) if len(part)]


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array(c, t) for c, t in zip(
        columns, (pa.int32(), pa.int32(), pa.string(), pa.binary()))],
        names=["block", "sender", "kind", "body"])


def _send(state: DataFrame, degree: int, make: Callable[[Nodes], list[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _messages(make(Nodes(row, degree))).to_batches()

    return state.mapInArrow(run, _MESSAGE)


def _meet(messages: DataFrame, state: DataFrame, parse: Callable[[dict], object],
          handle: Callable[[object, list[tuple[int, list[np.ndarray]]]], pa.Table],
          schema: str) -> DataFrame:
    """Joins messages with the blocks they go to."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        received = sorted(((r["sender"], r["body"]) for r in left.to_pylist()), key=lambda x: x[0])
        return handle(parse(right.to_pylist()[0]), [(s, _read(b)) for s, b in received])

    return messages.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(run, schema)


def _start(nodes: DataFrame, degree: int) -> DataFrame:
    """Blocks without neighbours."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        ids = np.asarray(rows.column("id").combine_chunks())
        vectors = np.asarray(rows.column("vector").combine_chunks().flatten()).reshape(len(ids), -1)
        return Nodes.begin(key[0].as_py(), ids, vectors, degree).table()

    return nodes.groupBy("block").applyInArrow(run, _STATE)


def _merged(state: DataFrame, better: DataFrame, degree: int) -> DataFrame:
    """Blocks with the best of their neighbours and of those in messages."""

    def merge(own: Nodes, received: list) -> pa.Table:
        row, column = np.nonzero(own.near >= 0)
        parts = [(row, own.near[row, column], own.sims[row, column]), *(m for _, m in received)]
        before = own.near
        own.near, own.sims = _best(*(np.concatenate(x) for x in zip(*parts)), len(own.ids), degree)
        own.fresh = own.near >= 0
        for column in before.T:
            own.fresh &= own.near != column[:, None]
        own.around, own.changed = None, int(own.fresh.sum())
        return own.table()

    return _meet(better, state, lambda row: Nodes(row, degree), merge, _STATE)


def _planes(sample: np.ndarray, levels: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds that halve the sample `levels` times, as a heap."""
    directions = np.zeros((2 ** levels - 1, sample.shape[1]), np.float32)
    limits = np.zeros(len(directions), np.float32)
    groups = [np.arange(len(sample))]
    for at in range(len(directions)):
        group = groups[at]
        if len(group) > 1:
            a, b = draw.choice(group, 2, replace=False)
            directions[at] = sample[a] - sample[b]
            along = sample[group] @ directions[at]
            limits[at] = np.median(along)
            groups += [group[along <= limits[at]], group[along > limits[at]]]
        else:
            groups += [group, group[:0]]
    return directions, limits


def _cells(vectors: np.ndarray, directions: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The cell of each vector."""
    at = np.zeros(len(vectors), np.int64)
    while len(directions) and at[0] < len(directions):
        along = np.einsum("ij,ij->i", vectors, directions[at])
        at = 2 * at + 1 + (along > limits[at])
    return at - len(directions)


def _leaves(vectors: np.ndarray, draw: np.random.Generator) -> Iterator[np.ndarray]:
    waiting = [np.arange(len(vectors))]
    while waiting:
        group = waiting.pop()
        if len(group) <= LEAF_NODES:
            yield group
            continue
        a, b = draw.choice(group, 2, replace=False)
        half = len(group) // 2
        order = np.argpartition(vectors[group] @ (vectors[a] - vectors[b]), half)
        waiting += [group[order[:half]], group[order[half:]]]


def _in_leaves(state: DataFrame, number: int, blocks: int, degree: int) -> DataFrame:
    """Each node's best neighbours in its leaf of each tree, as messages to its block."""
    most = min(MOST_CELLS, 2 * blocks, max(1, number // LEAF_NODES))
    levels = most.bit_length() - 1
    share = -(-CELL_SAMPLE * 2 ** levels // blocks)

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Nodes(row, degree)
                rows = np.random.default_rng(own.block).permutation(len(own.ids))[:share]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own.block], pa.int32()), pa.array([len(rows)], pa.int32()),
                     pa.array([own.vectors[rows].astype(np.float32).tobytes()])],
                    names=["block", "rows", "sample"])

    def deal(own: Nodes) -> list[tuple]:
        small = own.vectors.astype(np.float32)
        out = []
        for tree, (directions, limits) in enumerate(trees):
            to = tree * 2 ** levels + _cells(small, directions, limits)
            out += _outgoing(own.block, "deal", to, lambda p: [own.codes[p], small[p]])
        return out

    def pairs(key: tuple, rows: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        received = sorted(((r["sender"], r["body"]) for r in rows.to_pylist()), key=lambda x: x[0])
        codes, small = (np.concatenate(x) for x in zip(*(_read(b) for _, b in received)))
        parts = []
        for leaf in _leaves(small, np.random.default_rng(cell)):
            near = min(degree, len(leaf) - 1)
            if near:
                grid = small[leaf] @ small[leaf].T
                np.fill_diagonal(grid, -np.inf)
                top = np.argpartition(-grid, near - 1, axis=1)[:, :near]
                parts.append((np.repeat(codes[leaf], near), codes[leaf][top].reshape(-1),
                              np.take_along_axis(grid, top, axis=1).reshape(-1)))
        if not parts:
            return _messages([])
        node, code, sims = (np.concatenate(x) for x in zip(*parts))
        return _messages(_outgoing(cell, "better", node >> _LOCAL, lambda p: [
            node[p] & _PLACES, code[p], sims[p]]))

    found = [np.frombuffer(r["sample"], np.float32).reshape(r["rows"], -1) for r in state.mapInArrow(
        some, "block int, rows int, sample binary").orderBy("block").collect()]
    sample = np.concatenate(found) if found else np.zeros((0, 1), np.float32)
    draw = np.random.default_rng(number)
    trees = [_planes(sample, levels, draw) for _ in range(TREES)]
    return _send(state, degree, deal).groupBy("block").applyInArrow(pairs, _MESSAGE)


def _with_reverse(state: DataFrame, degree: int) -> DataFrame:
    """Blocks with `around`: each node's neighbours and the best nodes it is a neighbour of."""

    def reverse(own: Nodes) -> list[tuple]:
        row, column = np.nonzero(own.near >= 0)
        to, sims, fresh = own.near[row, column], own.sims[row, column], own.fresh[row, column]
        return _outgoing(own.block, "reverse", to >> _LOCAL, lambda p: [
            to[p] & _PLACES, own.codes[row[p]] * 2 + fresh[p], sims[p]])

    def keep(own: Nodes, received: list) -> pa.Table:
        if received:
            place, marked, sims = (np.concatenate(x) for x in zip(*(m for _, m in received)))
            known = (own.near[place] == (marked >> 1)[:, None]).any(axis=1)
            back, _ = _best(place[~known], marked[~known], sims[~known], len(own.ids), degree)
        else:
            back = np.full((len(own.ids), degree), -1, np.int64)
        own.around = np.concatenate([own.near, back >> 1], axis=1)
        own.fresh = np.concatenate([own.fresh, (back >= 0) & (back % 2 == 1)], axis=1)
        return own.table()

    nodes = lambda row: Nodes(row, degree)
    return _meet(_send(state, degree, reverse), state, nodes, keep, _STATE)


def _improved(state: DataFrame, degree: int) -> DataFrame:
    """Blocks after a round: nodes around a node that are new to each other, scored there."""

    def ask(own: Nodes) -> list[tuple]:
        wanted = np.unique(own.around[own.fresh.any(axis=1)])
        wanted = wanted[wanted >= 0]
        return _outgoing(own.block, "ask", wanted >> _LOCAL, lambda p: [wanted[p] & _PLACES])

    def answer(own: Nodes, received: list) -> pa.Table:
        small, worst = own.vectors.astype(np.float32), own.sims[:, -1]
        return _messages([(sender, own.block, "vectors", _write(
            [own.codes[place], small[place], worst[place]])) for sender, (place,) in received])

    def join(own: Nodes, received: list) -> pa.Table:
        if not received:
            return _messages([])
        # Senders come in order, so the codes ascend.
        codes, small, worst = (np.concatenate(x) for x in zip(*(m for _, m in received)))
        active = np.flatnonzero(own.fresh.any(axis=1))
        wide = own.around.shape[1]
        parts, held = [], 0
        for low in range(0, len(active), max(1, _PAIRS // wide ** 2)):
            rows = active[low:low + max(1, _PAIRS // wide ** 2)]
            there, fresh = own.around[rows] >= 0, own.fresh[rows]
            at = np.where(there, np.searchsorted(codes, own.around[rows]), 0)
            vectors = small[at]
            sims = vectors @ vectors.transpose(0, 2, 1)
            good = sims > np.where(there, worst[at], np.inf)[:, :, None]
            good &= there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
            good[:, np.arange(wide), np.arange(wide)] = False
            node, x, y = np.nonzero(good)
            parts.append((at[node, x], at[node, y], sims[node, x, y]))
            held += len(node)
            if held > _PAIRS:
                x, _, y, sims = _top(*(np.concatenate(c) for c in zip(*parts)), degree)
                parts, held = [(x, y, sims)], 0
        x, _, y, sims = _top(*(np.concatenate(c) for c in zip(*parts)), degree)
        return _messages(_outgoing(own.block, "better", codes[x] >> _LOCAL, lambda p: [
            codes[x[p]] & _PLACES, codes[y[p]], sims[p]]))

    nodes = lambda row: Nodes(row, degree)
    answers = _meet(_send(state, degree, ask), state, nodes, answer, _MESSAGE)
    return _merged(state, _meet(answers, state, nodes, join, _MESSAGE), degree)


def build(nodes: DataFrame, blocks: int, degree: int = DEGREE,
          settled: float = SETTLED) -> DataFrame:
    """The neighbour graph of (id, vector, block), as blocks with `around`."""
    state = stored(_start(nodes, degree), "graph")
    number = state.agg(F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0)).cast("bigint")).first()[0]
    state = stored(_merged(state, _in_leaves(state, number, blocks, degree), degree), "graph")
    while True:
        state = stored(_with_reverse(state, degree), "graph")
        changed = state.agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0]
        if changed <= settled * number * degree:
            return state
        state = stored(_improved(state, degree), "graph")


_SEARCH = "block int, search binary, waiting bigint"
_ONE = np.int64(1)
_CODE_BITS = 40


class Beams:
    """The searches of one block's queries: their place, vector, beam and what they have seen."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.place, self.vectors, self.codes, self.sims, self.done, self.seen = _read(row["search"])

    @classmethod
    def begin(cls, own: Nodes, ids: np.ndarray, beam: int) -> Beams:
        out = cls.__new__(cls)
        out.block, out.place = own.block, np.searchsorted(own.ids, ids)
        out.vectors = own.vectors[out.place].copy()
        out.vectors[:, -1] = 0  # the search is by inner product, not by the extended vectors
        out.codes = np.full((len(ids), beam), -1, np.int64)
        out.sims = np.full((len(ids), beam), -np.inf)
        out.codes[:, 0] = own.codes[out.place]
        out.sims[:, 0] = (out.vectors * own.vectors[out.place]).sum(axis=1)
        out.done = np.zeros(out.codes.shape, bool)
        out.seen = np.sort(out.keys(np.arange(len(ids)), out.codes[:, 0]))
        return out

    @staticmethod
    def keys(query: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return (query.astype(np.int64) << _CODE_BITS) | codes

    def table(self) -> pa.Table:
        return pa.table({
            "block": pa.array([self.block], pa.int32()),
            "search": [_write([self.place, self.vectors, self.codes, self.sims, self.done,
                               self.seen])],
            "waiting": [int(((self.codes >= 0) & ~self.done).sum())]})

    def chosen(self, step: int) -> np.ndarray:
        """The best `step` of each beam that were not expanded."""
        open_ = (self.codes >= 0) & ~self.done
        return open_ & (np.cumsum(open_, axis=1) <= step)


def _hop(beams: DataFrame, graph: DataFrame, degree: int, step: int) -> DataFrame:
    """All beams after one expansion of each."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Beams(row)
                query, column = np.nonzero(own.chosen(step))
                to = own.codes[query, column]
                yield from _messages(_outgoing(own.block, "expand", to >> _LOCAL, lambda p: [
                    query[p], to[p] & _PLACES])).to_batches()

    def list_around(own: Nodes, received: list) -> pa.Table:
        out = []
        for sender, (query, place) in received:
            found = own.around[place]
            row, column = np.nonzero(found >= 0)
            keys = np.unique(Beams.keys(query[row], found[row, column]))
            out.append((sender, own.block, "around", _write([keys])))
        return _messages(out)

    def ask(own: Beams, received: list) -> pa.Table:
        keys = np.unique(np.concatenate([m[0] for _, m in received])) if received else own.seen[:0]
        keys = keys[~np.isin(keys, own.seen, assume_unique=True)]
        query, codes = keys >> _CODE_BITS, keys & ((_ONE << _CODE_BITS) - 1)
        worst = own.sims[:, -1]

        def body(p: np.ndarray) -> list[np.ndarray]:
            used, at = np.unique(query[p], return_inverse=True)
            return [used, own.vectors[used], worst[used], at.astype(np.int32),
                    (codes[p] & _PLACES).astype(np.int32)]

        return _messages(_outgoing(own.block, "score", codes >> _LOCAL, body))

    def answer(own: Nodes, received: list) -> pa.Table:
        out = []
        for sender, (used, vectors, worst, at, local) in received:
            sims = _dots(vectors, at, own.vectors, local)
            keys = Beams.keys(used[at], own.codes[local])
            good = sims > worst[at]
            out.append((sender, own.block, "scored", _write(
                [np.sort(keys), used[at[good]], own.codes[local[good]], sims[good]])))
        return _messages(out)

    def merge(own: Beams, received: list) -> pa.Table:
        own.done = own.done | own.chosen(step)
        if received:
            seen, query, codes, sims = (np.concatenate(x) for x in zip(*(m for _, m in received)))
            own.seen = np.sort(np.concatenate([own.seen, seen]))
            row, column = np.nonzero(own.codes >= 0)
            expanded = np.sort(Beams.keys(*(lambda r, c: (r, own.codes[r, c]))(*np.nonzero(own.done))))
            own.codes, own.sims = _best(
                np.concatenate([row, query]), np.concatenate([own.codes[row, column], codes]),
                np.concatenate([own.sims[row, column], sims]), len(own.codes), own.codes.shape[1])
            keys = Beams.keys(np.arange(len(own.codes))[:, None], own.codes)
            own.done = (own.codes >= 0) & np.isin(keys, expanded)
        return own.table()

    nodes = lambda row: Nodes(row, degree)
    asked = beams.mapInArrow(expand, _MESSAGE)
    around = _meet(asked, graph, nodes, list_around, _MESSAGE)
    wanted = _meet(around, beams, Beams, ask, _MESSAGE)
    scored = _meet(wanted, graph, nodes, answer, _MESSAGE)
    return _meet(scored, beams, Beams, merge, _SEARCH)


def search(graph: DataFrame, queries: DataFrame, degree: int = DEGREE, nearest: int = NEAREST,
           beam: int = BEAM, step: int = STEP) -> DataFrame:
    """For each of `queries` (id, block), nodes of the graph: its own node and the `nearest` + 1
    best others found, as (node, block, place, score)."""

    def begin(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = np.unique(np.asarray(left.column("id").combine_chunks()))
        if not len(ids):
            return pa.table({"block": pa.array([], pa.int32()), "search": pa.array([], pa.binary()),
                             "waiting": pa.array([], pa.int64())})
        return Beams.begin(Nodes(right.to_pylist()[0], degree), ids, beam).table()

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Beams(row)
                own_code = (np.int64(own.block) << _LOCAL) | own.place
                self_ = own.codes == own_code[:, None]
                rank = np.cumsum((own.codes >= 0) & ~self_, axis=1)
                kept = (own.codes >= 0) & ~self_ & (rank <= nearest + 1)
                query, column = np.nonzero(kept)
                codes, sims = own.codes[query, column], own.sims[query, column]
                length = (own.vectors ** 2).sum(axis=1)
                codes = np.concatenate([codes, own_code])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([own.place[query], own.place])),
                     pa.array(np.full(len(codes), own.block, np.int32)),
                     pa.array((codes >> _LOCAL).astype(np.int32)), pa.array(codes & _PLACES),
                     pa.array(np.concatenate([sims, length]))],
                    names=["asking", "asking_block", "block", "place", "score"])

    beams = stored(queries.groupBy("block").cogroup(graph.groupBy("block")).applyInArrow(
        begin, _SEARCH), "beams")
    # Each hop expands nodes never expanded before, so the hops end by themselves.
    while beams.agg(F.coalesce(F.sum("waiting"), F.lit(0))).first()[0]:
        beams = stored(_hop(beams, graph, degree, step), "beams")
    return beams.mapInArrow(result, "asking bigint, asking_block int, block int, place bigint, "
                                    "score double")


def _places(graph: DataFrame) -> DataFrame:
    """block, place and id of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids in zip(batch.column("block").to_pylist(), batch.column("ids").to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), block, np.int32)), pa.array(np.arange(len(ids))),
                     pa.array(ids)], names=["block", "place", "id"])

    return graph.select("block", "ids").mapInArrow(run, "block int, place bigint, id bigint")


def _usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector, its squared length, and two hashes of it."""
    finite = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    rows = embeddings.select(
        embeddings["vec_id"].cast("bigint").alias("vec_id"),
        F.transform(embeddings["embedding"].cast("array<double>"), lambda x: x + F.lit(0.0))
        .alias("vector"))
    rows = rows.filter(f"vec_id IS NOT NULL AND vector IS NOT NULL AND {finite}").withColumn(
        "length2", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).filter("length2 > 0")
    usual = rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(
        F.desc("rows"), "n").first()
    return rows.filter(F.size("vector") == (usual["n"] if usual else 0)).withColumns({
        "first": F.xxhash64("vector"),
        "second": F.xxhash64(F.concat(F.array(F.lit(0.5)), F.col("vector")))})


def nearest_neighbours(embeddings: DataFrame, every: int = EVERY, nearest: int = NEAREST,
                       degree: int = DEGREE, settled: float = SETTLED,
                       beam: int = BEAM, step: int = STEP) -> DataFrame:
    """For each usable row whose vec_id is divisible by `every`: its `nearest` nearest other rows
    found, as query_id, rank, vec_id, score; ties go to the smaller vec_id."""
    rows = stored(_usable(embeddings), "vectors")
    alike = Window.partitionBy("first", "second").orderBy("vec_id")
    ids = rows.select("vec_id", "first", "second").distinct()
    # Of equal vectors no more than nearest + 1 can be asked for.
    members = stored(ids.withColumn("place", F.row_number().over(alike)).filter(
        F.col("place") <= nearest + 1), "members")
    nodes = members.filter("place = 1").select("first", "second", F.col("vec_id").alias("id"))
    number, longest = rows.agg(F.count("*"), F.max("length2")).first()
    blocks = max(LEAST_BLOCKS, -(-number // BLOCK_NODES))
    spare = F.sqrt(F.greatest(F.lit(0.0), F.lit(longest) - F.col("length2")))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    vectors = rows.join(nodes.withColumnRenamed("id", "vec_id"), ["first", "second", "vec_id"],
                        "left_semi").dropDuplicates(["vec_id", "first", "second"])
    vectors = vectors.select(F.col("vec_id").alias("id"),
                             F.concat("vector", F.array(spare)).alias("vector"))
    graph = build(vectors.withColumn("block", block), blocks, degree, settled)

    asking = ids.filter(F.col("vec_id") % every == 0).join(nodes, ["first", "second"])
    found = search(graph, asking.select("id", block.alias("block")).distinct(), degree, nearest,
                   beam, step)
    names = stored(_places(graph), "places")
    found = found.join(names.withColumnRenamed("id", "found"), ["block", "place"]).join(
        names.select(F.col("block").alias("asking_block"), F.col("place").alias("asking"), "id"),
        ["asking_block", "asking"]).select("id", "found", "score")
    copies = members.join(nodes, ["first", "second"]).select(F.col("id").alias("found"), "vec_id")
    pairs = asking.select(F.col("vec_id").alias("query_id"), "id").join(found, "id").join(
        copies, "found").filter("vec_id <> query_id")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"))
