"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

A text is cut into units at spaces and at bytes that no piece holds, since no piece reaches over
those; only the distinct units of a task are searched. Units of equal length advance together, one
character at a time: for each start, the hash of the substring probes the sorted hashes of the
pieces, and vectorised maxima keep, for each unit and place, the best score, its last piece and a
backpointer.

For a unigram model a path scores the sum of its pieces' scores. For a byte-pair model, where the
sum of scores does not give the model's own segmentation, a path scores 0 as long as each piece may
follow the one before it, and minus infinity else: piece b may follow piece a if merging a + b from
characters gives a and b again. That is told by taking both apart, the later merge first, and
looking for a merge over the border that would have come earlier. One path is left, which is the
merge result, so ids equal those of the library.

Characters without a piece become byte pieces. An empty or null text has no pieces. Decoding is
exact but for U+2581, which stands for a space in every model of this kind.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from cinefold.llm.tables import documents, read
from cinefold.llm.words import _hash_spans, blocks, mix, text_bytes

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# Distinct units whose pieces a task remembers.
KNOWN_UNITS = 250_000
# The search costs less per unit the more units advance together.
BLOCK = 2 << 20
MARK = "▁"
_BASE = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_FILTER_BITS = 22


def _powers(of: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, of, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _codes(text: str) -> np.ndarray:
    return mix(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))


def _hash_text(text: str) -> np.uint64:
    codes = _codes(text)
    return (codes * _powers(_BASE, len(codes))).sum(dtype=np.uint64)


@dataclass
class Model:
    """What the search needs of a model, as arrays."""

    keys: np.ndarray  # sorted hashes of the pieces' texts, spaces for marks
    ids: np.ndarray  # their ids
    hashes: np.ndarray  # by id, as the next ones
    lengths: np.ndarray  # in characters
    scores: np.ndarray
    ranks: np.ndarray  # place in the merge order; -1: a character
    lefts: np.ndarray  # what its last merge joined
    rights: np.ndarray
    whole: np.ndarray  # whether merging its characters gives the piece
    runs: dict[int, list[int]]  # id lists of short runs of spaces
    raw: np.ndarray  # the bytes that all pieces decode to
    bounds: np.ndarray
    byte_ids: np.ndarray
    breaks: np.ndarray  # bytes no piece holds
    longest: int
    space: int
    merges: bool

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], -1)


def load(path: str = MODEL_FILE, merges: bool = True) -> Model:
    """Reads a model file; `merges` tells a byte-pair model from a unigram one."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    size = file.vocab_size()
    return build([file.id_to_piece(i) for i in range(size)],
                 np.array([file.get_score(i) for i in range(size)]),
                 {int(file.id_to_piece(i)[1:-1], 16): i for i in range(size) if file.is_byte(i)},
                 {i for i in range(size) if file.is_control(i) or file.is_unknown(i)}, merges)


def build(pieces: list[str], scores: np.ndarray, byte_pieces: dict[int, int], control: set[int],
          merges: bool) -> Model:
    texts = [p.replace(MARK, " ") for p in pieces]
    special = control | set(byte_pieces.values())
    usual = [i for i, t in enumerate(texts)
             if i not in special and not (len(t) > 1 and not t.strip(" "))]
    size = len(pieces)
    hashes, lengths = np.zeros(size, np.uint64), np.ones(size, np.int64)
    for i in usual:
        hashes[i], lengths[i] = _hash_text(texts[i]), len(texts[i])
    order = np.array(usual)[np.argsort(hashes[usual])]
    ranks = np.full(size, -1, np.int64)
    long = [i for i in usual if lengths[i] > 1]
    ranks[sorted(long, key=lambda i: -scores[i])] = np.arange(len(long))
    lefts, rights, whole = (np.full(size, -1, np.int64) for _ in range(3))
    ids = {texts[i]: i for i in usual}
    for i in usual:
        parts, last = _merge(texts[i], ids, scores, ranks) if merges else ([i], (-1, -1))
        whole[i] = len(parts) == 1
        lefts[i], rights[i] = last
    spaces = {t: i for i, t in enumerate(texts) if i not in special and t and not t.strip(" ")}
    back = {i: b for b, i in byte_pieces.items()}
    decoded = [bytes([back[i]]) if i in back else b"" if i in control else t.encode()
               for i, t in enumerate(texts)]
    held = np.zeros(256, bool)
    held[np.unique(np.frombuffer("".join(texts[i] for i in usual).encode(), np.uint8))] = True
    breaks = ~held
    breaks[128:] = False
    breaks[32] = False
    space = spaces.get(" ", -1)
    return Model(
        hashes[order], order, hashes, lengths, np.asarray(scores, float), ranks, lefts, rights,
        whole.astype(bool), {n: _space_run(n, spaces) for n in range(1, 65)},
        np.frombuffer(b"".join(decoded), np.uint8), np.cumsum([0, *map(len, decoded)]),
        np.array([byte_pieces.get(b, -1) for b in range(256)]), breaks,
        max(len(texts[i]) for i in usual), space, merges)


def _merge(text: str, ids: dict[str, int], scores: np.ndarray,
           ranks: np.ndarray) -> tuple[list[int], tuple[int, int]]:
    """The merge result of a text, and the two pieces that the last merge joined."""
    parts, last = list(text), (-1, -1)
    while len(parts) > 1:
        joined = [ids.get(a + b, -1) for a, b in zip(parts, parts[1:])]
        found = [(ranks[j], k) for k, j in enumerate(joined) if j >= 0]
        if not found:
            break
        k = min(found)[1]
        last = ids.get(parts[k], -1), ids.get(parts[k + 1], -1)
        parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return [ids.get(p, -1) for p in parts], last


def _space_run(n: int, spaces: dict[str, int]) -> list[int]:
    """Spaces merge after all else, all pairs of equal worth, the leftmost first."""
    parts = [" "] * n
    while True:
        k = next((k for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in spaces), None)
        if k is None:
            return [spaces[p] for p in parts]
        parts[k:k + 2] = [parts[k] + parts[k + 1]]


class Encoder:
    """The search, with the units and piece pairs that a task has met so far."""

    def __init__(self, model: Model):
        self.model = model
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[model.keys >> np.uint64(64 - _FILTER_BITS)] = True
        self.pair_key = np.full(1 << 20, -1, np.int64)
        self.pair_value = np.zeros(1 << 20, bool)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b may follow piece a; below 0: a character without a piece."""
        out = self.model.whole[b].copy()
        todo = np.flatnonzero((a >= 0) & out)
        key = a[todo] * len(self.model.scores) + b[todo]
        slot = (mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        hit = self.pair_key[slot] == key
        out[todo[hit]] = self.pair_value[slot[hit]]
        fresh, inverse = np.unique(key[~hit], return_inverse=True)
        if len(fresh):
            value = self._stays_apart(*np.divmod(fresh, len(self.model.scores)))
            out[todo[~hit]] = value[inverse]
            self.pair_key[slot[~hit]] = key[~hit]
            self.pair_value[slot[~hit]] = value[inverse]
        return out

    def _stays_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m = self.model
        a, b = a.copy(), b.copy()
        apart = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)
        powers = _powers(_BASE, m.longest + 1)
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            joined = m.probe(m.hashes[x] + m.hashes[y] * powers[m.lengths[x]])
            early = (joined >= 0) & (m.ranks[joined] < limit[todo])
            apart[todo[early]] = False
            more = ~early & ((m.ranks[x] >= 0) | (m.ranks[y] >= 0))
            todo, x, y = todo[more], x[more], y[more]
            # Of equal pieces the left one was merged first, so the right one is undone first, and
            # a merge over the border of the same rank would have come before it.
            left = m.ranks[x] > m.ranks[y]
            limit[todo] = np.where(left, m.ranks[x], m.ranks[y] + 1)
            a[todo] = np.where(left, m.rights[x], x)
            b[todo] = np.where(left, y, m.lefts[y])
        return apart

    def _search(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of units of `length` characters, one row each, and how many there are."""
        m, n = self.model, len(codes)
        hashed = mix(codes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, length)
        total = np.zeros((n, length + 1), np.uint64)
        np.cumsum(hashed, axis=1, out=total[:, 1:])
        inverse = _powers(_BACK, length)
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back, last = np.zeros((n, length + 1), np.int32), np.full((n, length + 1), -1, np.int64)
        floor = m.scores.min() - 10
        for end in range(1, length + 1):
            for start in range(max(0, end - m.longest), end):
                open_ = (np.flatnonzero(best[:, end] == -np.inf) if m.merges else np.arange(n))
                keys = (total[open_, end] - total[open_, start]) * inverse[start]
                maybe = self.seen[keys >> np.uint64(64 - _FILTER_BITS)]
                rows = open_[maybe]
                piece = m.probe(keys[maybe])
                rows, piece = rows[piece >= 0], piece[piece >= 0]
                if m.merges:
                    score = np.where(self.follows(last[rows, start], piece), 0.0, -np.inf)
                else:
                    score = best[rows, start] + m.scores[piece]
                higher = score > best[rows, end]
                rows, piece = rows[higher], piece[higher]
                best[rows, end], back[rows, end], last[rows, end] = score[higher], start, piece
            none = np.flatnonzero(best[:, end] == -np.inf)
            best[none, end] = 0.0 if m.merges else best[none, end - 1] + floor
            back[none, end] = end - 1
            last[none, end] = -2 - codes[none, end - 1].astype(np.int64)
        out = np.empty((n, length), np.int64)
        at, filled = np.full(n, length), np.zeros(n, np.int64)
        rows = np.arange(n)
        while len(rows):
            out[rows, length - 1 - filled[rows]] = last[rows, at[rows]]
            filled[rows] += 1
            at[rows] = back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        return out, filled

    def _learn(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray,
               ends: np.ndarray) -> None:
        """Searches units given as byte spans."""
        m = self.model
        size = ends - starts
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        raw = data[np.repeat(starts, size) + place]
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        edge = np.cumsum(size)
        chars = heads[edge] - heads[edge - size]
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        first = np.cumsum(chars) - chars
        count, order, pool = np.zeros(len(starts), np.int64), [], [self.pool]
        for length in np.unique(chars).tolist():
            units = np.flatnonzero(chars == length)
            step = max(1, (1 << 18) // length)
            for low in range(0, len(units), step):
                part = units[low:low + step]
                grid = codes[first[part][:, None] + np.arange(length)]
                out, filled = self._search(grid, length)
                used = np.arange(length) >= length - filled[:, None]
                ids, unit = out[used], np.repeat(part, filled)
                if ids.min() < -1:
                    ids, unit = self._with_bytes(ids, unit)
                order.append(part)
                count[part] = np.bincount(unit - part[0], minlength=part[-1] - part[0] + 1)[
                    part - part[0]]
                pool.append(ids.astype(np.int32))
        order = np.concatenate(order)
        start = np.empty(len(starts), np.int64)
        start[order] = len(self.pool) + np.cumsum(count[order]) - count[order]
        self.pool = np.concatenate(pool)
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known)
        self.known = known[order]
        self.start = np.concatenate([self.start, start])[order]
        self.count = np.concatenate([self.count, count])[order]

    def _with_bytes(self, ids: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces for the characters without a piece."""
        odd = np.flatnonzero(ids < -1)
        raw = [chr(-2 - c).encode() for c in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(x) for x in raw]
        ids, unit = np.repeat(ids, times), np.repeat(unit, times)
        ids[ids < -1] = self.model.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, unit

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The piece ids of each text."""
        m = self.model
        texts = pc.replace_substring(pc.fill_null(texts, ""), MARK, " ")
        size = np.asarray(pc.binary_length(texts), np.int64)
        full = np.flatnonzero(size)
        texts = pc.binary_join_element_wise(" ", texts.take(pa.array(full)), "")
        offsets, data = text_bytes(texts)
        if not len(full):
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(size) + 1, np.int32)),
                                            pa.array([], pa.int32()))
        ends_text = np.zeros(len(data), bool)
        ends_text[offsets[1:] - 1] = True
        space, stop = data == 32, m.breaks[data]
        word = ~space & ~stop
        follow = np.append(word[1:], False) & ~ends_text
        tied = space & follow  # the space that a word begins with
        loose = space & ~follow
        before = np.concatenate([[True], ends_text[:-1]])  # first byte of a text
        lag = lambda x: np.concatenate([[False], x[:-1]]) & ~before
        begins = tied | stop | (word & ~lag(word) & ~lag(tied)) | (loose & ~lag(loose))
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        text = np.searchsorted(offsets, starts, "right") - 1
        units = np.flatnonzero(word[starts] | tied[starts])
        hashes = _hash_spans(np.concatenate([data, np.zeros(8, np.uint8)]), starts[units],
                             ends[units])
        fresh, at = np.unique(hashes, return_index=True)
        if len(self.known) + len(fresh) > KNOWN_UNITS:
            self._forget()
        new = ~np.isin(fresh, self.known, assume_unique=True)
        if new.any():
            at = units[at[new]]
            self._learn(data, fresh[new], starts[at], ends[at])
        place = np.searchsorted(self.known, hashes)
        pool_at, count = np.zeros(len(starts), np.int64), np.ones(len(starts), np.int64)
        pool_at[units], count[units] = self.start[place], self.count[place]
        # A space that stays alone joins the spaces before it.
        runs = np.flatnonzero(loose[starts])
        length = ends[runs] - starts[runs]
        after = np.minimum(runs + 1, len(starts) - 1)
        alone = (runs + 1 < len(starts)) & tied[starts[after]] & (text[after] == text[runs])
        alone[alone] = self.pool[pool_at[after[alone]]] == m.space
        length = length + alone
        pool_at[after[alone]] += 1
        count[after[alone]] -= 1
        extra: list[np.ndarray] = [m.byte_ids.astype(np.int32)]
        base, width = len(self.pool), 256
        stops = np.flatnonzero(stop[starts])
        pool_at[stops] = base + data[starts[stops]].astype(np.int64)
        for n in np.unique(length).tolist():
            ids = m.runs.get(n) or _space_run(n, self._spaces())
            pool_at[runs[length == n]], count[runs[length == n]] = base + width, len(ids)
            extra.append(np.array(ids, np.int32))
            width += len(ids)
        pool = np.concatenate([self.pool, *extra])
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        ids = pool[np.repeat(pool_at, count) + step]
        per_text = np.zeros(len(size), np.int64)
        per_text[full] = np.bincount(text, weights=count, minlength=len(full)).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))

    def _spaces(self) -> dict[str, int]:
        m = self.model
        return {m.raw[a:b].tobytes().decode(): i for i, (a, b) in
                enumerate(zip(m.bounds[:-1], m.bounds[1:])) if b > a and (m.raw[a:b] == 32).all()
                and i not in m.byte_ids}

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each id list; bytes that are not UTF-8 become U+FFFD."""
        m = self.model
        flat = np.asarray(ids.flatten())
        size = (m.bounds[1:] - m.bounds[:-1])[flat]
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        raw = m.raw[np.repeat(m.bounds[flat], size) + step].tobytes()
        edges = np.concatenate([[0], np.cumsum(size)])
        cuts = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths()))])
        cuts = edges[cuts].tolist()
        return pa.array([raw[a + 1 if raw[a:a + 1] == b" " else a:b].decode(errors="replace")
                         for a, b in zip(cuts, cuts[1:])], pa.string())


def encode_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per row: doc_id, n_pieces, pieces (the ids), and whether they decode to the text again."""
    docs = documents(docs)
    model = docs.sparkSession.sparkContext.broadcast(model or load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value)
        for batch in blocks(batches, block_bytes=BLOCK):
            ids = encoder.encode(batch.column("text"))
            exact = pc.equal(encoder.decode(ids), pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.cast(ids.value_lengths(), pa.int64()), ids, exact],
                names=["doc_id", "n_pieces", "pieces", "exact"])

    return docs.mapInArrow(
        run, "doc_id bigint, n_pieces bigint, pieces array<int>, exact boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"))
