"""Language-model scores of documents by a bigram model with Katz backoff.

Tokens are the words of a text, A-Z lower-cased, and one end. The model learns from the training
documents: counts of words and of pairs, discounted by Good-Turing where they are at most
`DISCOUNTED`. A pair that was seen has its discounted relative frequency; another backs off to the
word's probability times its history's weight, which is such that all words after a history sum
to one exactly. Where nothing of a history is discounted, its total counts one more. A word's own
probability is discounted the same way, and what is left goes to the unknown word.

Every word of the training documents is in the model. Words with a count of at least a threshold, the
least one that leaves no more than `VOCABULARY` of them, have a number; they, and what is known of each
of them as a history, have a bound and go to every task. A caller may close the vocabulary at a size;
words beyond it are then the unknown word. Pairs of numbered words have no bound: they are counted in
buckets, by history or, for the `SPREAD` most frequent histories, by pair, and stay in a table that is
partitioned like that. A pair with a word without a number is counted in buckets of its own: by its
word, if that has no number, and by its history, if that has none; so either bucket knows all of its
word, and says the part of a score that depends on it. To score, each pair of a text goes to its bucket,
except for the most frequent pairs, at most `HOT_PAIRS`, which are known to every task: no pair's
occurrences make one bucket much larger than others. Blocks of keys travel as packed binaries. Texts
are read three times: for the counts of words, those of pairs, and the scores.

The base score uses exact counts of all words: those without a number are known to the buckets.

Null texts are empty: one token, the end. Rows with a null id belong to the training documents.
Equal rows are scored each. Without any training document every word is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import documents, read, stored
from cinefold.llm.words import Words, blocks, mix

VOCABULARY = 1 << 20
HOT_PAIRS = 1 << 18
SPREAD = 4_096
DISCOUNTED = 5
BUCKET_TOKENS = 4_000_000
RARE_TOKENS = 1_000_000  # of words without a number, by word and by history
FLUSH_PAIRS = 4_000_000
BLOCK = 4 << 20

_BITS = np.uint64(21)
_LOW = np.uint64((1 << 21) - 1)
UNKNOWN, START = 0, 1  # numbers of the vocabulary begin at 2
END = np.uint64(0xE5D0F7EC77)
BEGIN = np.uint64(0xBE6150F7EC77)
_STEPS = 16  # histogram bins per doubling of a count


def _planes(values: np.ndarray) -> bytes:
    """Numbers compressed byte by byte."""
    return pa.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True)


def _numbers(data: bytes, n: int) -> np.ndarray:
    raw = pa.decompress(data, 8 * n, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view("<u8").reshape(-1)


def pack(keys: np.ndarray) -> bytes:
    """Ascending numbers as compressed differences."""
    return _planes(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(_numbers(data, n), dtype=np.uint64)


def _squeeze(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def _stretch(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def discounts(of: np.ndarray) -> np.ndarray:
    """Factors for the counts 0 to DISCOUNTED, from how many things were seen 1, 2, ... times.

    Katz's factors keep the total of what is discounted at Good-Turing's. Where the numbers do not
    give factors between 0 and 1, half a count is taken off instead.
    """
    k = DISCOUNTED
    r = np.arange(1, k + 1)
    n = np.asarray(of, float)
    with np.errstate(all="ignore"):
        cut = (k + 1) * n[k] / n[0]
        found = ((r + 1) * n[1:k + 1] / n[:k] / r - cut) / (1 - cut)
    usual = np.isfinite(found) & (found > 0) & (found < 1)
    return np.concatenate([[1.0], np.where(usual, found, (r - 0.5) / r)])


def _cut(counts: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Discounted counts."""
    return counts * np.where(counts <= DISCOUNTED, factor[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass
class Vocabulary:
    hashes: np.ndarray  # sorted
    numbers: np.ndarray
    counts: np.ndarray  # by number
    chance: np.ndarray  # probability by number; START has none
    tokens: int
    words: int
    factor: np.ndarray  # discounts of small counts
    total: int  # what discounted counts are divided by
    open: bool  # whether words without a number are words of the model
    rare: int  # tokens of words without a number

    def number(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.numbers[at], UNKNOWN)

    def rare_chance(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words without a number by their counts."""
        return np.where(counts > 0, _cut(counts, self.factor) / self.total, self.chance[UNKNOWN])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, and the bounds of the texts; an end closes each text."""
    w = Words(texts, lower=True)
    bounds = w.first + np.arange(len(w.first))
    out = np.full(bounds[-1], END, np.uint64)
    out[np.arange(len(w)) + w.text] = w.hashes
    return out, bounds


def _pairs(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    before = np.concatenate([[START], numbers[:-1]])
    before[bounds[:-1]] = START
    return (before.astype(np.uint64) << _BITS) | numbers.astype(np.uint64)


def _numbered(pairs: np.ndarray) -> np.ndarray:
    return ((pairs >> _BITS) != UNKNOWN) & ((pairs & _LOW) != UNKNOWN)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    history = keys >> _BITS
    # Numbers follow frequency, so the first ones are the most frequent histories.
    spread = np.where(history < SPREAD, keys | np.uint64(1 << 63), history)
    return (mix(spread) % np.uint64(buckets)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (its hash) and n over all rows of (text)."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in blocks(batches, block_bytes=BLOCK):
            held.append(_tokens(batch.column("text"))[0])
            if sum(map(len, held)) >= FLUSH_PAIRS:
                yield counted(held)
                held = []
        if held:
            yield counted(held)

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(
        F.sum("n").alias("n"))


def _threshold(bins: dict[int, int], most: int) -> int:
    """The least count that no more than `most` things reach, given how many fall in each bin."""
    total, least = 0, None
    for b in sorted(bins, reverse=True):
        total += bins[b]
        if total > most:
            break
        least = b
    if least is None:
        return 1 << 62
    return next(c for c in range(int(2 ** (least / _STEPS)) - 1, 1 << 62)
                if c > 0 and int(np.log2(c) * _STEPS) >= least)


def vocabulary(counts: DataFrame, most: int = VOCABULARY, closed: bool = True) -> Vocabulary:
    bins = counts.groupBy(F.floor(F.log2("n") * _STEPS).alias("bin")).agg(
        F.count("*").alias("words"), F.sum("n").alias("tokens"),
        *(F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, DISCOUNTED + 2))).collect()
    tokens, words = sum(b["tokens"] for b in bins), sum(b["words"] for b in bins)
    seen = [sum(b[f"n{r}"] for b in bins) for r in range(1, DISCOUNTED + 2)]
    least = _threshold({b["bin"]: b["words"] for b in bins}, most)
    rows = counts.filter(F.col("n") >= least).toArrow()
    hashes = np.asarray(rows.column("word")).view(np.uint64)
    n = np.asarray(rows.column("n")).astype(np.int64)
    order = np.lexsort((hashes, -n))
    by_number = np.concatenate([[0, 0], n[order]])
    numbers = np.empty(len(n), np.int64)
    numbers[order] = np.arange(len(n)) + 2
    by_hash = np.argsort(hashes)
    factor = discounts(np.array(seen))
    kept = _cut(by_number, factor)
    more = not closed and len(n) < words
    if more:
        small = np.array(seen[:DISCOUNTED]) * np.arange(1, DISCOUNTED + 1)
        everything = tokens - small.sum() + (factor[1:] * small).sum()
    else:
        everything = kept.sum()
    total = max(tokens if everything < tokens else tokens + 1, 1)
    chance = kept / total
    chance[UNKNOWN] = 1 - (everything / total if more else chance.sum())
    return Vocabulary(hashes[by_hash], numbers[by_hash], by_number, chance, tokens, words, factor, total, more,
                      tokens - int(by_number.sum()))


@dataclass
class Buckets:
    """Numbers of buckets: first `pairs` of them for pairs of numbered words, then twice `rare`, for the
    other pairs by their word and by their history."""

    pairs: int
    rare: int

    def of_rare(self, keys: np.ndarray, as_history: bool) -> np.ndarray:
        return self.pairs + self.rare * as_history + (mix(keys) % np.uint64(max(self.rare, 1))).astype(np.int64)

    def by_word(self, bucket: int) -> bool:
        return self.pairs <= bucket < self.pairs + self.rare

    def by_history(self, bucket: int) -> bool:
        return bucket >= self.pairs + self.rare


def _rare_pairs(hashes: np.ndarray, numbers: np.ndarray, bounds: np.ndarray, words: Vocabulary,
                buckets: Buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, hash of the word without a number, code of the other one, and place, of each such word
    as the word and as the history of a pair. A code is a word's number, or its hash if it has none.
    In a closed vocabulary only the words count, and all have the code 0."""
    # A hash as small as a number is turned over, so that codes tell which they are.
    code = np.where(numbers == UNKNOWN, np.where(hashes > _LOW, hashes, ~hashes), numbers.astype(np.uint64))
    place = np.flatnonzero(numbers == UNKNOWN)
    keys = code[place]
    if not words.open:
        return buckets.of_rare(keys, False), keys, np.zeros(len(keys), np.uint64), place
    past, before = np.roll(code, 1), np.roll(numbers, 1)
    past[bounds[:-1]], before[bounds[:-1]] = START, START
    after = np.flatnonzero(before == UNKNOWN)
    return (np.concatenate([buckets.of_rare(keys, False), buckets.of_rare(past[after], True)]),
            np.concatenate([keys, past[after]]), np.concatenate([past[place], code[after]]),
            np.concatenate([place, after]))


_TABLE = "bucket int, size bigint, pairs binary, others binary, counts binary"


def pair_counts(docs: DataFrame, known, buckets: Buckets) -> DataFrame:
    """A row per bucket: the number of different pairs, the packed pairs, and their counts; of pairs with
    a word without a number its hash and, as `others`, the codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rare: list[tuple] = []
        for batch in blocks(batches, block_bytes=BLOCK):
            hashes, bounds = _tokens(batch.column("text"))
            numbers = known.value.number(hashes)
            pairs = _pairs(numbers, bounds)
            held.append(pairs[_numbered(pairs)] if known.value.open else pairs)
            if buckets.rare:
                rare.append(_rare_pairs(hashes, numbers, bounds, known.value, buckets)[:3])
            if sum(map(len, held)) + sum(len(r[0]) for r in rare) >= FLUSH_PAIRS:
                yield from counted(held, rare)
                held, rare = [], []
        if held:
            yield from counted(held, rare)

    def counted(held: list[np.ndarray], rare: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        yield _dealt(_bucket(keys, buckets.pairs), keys, None, counts)
        if rare:
            of, keys, others = (np.concatenate(x) for x in zip(*rare))
            keys, others, counts, of = _summed(keys, others, np.ones(len(keys), np.int64), of)
            yield _dealt(of, keys, others, counts)

    def add(rows: pa.Table) -> pa.Table:
        keys, others, counts = _merged(rows)
        return pa.table({"bucket": rows.column("bucket")[:1], "size": [len(keys)],
                         "pairs": pa.array([pack(keys)], pa.binary()),
                         "others": pa.array([None if others is None else _planes(others)], pa.binary()),
                         "counts": pa.array([_squeeze(counts)], pa.binary())})

    return docs.select("text").mapInArrow(run, _TABLE).groupBy("bucket").applyInArrow(add, _TABLE)


def _parts(of: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The buckets and where they lie, of ascending ones."""
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    for low, high in zip(starts, [*starts[1:], len(of)]):
        yield int(of[low]), slice(int(low), int(high))


def _dealt(of: np.ndarray, keys: np.ndarray, others: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(of, kind="stable")
    keys, counts = keys[order], counts[order]
    others = None if others is None else others[order]
    parts = list(_parts(of[order]))
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in parts], pa.int32()),
         pa.array([p.stop - p.start for _, p in parts], pa.int64()),
         pa.array([pack(keys[p]) for _, p in parts], pa.binary()),
         pa.array([None if others is None else _planes(others[p]) for _, p in parts], pa.binary()),
         pa.array([_squeeze(counts[p]) for _, p in parts], pa.binary())],
        names=["bucket", "size", "pairs", "others", "counts"])


def _summed(keys: np.ndarray, others: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple:
    """Each different pair once, ascending, with the sum of its counts; `more` follows from the key and
    side, and is kept."""
    order = np.lexsort((others, keys, *more))
    keys, others, more = keys[order], others[order], [m[order] for m in more]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (others[1:] != others[:-1])
    for m in more:
        new[1:] |= m[1:] != m[:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], at) if len(at) else counts
    return keys[at], others[at], total, *(m[at] for m in more)


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    sizes = rows.column("size").to_pylist()
    keys = np.concatenate([unpack(x, n) for x, n in zip(rows.column("pairs").to_pylist(), sizes)])
    counts = np.concatenate([_stretch(x, n, np.int64) for x, n in
                             zip(rows.column("counts").to_pylist(), sizes)])
    if not rows.column("others").null_count:
        others = np.concatenate([_numbers(x, n) for x, n in zip(rows.column("others").to_pylist(), sizes)])
        return _summed(keys, others, counts)
    keys, at = np.unique(keys, return_inverse=True)
    return keys, None, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def _table(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray]]:
    columns = ("bucket", "size", "pairs", "others", "counts")
    for bucket, n, pairs, others, counts in zip(*(batch.column(c).to_pylist() for c in columns)):
        yield (bucket, unpack(pairs, n), None if others is None else _numbers(others, n),
               _stretch(counts, n, np.int64))


class RarePairs:
    """The rows of a bucket of pairs with a word without a number."""

    def __init__(self, keys: np.ndarray, others: np.ndarray, counts: np.ndarray):
        self.keys, self.others, self.counts = keys, others, counts
        self.words, self.first, size = np.unique(keys, return_index=True, return_counts=True)
        self.word = np.repeat(np.arange(len(self.words)), size)
        self.total = self.sums(counts)
        self._beside = np.unique(others)
        self._code = self.word * len(self._beside) + np.searchsorted(self._beside, others)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """By word, over its pairs."""
        return np.add.reduceat(values, self.first) if len(self.first) else values

    def find(self, keys: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of each key's word, whether the word is here, and its pair's count."""
        if not len(self.words):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        word, here = _at(self.words, keys)
        beside, there = _at(self._beside, others)
        at, hit = _at(self._code, word * len(self._beside) + beside)
        return word, here, np.where(here & there & hit, self.counts[at], 0)


def _at(ascending: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)
    return at, ascending[at] == values


@dataclass
class Histories:
    """By number: the divisor of a history's counts, and its backoff weight."""

    factor: np.ndarray
    total: np.ndarray
    weight: np.ndarray

    def seen(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return np.log10(_cut(counts, self.factor) / self.total[(keys >> _BITS).astype(np.int64)])

    def unseen(self, keys: np.ndarray, words: Vocabulary) -> np.ndarray:
        chance = words.chance[(keys & _LOW).astype(np.int64)]
        return np.log10(self.weight[(keys >> _BITS).astype(np.int64)] * chance)


def histories(table: DataFrame, known, buckets: Buckets) -> Histories:
    """What the pair table, partly summed in its buckets, says of each history; those without a number
    together, of which only the numbers of counts are used."""
    seen = [f"n{r}" for r in range(1, DISCOUNTED + 2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = known.value
        for batch in batches:
            for bucket, keys, others, counts in _table(batch):
                if others is None:
                    before, chance = keys >> _BITS, words.chance[(keys & _LOW).astype(np.int64)]
                elif not words.open:
                    continue
                elif buckets.by_word(bucket):
                    # Those with no numbered history are counted by their history.
                    pairs, numbered = RarePairs(keys, others, counts), others <= _LOW
                    chance = words.rare_chance(pairs.total)[pairs.word][numbered]
                    before, counts = others[numbered], counts[numbered]
                else:
                    before, chance = np.full(len(keys), UNKNOWN, np.uint64), np.zeros(len(keys))
                if not len(before):
                    continue
                history, at = np.unique(before, return_inverse=True)
                add = lambda x: pa.array(np.bincount(at, weights=x, minlength=len(history)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(history.astype(np.int64)),
                     *(add(counts == r) for r in range(1, DISCOUNTED + 2)), add(counts), add(chance)],
                    names=["history", *seen, "total", "chance"])

    kind = "history bigint, " + ", ".join(f"{c} double" for c in [*seen, "total", "chance"])
    parts = table.mapInArrow(run, kind)
    rows = parts.groupBy("history").agg(
        *(F.sum(c).alias(c) for c in [*seen, "total", "chance"])).toArrow()
    history = np.asarray(rows.column("history"))
    factor = discounts(np.array([np.asarray(rows.column(c)).sum() for c in seen]))
    total = np.asarray(rows.column("total"))
    off = np.zeros(len(total))
    for r in range(1, DISCOUNTED + 1):
        off += (1 - factor[r]) * r * np.asarray(rows.column(f"n{r}"))
    divisor = total + (off <= 0)
    rest = (off + (off <= 0)) / divisor
    size = len(known.value.chance)
    out = Histories(factor, np.ones(size), np.ones(size))
    out.total[history] = divisor
    out.weight[history] = rest / np.maximum(1 - np.asarray(rows.column("chance")), 1e-300)
    return out


def hot_pairs(table: DataFrame, of, most: int = HOT_PAIRS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent pairs, ascending, and their scores."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, counts in _table(batch):
                bins, n = np.unique((np.log2(counts) * _STEPS).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n)], names=["bin", "n"])

    bins = table.mapInArrow(count, "bin bigint, n bigint").groupBy("bin").agg(F.sum("n").alias("n"))
    least = max(2, _threshold({r["bin"]: r["n"] for r in bins.collect()}, most))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, _, counts in _table(batch):
                hot = counts >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[hot].view(np.int64)), pa.array(counts[hot])], names=["pair", "n"])

    rows = table.mapInArrow(pick, "pair bigint, n bigint").toArrow()
    keys = np.asarray(rows.column("pair")).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], of.value.seen(keys, np.asarray(rows.column("n")))[order]


_MESSAGE = ("bucket int, size bigint, pairs binary, others binary, places binary, width int, "
            "rows binary, block bigint, own binary")
_ANSWER = "block bigint, rows binary, score binary, n_known binary, base_score binary, own binary"
_ROW = ("row bigint, doc_id bigint, held_out boolean, n_tokens bigint, copies bigint, n_known bigint, "
        "base_score double, score double")


def _schema(kind: str) -> pa.Schema:
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64(),
             "boolean": pa.bool_()}
    return pa.schema([(c, types[t]) for c, t in (x.split() for x in kind.split(", "))])


def _messages(docs: DataFrame, known, hot, buckets: Buckets) -> DataFrame:
    """What each bucket is asked by a block of texts, and, for any one of them to pass on, what can be
    told of the texts where they are read."""
    schema = _schema(_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (common, scores) = known.value, hot.value
        base_of = words.base(words.counts)
        if buckets.rare:
            base_of[UNKNOWN] = 0.0
        first = TaskContext.get().partitionId() << 32
        for block, batch in enumerate(blocks(batches, block_bytes=BLOCK), first):
            hashes, bounds = _tokens(batch.column("text"))
            numbers = words.number(hashes)
            text = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pairs = _pairs(numbers, bounds)
            score, other = np.zeros(len(pairs)), np.ones(len(pairs), bool)
            if len(common):
                at, found = _at(common, pairs)
                score, other = np.where(found, scores[at], 0.0), ~found
            if words.open:
                other &= _numbered(pairs)
            rows = np.asarray(batch.column("row"))
            total = lambda x: np.bincount(text, weights=x, minlength=batch.num_rows)
            own = pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "held_out")), pa.array(np.diff(bounds)),
                 pa.array(total(numbers != UNKNOWN).astype(np.int64)), pa.array(total(base_of[numbers])),
                 pa.array(total(score))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as stream:
                stream.write_batch(own)
            out = [{"bucket": int(mix(rows[:1].view(np.uint64))[0] % np.uint64(buckets.pairs)), "rows": rows.tobytes(), "block": block,
                    "own": sink.getvalue().to_pybytes()}]
            pairs, at = pairs[other], text[other]
            order = np.argsort(pairs, kind="stable")
            of = _bucket(pairs[order], buckets.pairs)
            by = np.argsort(of.astype(np.uint16) if buckets.pairs < 1 << 16 else of, kind="stable")
            order = order[by]
            asked = [(of[by], pairs[order], None, at[order])]
            if buckets.rare:
                of, keys, others, place = _rare_pairs(hashes, numbers, bounds, words, buckets)
                order = np.lexsort((place, others, keys, of))
                asked.append((of[order], keys[order], others[order], text[place[order]]))
            for of, keys, others, at in asked:
                for b, part in _parts(of):
                    mark = np.zeros(batch.num_rows, bool)
                    mark[at[part]] = True
                    used = np.flatnonzero(mark)
                    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
                    out.append({
                        "bucket": b, "size": part.stop - part.start, "pairs": pack(keys[part]),
                        "others": None if others is None else _planes(others[part]),
                        "places": _squeeze((np.cumsum(mark) - 1)[at[part]].astype(kind)),
                        "width": kind().itemsize, "rows": rows[used].tobytes(), "block": block})
            yield pa.RecordBatch.from_pylist(out, schema)

    return docs.mapInArrow(run, _MESSAGE)


def _chances(table: DataFrame, known, buckets: Buckets) -> DataFrame:
    """To the bucket of each history without a number: what its words without a number have as
    probabilities together, by bucket of the words. These messages have no block."""
    schema = _schema(_MESSAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, keys, others, counts in _table(batch):
                pairs, rare = RarePairs(keys, others, counts), others > _LOW
                history, at = np.unique(others[rare], return_inverse=True)
                chance = np.bincount(at, weights=known.value.rare_chance(pairs.total)[pairs.word][rare],
                                     minlength=len(history))
                of = buckets.of_rare(history, True)
                order = np.argsort(of, kind="stable")
                yield pa.RecordBatch.from_pylist(
                    [{"bucket": b, "size": part.stop - part.start, "pairs": pack(history[order][part]),
                      "own": chance[order][part].tobytes()} for b, part in _parts(of[order])], schema)

    return table.filter((F.col("bucket") >= buckets.pairs) & (F.col("bucket") < buckets.pairs + buckets.rare)
                        ).mapInArrow(run, _MESSAGE)


class _Numbered:
    """Answers of a bucket of pairs of numbered words."""

    def __init__(self, table: tuple | None, words: Vocabulary, of: Histories):
        self.table, self.words, self.of = table, words, of

    def __call__(self, pairs: np.ndarray, others: None) -> dict[str, np.ndarray]:
        found = self.of.unseen(pairs, self.words)
        if self.table:
            at, hit = _at(self.table[1], pairs)
            found[hit] = self.of.seen(pairs[hit], self.table[3][at[hit]])
        return {"score": found}


class _ByWord:
    """Answers of a bucket of words without a number: base scores; scores of pairs whose history has a
    number; and, of the others, only the part of the word in a pair that was not seen."""

    def __init__(self, pairs: RarePairs, words: Vocabulary, of: Histories):
        self.pairs, self.words, self.of = pairs, words, of

    def __call__(self, keys: np.ndarray, others: np.ndarray) -> dict[str, np.ndarray]:
        word, here, n = self.pairs.find(keys, others)
        count = np.zeros(len(keys), np.int64)
        count[here] = self.pairs.total[word[here]]
        out = {"n_known": here, "base_score": self.words.base(count)}
        if self.words.open:
            numbered = others <= _LOW
            history = np.where(numbered, others, UNKNOWN).astype(np.int64)
            weight = np.where(numbered, self.of.weight[history], 1.0)
            part = weight * self.words.rare_chance(count)
            part[n > 0] = np.where(numbered, _cut(n, self.of.factor) / self.of.total[history], 1.0)[n > 0]
            out["score"] = np.log10(part)
        return out


class _ByHistory:
    """Answers of a bucket of histories without a number: scores of pairs that were seen or whose word
    has a number; of the others, only the part of the history. `passed` has the histories and
    probabilities that `_chances` sends."""

    def __init__(self, pairs: RarePairs, passed: list[tuple], words: Vocabulary, of: Histories):
        self.pairs, self.words, self.of = pairs, words, of
        seen = pairs.sums(self._chance(pairs.others, 0.0))
        for histories_, chance in passed:
            seen[np.searchsorted(pairs.words, histories_)] += chance
        small = np.where(pairs.counts <= DISCOUNTED, pairs.counts - _cut(pairs.counts, of.factor), 0.0)
        off = pairs.sums(small)
        self.total = pairs.total + (off <= 0)
        self.weight = (off + (off <= 0)) / self.total / np.maximum(1 - seen, 1e-300)

    def _chance(self, codes: np.ndarray, otherwise: float) -> np.ndarray:
        numbered = codes <= _LOW
        return np.where(numbered, self.words.chance[np.where(numbered, codes, UNKNOWN).astype(np.int64)],
                        otherwise)

    def __call__(self, keys: np.ndarray, others: np.ndarray) -> dict[str, np.ndarray]:
        history, here, n = self.pairs.find(keys, others)
        weight = np.ones(len(keys))
        weight[here] = self.weight[history[here]]
        part = weight * self._chance(others, 1.0)
        seen = n > 0
        part[seen] = _cut(n[seen], self.of.factor) / self.total[history[seen]]
        return {"score": np.log10(part)}


def _answers(sent: DataFrame, table: DataFrame, known, of, buckets: Buckets) -> DataFrame:
    """Per row, and once per block it was read in: all that is known of it."""
    schema = _schema(_ANSWER)

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        bucket, rows = key[0].as_py(), left.to_pylist()
        found = next(_table(right.combine_chunks().to_batches()[0])) if right.num_rows else None
        if bucket < buckets.pairs:
            answer = _Numbered(found, known.value, of.value)
        else:
            none = np.zeros(0, np.uint64)
            pairs = RarePairs(*(found[1:] if found else (none, none, np.zeros(0, np.int64))))
            if buckets.by_word(bucket):
                answer = _ByWord(pairs, known.value, of.value)
            else:
                passed = [(unpack(r["pairs"], r["size"]), np.frombuffer(r["own"], np.float64))
                          for r in rows if r["block"] is None]
                answer = _ByHistory(pairs, passed, known.value, of.value)
        out = []
        for r in rows:
            if r["block"] is None:
                continue
            line = {"block": r["block"], "rows": r["rows"], "own": r["own"]}
            if r["own"] is None:
                place = _stretch(r["places"], r["size"], np.uint16 if r["width"] == 2 else np.uint32)
                others = None if r["others"] is None else _numbers(r["others"], r["size"])
                for c, x in answer(unpack(r["pairs"], r["size"]), others).items():
                    line[c] = np.bincount(place, weights=x, minlength=len(r["rows"]) // 8).tobytes()
            out.append(line)
        return pa.Table.from_pylist(out, schema)

    def add(key: tuple, answers: pa.Table) -> pa.Table:
        lines = answers.to_pylist()
        ids = np.unique(np.concatenate([np.frombuffer(r["rows"], np.int64) for r in lines]))
        sums = {c: np.zeros(len(ids)) for c in ("n_known", "base_score", "score")}
        copies, first = np.zeros(len(ids), np.int64), np.full(len(ids), -1)
        owned: list[pa.Table] = []
        for r in lines:
            at = np.searchsorted(ids, np.frombuffer(r["rows"], np.int64))
            if r["own"] is not None:
                own = pa.ipc.open_stream(r["own"]).read_all()
                first[at] = sum(map(len, owned)) + np.arange(len(at))
                copies += np.bincount(at, minlength=len(ids))
                owned.append(own)
            for c in sums:
                part = own.column(c).to_numpy() if r["own"] is not None else (
                    None if r[c] is None else np.frombuffer(r[c], np.float64))
                if part is not None:
                    sums[c] += np.bincount(at, weights=part, minlength=len(ids))
        told = pa.concat_tables(owned).take(pa.array(first, mask=first < 0)) if owned else None
        return pa.table({"row": ids, **{c: told.column(c) if owned else pa.nulls(len(ids), t) for c, t in (
            ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()))}, "copies": copies,
            "n_known": sums["n_known"].round().astype(np.int64), "base_score": sums["base_score"],
            "score": sums["score"]})

    # What the buckets say of the texts of one block comes back in one row a bucket.
    answers = sent.groupBy("bucket").cogroup(table.groupBy("bucket")).applyInArrow(score, _ANSWER)
    return answers.groupBy("block").applyInArrow(add, _ROW)


def score_documents(docs: DataFrame, vocabulary_size: int | None = None, hot: int = HOT_PAIRS,
                    numbered: int = VOCABULARY) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    All words of the training documents are in the model, at most `numbered` of them in the memory of
    every task; a `vocabulary_size` closes the model's vocabulary at that many words.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    rows = documents(docs).withColumns({
        "held_out": held, "row": F.xxhash64("doc_id", F.coalesce("text", F.lit("")))})
    train = rows.filter("NOT held_out")
    spark = docs.sparkSession.sparkContext
    counts = stored(word_counts(train), "words")
    closed = vocabulary_size is not None
    words = vocabulary(counts, vocabulary_size if closed else numbered, closed)
    known = spark.broadcast(words)
    buckets = Buckets(1 + words.tokens // BUCKET_TOKENS, -(-words.rare // RARE_TOKENS))
    table = stored(pair_counts(train, known, buckets), "pairs")
    of = spark.broadcast(histories(table, known, buckets))
    common = spark.broadcast(hot_pairs(table.filter(F.col("bucket") < buckets.pairs), of, hot))

    sent = _messages(rows, known, common, buckets)
    if words.open:
        sent = sent.union(_chances(table, known, buckets))
    # Equal rows have one number; each of them gave all parts, and each is returned.
    found = _answers(sent, table, known, of, buckets).groupBy("row").agg(
        *(F.max(c).alias(c) for c in ("doc_id", "held_out", "n_tokens")),
        *(F.sum(c).alias(c) for c in ("copies", "n_known", "base_score", "score")))
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return found.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") / F.col("copies")).cast("bigint").alias("n_known"),
        F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"),
        (F.col("score") / F.col("copies")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
