"""Packing token ids into sequences without padding, by powers of two.

A document's ids, its end id included, are cut into as many pieces of the full sequence length as
fit, and the rest into the powers of two that its length is made of, the largest first. A piece is a
sequence of its own: no sequence crosses documents, none is padded, and a batch is taken from one
bucket, that of all pieces of one length. Sequences are numbered within their bucket, so a batch
is a range of numbers.

Ids are the tokenizer's. Texts of Latin letters, digits and signs are cut by the tokenizer's own
pattern here, and only distinct parts go through its merges, once in a worker, which remembers them
up to a bound. In other texts that holds for the stretches between white space, which separates what the
tokenizer sees; a stretch with other characters, or that may hold a special token, goes through the
whole tokenizer.

A null or empty text has only the end id: one piece of one id. Rows with a null id and rows that
repeat an id or a whole row are documents of their own, equal ones with equal pieces under other
numbers. An empty table gives no pieces; other columns are not read. A long text is cut whole; memory
follows the longest single text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinefold.llm.tables import documents, read, stored
from cinefold.llm.words import blocks

TOKENIZER_FILE = "/opt/tokenizers/word_bpe_49k.json"
# A power of two.
SEQUENCE = 4096
END_ID = 2
# What a worker remembers: the number of parts and stretches, and the characters and ids they take
# together.
KNOWN, KNOWN_SIZE = 1 << 19, 1 << 24
# A block with a longer one is forgotten at once.
LONG = 256
# Pieces that are numbered by one task.
CHUNK_PIECES = 1 << 17


# Characters for which the tokenizer's other steps are only lower-casing and bytes as characters; all
# of its white space among them is in ASCII. U+0130 is left out, whose small form is two characters.
LATIN = [c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]) if c != "\u0130"]


def _class(characters: Iterable[str]) -> str:
    return "".join(map(re.escape, characters))


def _pattern() -> re.Pattern:
    """The pattern by which the tokenizer's file cuts a text, for Latin characters in lower case."""
    letters = _class(c for c in LATIN if unicodedata.category(c)[0] == "L")
    numbers = _class(c for c in LATIN if unicodedata.category(c)[0] == "N")
    # The endings that are parts of their own.
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^ \t-\r{letters}{numbers}]+")


def _byte_characters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as they are, the others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


class Numbers(dict):
    """Numbers parts and stretches as they are first asked for; `fresh` lists the new ones."""

    def __init__(self):
        self.fresh: list[str | bytes] = []

    def __missing__(self, unit: str | bytes) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Tokens:
    """Ids of texts, through the parts (str) and stretches (bytes) that a task has met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.parts, self.latin = _pattern(), re.compile(f"[ \\t-\\r{_class(LATIN)}]*")
        self.characters = _byte_characters()
        self._forget()

    def _forget(self) -> None:
        self.place = Numbers()
        self.pool, self.start = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.count, self.size = np.zeros(0, np.int64), 0

    def _units(self, text: str) -> list[str | bytes]:
        if self.latin.fullmatch(text) and not self.special.search(text):
            return self.parts.findall(text.lower())
        out: list[str | bytes] = []
        for raw in text.encode().split():
            word = raw.decode()
            plain = self.latin.fullmatch(word) and not self.special.search(word)
            out.extend(self.parts.findall(word.lower()) if plain else [raw])
        return out

    def _learn(self, fresh: list[str | bytes]) -> None:
        whole = [k.decode() for k in fresh if isinstance(k, bytes)]
        found = iter(self.tokenizer.encode_batch(whole, add_special_tokens=False))
        merge, written = self.tokenizer.model.tokenize, self.characters
        ids = [next(found).ids if isinstance(k, bytes) else
               [t.id for t in merge(k.encode().decode("latin-1").translate(written))] for k in fresh]
        count = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter((i for x in ids for i in x), np.uint32, count.sum())
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, flat])
        self.size += sum(map(len, fresh)) + len(flat)

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind, and how many each text has."""
        if len(self.place) > KNOWN or self.size > KNOWN_SIZE:
            self._forget()
        units = [self._units(text or "") for text in texts.to_pylist()]
        words = np.array([len(x) for x in units], np.int64)
        every = map(self.place.__getitem__, chain.from_iterable(units))
        at = np.fromiter(every, np.int64, words.sum())
        fresh, self.place.fresh = self.place.fresh, []
        if fresh:
            self._learn(fresh)
        per_unit = self.count[at]
        edges = np.concatenate([[0], np.cumsum(per_unit)])
        last = np.cumsum(words)
        size = edges[last] - edges[last - words]
        step = np.arange(edges[-1]) - np.repeat(edges[:-1], per_unit)
        ids = np.full(edges[-1] + len(units), end_id, np.uint32)
        inner = np.ones(len(ids), bool)
        inner[np.cumsum(size + 1) - 1] = False
        ids[inner] = self.pool[np.repeat(self.start[at], per_unit) + step]
        if any(len(k) > LONG for k in fresh):
            self._forget()
        return ids, size + 1


@lru_cache(maxsize=1)
def remembered(path: str) -> Tokens:
    """The ids that this worker knows from earlier tasks; they only save work."""
    return Tokens(path)


def binary_pieces(sizes: np.ndarray, longest: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents of these sizes: document, start in it, and length, in order."""
    bits = longest.bit_length() - 1
    powers = longest >> np.arange(bits + 1)
    times = np.concatenate([(sizes // longest)[:, None],
                            (sizes[:, None] & powers[1:]) // powers[1:]], axis=1)
    length = np.repeat(np.tile(powers, len(sizes)), times.ravel())
    document = np.repeat(np.arange(len(sizes)), times.sum(axis=1))
    before = np.cumsum(length) - length
    base = np.cumsum(sizes) - sizes
    return document, before - base[document], length


def cut_documents(docs: DataFrame, tokenizer: str = TOKENIZER_FILE, longest: int = SEQUENCE,
                  end_id: int = END_ID, with_ids: bool = True, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """The pieces: doc_id, start, length, ids_crc32, doc_tokens and, if wanted, the ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError(f"{longest} is not a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = remembered(tokenizer)
        for batch in blocks(batches):
            ids, sizes = tokens.encode(batch.column("text"), end_id)
            document, start, length = binary_pieces(sizes, longest)
            raw, ends = ids.astype("<u4").tobytes(), np.cumsum(length)
            marks = [zlib.crc32(raw[4 * a:4 * b]) for a, b in
                     zip((ends - length).tolist(), ends.tolist())]
            columns = [pc.take(batch.column("doc_id"), pa.array(document)), pa.array(start),
                       pa.array(length), pa.array(marks, pa.int64()), pa.array(sizes[document])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                bounds = np.concatenate([[0], ends]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return documents(docs, id_column, text_column).mapInArrow(
        run, schema + (", ids array<int>" if with_ids else ""))


def pack_documents(docs: DataFrame, longest: int = SEQUENCE, chunk_pieces: int = CHUNK_PIECES,
                   **options) -> DataFrame:
    """The pieces as sequences: `bucket` is the length, `place` the number within the bucket, from 0
    and without gaps, `sequence_id` one for the whole table, and `offset`, where the piece begins in
    its sequence, 0. Options are those of `cut_documents`.

    Pieces are dealt into chunks by content, numbered there by id and start, and each chunk's first
    number follows from the counts of the chunks before, so a rerun gives the same numbers.
    """
    pieces = stored(cut_documents(docs, longest=longest, **options), "pieces")
    chunks = max(1, -(-pieces.count() // chunk_pieces))
    mark = F.xxhash64("doc_id", "start", "ids_crc32")
    pieces = pieces.withColumn("chunk", F.pmod(mark, F.lit(chunks)))
    counts = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    numbered = pieces.withColumn("at", F.row_number().over(order) - 1).join(base, ["length", "chunk"])
    place = F.col("base") + F.col("at")
    buckets = longest.bit_length()
    bit = F.log2(F.col("length")).cast("bigint")
    return numbered.select(
        *[c for c in pieces.columns if c != "chunk"], (place * buckets + bit).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"), F.col("length").alias("bucket"), place.alias("place"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), with_ids=False)
