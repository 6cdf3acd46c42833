"""License statements in texts: exact phrases, and an exact set-similarity join with templates.

A text, lower-cased in A-Z, is cut into blocks of `BLOCK_WORDS` words that overlap by half, so any
stretch of half a block lies whole in some block. The join finds every block whose word set holds
at least `threshold` of a template's. Only words of templates matter; they are ordered by their
frequency in the whole corpus, rarest first. A block can reach c = ceil(threshold * size) common
words only if it has one of the template's first size - c + 1 (prefix), has c such words at all
(length), and has enough of them left after the first one they share (position). What passes these
filters is counted exactly. The templates are a parameter and their index is refused above
`MAX_TEMPLATE_WORDS`, so it goes to every task, and a text meets it where it is read: nothing but
word counts is shuffled.

Null or empty texts have no words and no labels. Ids are passed on as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import documents, read
from cinefold.llm.words import NOT_ALNUM, Words, blocks, hash_bytes

BLOCK_WORDS = 64
THRESHOLD = 0.8
MAX_TEMPLATE_WORDS = 1_000_000

# Phrases that are a license wherever they stand.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Statements of licenses, as words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files", "mit"),
    ("licensed under the apache license version 2", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license",
     "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)


@dataclass
class Index:
    """Templates over the words they use, numbered by frequency, rarest first."""

    labels: list[str]
    hashes: np.ndarray  # sorted hashes of the words
    ranks: np.ndarray  # their numbers
    holds: np.ndarray  # templates x words
    sizes: np.ndarray
    needed: np.ndarray  # common words that reach the threshold
    entry_word: np.ndarray  # the prefix words of all templates, sorted,
    entry_template: np.ndarray  # with the template
    entry_place: np.ndarray  # and the place in it


def _hashed(text: str) -> list[int]:
    return [hash_bytes(x.encode()) for x in text.split()]


def frequencies(docs: DataFrame, words: Sequence[int]) -> dict[int, int]:
    """How often each of some words, by hash, occurs in all texts."""
    if len(words) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"more than {MAX_TEMPLATE_WORDS} template words")
    wanted = np.sort(np.array(list(words), np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for batch in blocks(batches):
            hashes = Words(batch.column("text"), NOT_ALNUM, lower=True).hashes
            at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
            total += np.bincount(at[wanted[at] == hashes], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(wanted), dtype=np.int32)), pa.array(total)],
            names=["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word int, n bigint").groupBy("word").agg(
        F.sum("n").alias("n")).collect()
    return {int(wanted[r["word"]]): r["n"] for r in rows}


def index(templates: Sequence[tuple[str, str]], counts: dict[int, int],
          threshold: float = THRESHOLD) -> Index:
    sets = [set(_hashed(text)) for text, _ in templates]
    order = sorted(set().union(*sets), key=lambda h: (counts.get(h, 0), h))
    rank = {h: i for i, h in enumerate(order)}
    holds = np.zeros((len(sets), len(order)), bool)
    entries = []
    needed = [math.ceil(threshold * len(s) - 1e-9) for s in sets]
    for t, members in enumerate(sets):
        mine = sorted(rank[h] for h in members)
        holds[t, mine] = True
        entries += [(w, t, place) for place, w in enumerate(mine[:len(mine) - needed[t] + 1])]
    hashes = np.array(sorted(order), np.uint64)
    entry = np.array(sorted(entries), np.int64).reshape(-1, 3)
    return Index([label for _, label in templates], hashes,
                 np.array([rank[int(h)] for h in hashes]), holds, holds.sum(axis=1),
                 np.array(needed), entry[:, 0], entry[:, 1], entry[:, 2])


def join(w: Words, of: Index, block_words: int = BLOCK_WORDS) -> tuple[np.ndarray, ...]:
    """All blocks that meet a template: text, first word of the block, template, common words."""
    none = np.zeros(0, np.int64)
    if not len(w):
        return none, none, none, none
    at = np.minimum(np.searchsorted(of.hashes, w.hashes), len(of.hashes) - 1)
    known = np.flatnonzero(of.hashes[at] == w.hashes)
    rank, text = of.ranks[at[known]], w.text[known]
    half = block_words // 2
    part = (known - w.first[text]) // half
    # Each word lies in the block that begins with its half and in the one before.
    block = np.concatenate([part, part[part > 0] - 1])
    text, rank = np.concatenate([text, text[part > 0]]), np.concatenate([rank, rank[part > 0]])
    order = np.lexsort((rank, block, text))
    text, block, rank = text[order], block[order], rank[order]
    fresh = np.ones(len(text), bool)
    fresh[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1]) | (rank[1:] != rank[:-1])
    text, block, rank = text[fresh], block[fresh], rank[fresh]
    head = np.ones(len(text), bool)
    head[1:] = (text[1:] != text[:-1]) | (block[1:] != block[:-1])
    heads = np.flatnonzero(head)
    size = np.diff(np.append(heads, len(text)))
    group = np.cumsum(head) - 1
    place = np.arange(len(text)) - heads[group]

    low = np.searchsorted(of.entry_word, rank)
    count = np.searchsorted(of.entry_word, rank, "right") - low
    token = np.repeat(np.arange(len(rank)), count)
    entry = np.repeat(low, count) + np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
    template, group_of = of.entry_template[entry], group[token]
    key = group_of * len(of.labels) + template
    _, first = np.unique(key, return_index=True)  # the rarest word that both share
    token, entry, template, group_of = token[first], entry[first], template[first], group_of[first]
    left = 1 + np.minimum(of.sizes[template] - of.entry_place[entry] - 1,
                          size[group_of] - place[token] - 1)
    possible = (size[group_of] >= of.needed[template]) & (left >= of.needed[template])
    template, group_of = template[possible], group_of[possible]

    n = size[group_of]
    pair = np.repeat(np.arange(len(n)), n)
    word = np.repeat(heads[group_of], n) + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    common = np.bincount(pair, weights=of.holds[template[pair], rank[word]], minlength=len(n))
    met = common >= of.needed[template]
    group_of, template = group_of[met], template[met]
    at = heads[group_of]
    return text[at], block[at] * half, template, common[met].astype(np.int64)


def places(w: Words, phrase: list[int]) -> np.ndarray:
    """Numbers of the words from which a phrase stands."""
    found = w.runs(len(phrase))
    for i, h in enumerate(phrase):
        equal = w.hashes == np.uint64(h)
        found[:len(found) - i] &= equal[i:]
    return np.flatnonzero(found)


def _prepared(docs: DataFrame, templates: Sequence[tuple[str, str]], threshold: float):
    words = set().union(*(_hashed(text) for text, _ in templates))
    found = index(templates, frequencies(docs, sorted(words)), threshold)
    return docs.sparkSession.sparkContext.broadcast(found)


def similar_blocks(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES,
                   threshold: float = THRESHOLD) -> DataFrame:
    """The join itself: doc_id, first word of the block, template, label, containment."""
    docs = documents(docs)
    known = _prepared(docs, templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for batch in blocks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            text, start, template, common = join(w, of)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(text)), pa.array(start),
                 pa.array(template.astype(np.int32)),
                 pa.array([of.labels[t] for t in template.tolist()], pa.string()),
                 pa.array(common / of.sizes[template])],
                names=["doc_id", "first_word", "template", "label", "containment"])

    return docs.mapInArrow(run, "doc_id bigint, first_word bigint, template int, label string, "
                                "containment double")


def scan(docs: DataFrame, phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_words, the phrases' places, their labels, all labels, and the largest
    containment among the blocks that meet a template (0 if none does)."""
    docs = documents(docs)
    known = _prepared(docs, templates, threshold)
    wanted = [(_hashed(text), label) for text, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = known.value
        for batch in blocks(batches):
            n = batch.num_rows
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            total = np.zeros(n, np.int64)
            low = np.full(n, np.iinfo(np.int64).max)
            high = np.full(n, -1)
            base: dict[int, set[str]] = {}
            for phrase, label in wanted:
                at = places(w, phrase)
                text = w.text[at]
                np.add.at(total, text, 1)
                np.minimum.at(low, text, at - w.first[text])
                np.maximum.at(high, text, at - w.first[text])
                for i in np.unique(text).tolist():
                    base.setdefault(i, set()).add(label)
            text, _, template, common = join(w, of)
            score = np.zeros(n)
            np.maximum.at(score, text, common / of.sizes[template])
            more = {i: set(x) for i, x in base.items()}
            for i, t in zip(text.tolist(), template.tolist()):
                more.setdefault(i, set()).add(of.labels[t])
            without = total == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts), pa.array(total),
                 pa.array(low, mask=without), pa.array(high, mask=without),
                 pa.array([",".join(sorted(base.get(i, ()))) for i in range(n)], pa.string()),
                 pa.array([",".join(sorted(more.get(i, ()))) for i in range(n)], pa.string()),
                 pa.array(score)],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                       "labels", "score"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, "
                                "last_word bigint, base_labels string, labels string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _rows(pairs: Sequence[tuple[str, str]]) -> str:
    return ", ".join(f"(string_split('{text}', ' '), '{label}')" for text, label in pairs)


ORACLE_SQL = rf"""
WITH phrases(phrase, label) AS (VALUES {_rows(PHRASES)}),
templates(raw, label) AS (VALUES {_rows(TEMPLATES)}),
w AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS (SELECT row, i - 1 AS place, label FROM w, unnest(range(1, len(ws) + 1)) AS u(i)
           JOIN phrases ON ws[i:i + len(phrase) - 1] = phrase),
base AS (SELECT row, count(*) AS n, min(place) AS low, max(place) AS high,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY row),
blocks AS (SELECT row, list_distinct(ws[k + 1:k + {BLOCK_WORDS}]) AS block
           FROM w, unnest(range(0, len(ws), {BLOCK_WORDS // 2})) AS u(k)),
alike AS (SELECT row, label, len(list_intersect(block, list_distinct(raw))) AS common,
                 len(list_distinct(raw)) AS size FROM blocks, templates),
met AS (SELECT row, label, common / size AS share FROM alike
        WHERE common >= ceil({THRESHOLD} * size - 1e-9)),
every AS (SELECT row, label FROM met UNION SELECT row, label FROM places),
labelled AS (SELECT row, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY row),
best AS (SELECT row, max(share) AS share FROM met GROUP BY row)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_base, low AS first_word, high AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(labelled.labels, '') AS labels,
       cast(coalesce(share, 0) AS double) AS score
FROM w LEFT JOIN base USING (row) LEFT JOIN labelled USING (row) LEFT JOIN best USING (row)
"""
