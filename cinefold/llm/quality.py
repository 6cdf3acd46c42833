"""Quality rules as a short-circuit cascade.

Each rule rejects on one or two measures of a text. Its cost (seconds per text) and its
selectivity (share rejected among texts that the rules before it let pass) are estimated on a
sample, and rules are ordered by rejections per cost. Over the whole table a text leaves the
cascade at the first rule that rejects it, so dear measures are taken only of what is left. The
verdict does not depend on the order.

The toxic rule is learnt from a table of labels. A word counts by its stems, its first six and its
first eight code points (shorter words whole). A stem is marked if it stands in enough of the toxic
texts and in few of the others; a text is rejected if at least two of its words, and one word in
500, have a marked stem. The stems are counted on the texts of at most `LABELLED` labelled ids,
those with the smallest md5, so the rule is the same on every run and a table of any size is
learnt from that many ids; this costs one more scan of ids and texts. Without labels, or where too
few are toxic to mark a stem, the rule rejects nothing.

Null texts have no words. Rows keep their ids as they are, null or repeated ones too. Labels without
id or verdict are left out, of several for an id the highest counts, and texts with the same id
count as one in learning. On an empty table the result is empty.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import documents, read, stored
from cinefold.llm.words import NOT_ALNUM, Words, blocks, mix, text_bytes

WINDOW = 8
# The sample that orders the rules: so many texts, none longer than so many bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 2_000, 1 << 15
TRIAL_TEXTS = 64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

# The toxic rule: ids to learn from, code points of a stem, and when a stem is marked: in at least
# MARKED_TEXTS toxic texts and one in MARKED_PART of them, and MARKED_RATIO times as many as others.
LABELLED = 20_000
STEMS = (6, 8)
MARKED_TEXTS, MARKED_PART, MARKED_RATIO = 8, 50, 8
# A text is toxic from so many words with a marked stem on, if they are one in TOXIC_PART.
TOXIC_WORDS, TOXIC_PART = 2, 500


class Block:
    """Some texts and the measures taken of them so far."""

    def __init__(self, texts: pa.Array, measures: dict[str, np.ndarray] | None = None):
        self.texts = texts
        self.measures = measures or {}
        self._words: Words | None = None

    @property
    def words(self) -> Words:
        if self._words is None:
            self._words = Words(self.texts)
        return self._words

    def measure(self, name: str) -> np.ndarray:
        if name not in self.measures:
            self.measures[name] = MEASURES[name](self)
        return self.measures[name]

    def take(self, rows: np.ndarray) -> Block:
        if len(rows) == len(self.texts):
            return self
        return Block(self.texts.take(pa.array(rows)), {k: v[rows] for k, v in self.measures.items()})


def _per_text(block: Block, of_bytes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(of_bytes, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def word_chars(block: Block) -> np.ndarray:
    w = block.words
    total = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(total[w.ends] - total[w.starts])])
    return chars[w.first[1:]] - chars[w.first[:-1]]


def n_symbols(block: Block) -> np.ndarray:
    offsets, data = text_bytes(block.texts)
    return _per_text(block, SYMBOLS[data], offsets)


def _lines(block: Block) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = text_bytes(block.texts)
    raw = data.tobytes()
    lines, repeats = np.zeros(len(block.texts), np.int64), np.zeros(len(block.texts), np.int64)
    for i, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        full = [x for x in raw[low:high].split(b"\n") if x.strip()]
        lines[i], repeats[i] = len(full), len(full) - len(set(full))
    return lines, repeats


def n_lines(block: Block) -> np.ndarray:
    block.measures["n_lines"], block.measures["n_dup_lines"] = _lines(block)
    return block.measures["n_lines"]


def n_dup_lines(block: Block) -> np.ndarray:
    n_lines(block)
    return block.measures["n_dup_lines"]


def n_repeat_words(block: Block) -> np.ndarray:
    w = block.words
    starts = np.flatnonzero(w.runs(WINDOW))
    keys = w.run_hashes(WINDOW)[starts] ^ mix(w.text[starts].astype(np.uint64))
    order = np.argsort(keys)
    ranked = keys[order]
    equal = ranked[1:] == ranked[:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, starts[again], 1)
    np.add.at(edge, starts[again] + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(w.text[covered], minlength=len(block.texts))


def n_distinct(block: Block) -> np.ndarray:
    w = block.words
    _, firsts = np.unique(w.hashes ^ mix(w.text.astype(np.uint64)), return_index=True)
    return np.bincount(w.text[firsts], minlength=len(block.texts))


def stems(w: Words) -> list[np.ndarray]:
    """For each length in STEMS, the hash of every word's first so many code points."""
    begins = np.flatnonzero((w.data & 0xC0) != 0x80)
    at = np.searchsorted(begins, w.starts)
    begins = np.append(begins, len(w.data))
    return [w.span_hashes(np.minimum(w.ends, begins[np.minimum(at + n, len(begins) - 1)]))
            for n in STEMS]


MEASURES: dict[str, Callable[[Block], np.ndarray]] = {
    "n_words": lambda block: block.words.counts,
    "word_chars": word_chars,
    "n_symbols": n_symbols,
    "n_lines": n_lines,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_distinct": n_distinct,
}


@dataclass(frozen=True)
class Rule:
    """Rejects the texts for which `rejects` of its measures is true."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., np.ndarray]

    def apply(self, block: Block) -> np.ndarray:
        return self.rejects(*(block.measure(n) for n in self.needs))


@dataclass(frozen=True)
class ToxicRule:
    """Rejects texts with enough words that have one of the `marked` stems, given by hash."""

    marked: np.ndarray
    name: str = "toxic"

    def apply(self, block: Block) -> np.ndarray:
        w = Words(block.texts, NOT_ALNUM, lower=True)
        if not len(w):
            return np.zeros(len(block.texts), bool)
        hit = np.logical_or.reduce([np.isin(h, self.marked) for h in stems(w)])
        hits = np.bincount(w.text[hit], minlength=len(block.texts))
        return (hits >= TOXIC_WORDS) & (TOXIC_PART * hits >= w.counts)


BASE = (
    Rule("few_words", ("n_words",), lambda n: n < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 30 * n),
)
RULES = (
    *BASE,
    Rule("symbols", ("n_words", "n_symbols"), lambda n, s: 10 * s > n),
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 3 * n) | (c > 10 * n)),
    Rule("equal_lines", ("n_lines", "n_dup_lines"), lambda n, d: 100 * d > 40 * n),
    Rule("few_distinct", ("n_words", "n_distinct"), lambda n, d: 100 * d < 20 * n),
)
CONTRACT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def toxic_rule(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> ToxicRule:
    """The rule that `labels` (doc_id, toxic 0 or 1) teach on the texts of `docs`.

    Stems are counted by Spark. At most MARKED_PART times the stems of a toxic text, on average,
    can be marked, and only their hashes come to the driver.
    """
    judged = labels.select(labels["doc_id"].cast("bigint").alias("id"),
                           labels["toxic"].cast("int").alias("toxic")).dropna()
    judged = stored(judged.groupBy("id").agg(F.max("toxic").alias("toxic"))
                    .orderBy(F.md5(F.col("id").cast("string")), "id").limit(labelled), "judged")
    total = judged.agg(F.coalesce(F.sum("toxic"), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = Words(batch.column("text"), NOT_ALNUM, lower=True)
            hashes = stems(w)
            for text, (id_, toxic) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "toxic")))):
                low, high = w.first[text], w.first[text + 1]
                found = np.unique(np.concatenate([h[low:high] for h in hashes])) if high > low else ()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), id_, np.int64)),
                     pa.array(np.full(len(found), toxic, np.int32)),
                     pa.array(np.asarray(found, np.uint64).view(np.int64))], names=["id", "toxic", "stem"])

    texts = documents(docs).join(F.broadcast(judged), F.col("doc_id") == F.col("id"))
    rows = texts.select("id", "toxic", "text").mapInArrow(run, "id bigint, toxic int, stem bigint")
    counts = rows.distinct().groupBy("stem").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    marked = counts.filter(
        (F.col("bad") >= MARKED_TEXTS) & (MARKED_PART * F.col("bad") >= total)
        & (F.col("bad") >= MARKED_RATIO * F.col("good"))).select("stem").toArrow()
    found = np.asarray(marked.column("stem").combine_chunks(), np.int64)
    return ToxicRule(np.sort(found.view(np.uint64)))


def learnt(docs: DataFrame, labels: DataFrame) -> list[Rule | ToxicRule]:
    """RULES and the toxic rule, in the order that `plan` finds."""
    return plan(docs, [*RULES, toxic_rule(docs, labels)])


def cascade(block: Block, rules: Sequence[Rule]) -> np.ndarray:
    """True for the texts that no rule rejects; each rule sees only what is left before it."""
    kept = np.zeros(len(block.texts), bool)
    left = np.arange(len(block.texts))
    for rule in rules:
        passed = np.flatnonzero(~rule.apply(block))
        block, left = block.take(passed), left[passed]
        if not len(left):
            break
    kept[left] = True
    return kept


def plan(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS,
         fraction: float = 0.05, seed: int = 7) -> list[Rule]:
    """The rules, most rejections per second first, as a sample of at most `sample_rows` texts of
    SAMPLE_BYTES at most shows them. On an empty sample they keep the order given."""
    sample = docs.select("text").sample(fraction=fraction, seed=seed).filter(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= SAMPLE_BYTES).limit(sample_rows)
    texts = sample.toArrow().column("text").combine_chunks()
    return order(Block(texts), rules)


def order(block: Block, rules: Sequence[Rule]) -> list[Rule]:
    """Greedy order: each next rule has the best ratio on what the ones before it leave.

    The texts are tried in parts of TRIAL_TEXTS, and of a trial only measures and verdicts are kept,
    so that the driver never holds the words of more than one part.
    """
    left, ordered = list(rules), []
    parts = [block.take(np.arange(low, min(low + TRIAL_TEXTS, len(block.texts))))
             for low in range(0, len(block.texts), TRIAL_TEXTS)]
    while left and parts:
        rated = [_trial(rule, parts) for rule in left]
        best = max(range(len(rated)), key=lambda i: rated[i][0])
        ordered.append(left.pop(best))
        parts = [part for part in rated[best][1] if len(part.texts)]
    return ordered + left


def _trial(rule: Rule, parts: Sequence[Block]) -> tuple[float, list[Block]]:
    """Rejections of a rule per second, and the parts without the texts that it rejects."""
    rejected, seconds, passed = 0, 0.0, []
    for part in parts:
        trial = Block(part.texts, dict(part.measures))
        began = time.perf_counter()
        bad = rule.apply(trial)
        seconds += time.perf_counter() - began
        rejected += bad.sum()
        passed.append(Block(trial.texts, trial.measures).take(np.flatnonzero(~bad)))
    return rejected / max(seconds, 1e-9), passed


def filter_documents(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text no rule rejects."""
    ordered = plan(docs) if rules is None else list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            yield batch.filter(pa.array(cascade(Block(batch.column("text")), ordered)))

    return docs.mapInArrow(run, docs.schema)


def assess(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Every row's id, contract measures, base verdict and the cascade's verdict."""
    docs = documents(docs)
    ordered = plan(docs) if rules is None else list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            block = Block(batch.column("text"))
            found = [np.asarray(block.measure(n), np.int64) for n in CONTRACT]
            failed = BASE[0].apply(block) | BASE[1].apply(block)
            kept = cascade(block, ordered) & ~failed
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, found), pa.array(failed), pa.array(kept)],
                names=["doc_id", *CONTRACT, "base_failed", "kept"])

    fields = ", ".join(f"{n} bigint" for n in ("doc_id", *CONTRACT))
    return docs.mapInArrow(run, f"{fields}, base_failed boolean, kept boolean")



def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return assess(docs, learnt(docs, read(spark, sf_dir, "labels")))


_WORD = r"[^\x20\x09-\x0D]"
_NOT_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ORACLE_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, doc_id, text, regexp_extract_all(text, '{_WORD}+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls,
             regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '{_NOT_ALNUM}') AS lower FROM t),
judged AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL
           GROUP BY doc_id ORDER BY md5(cast(doc_id AS varchar)), doc_id LIMIT {LABELLED}),
stems AS (SELECT row, doc_id, i, left(lower[i], n) AS stem
          FROM w, unnest(range(1, len(lower) + 1)) AS u(i), (VALUES ({STEMS[0]}), ({STEMS[1]})) AS v(n)),
marked AS (SELECT stem FROM (SELECT DISTINCT doc_id, stem, toxic FROM stems JOIN judged USING (doc_id))
           GROUP BY stem HAVING sum(toxic) >= {MARKED_TEXTS}
           AND {MARKED_PART} * sum(toxic) >= (SELECT sum(toxic) FROM judged)
           AND sum(toxic) >= {MARKED_RATIO} * (count(*) - sum(toxic))),
hits AS (SELECT row, count(DISTINCT i) AS hits FROM stems JOIN marked USING (stem) GROUP BY row),
runs AS (SELECT row, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS run
         FROM w, unnest(range(1, len(ws) - {WINDOW - 2})) AS u(i)),
again AS (SELECT row, run FROM runs GROUP BY row, run HAVING count(*) > 1),
covered AS (SELECT row, count(DISTINCT i + o) AS n
            FROM runs JOIN again USING (row, run), range({WINDOW}) AS r(o) GROUP BY row),
m AS (SELECT w.row, doc_id, len(ws) AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct,
             coalesce(hits, 0) AS hits, len(lower) AS n_lower
      FROM w LEFT JOIN covered USING (row) LEFT JOIN hits USING (row)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, cast(word_chars AS bigint) AS word_chars, n_symbols, n_dup_lines,
       n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words
            OR word_chars > 10 * n_words OR 100 * n_dup_lines > 40 * n_lines
            OR 100 * n_distinct < 20 * n_words 
            OR (hits >= {TOXIC_WORDS} AND {TOXIC_PART} * hits >= n_lower)) AS kept
FROM b
"""
