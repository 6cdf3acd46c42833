"""Removal of passages that an earlier document holds, by suffix automata of reference shards.

A window is `window` consecutive words. Every window belongs to one shard: that of its minimizer,
the smallest hash among its runs of `SEED_WORDS` words, which equal windows have in common. A
maximal run of neighbouring windows with one minimizer is a piece of text. The reference of a
shard is the distinct pieces of all documents that belong there; a suffix automaton of them, which
knows the smallest document of every word sequence, is met by the same pieces as they stream
through it: where the matching statistic reaches `window`, the automaton names the first document
with that window, and the word span is removed where this document is smaller than the piece's
own. Spans that overlap or touch are one maximal span.

Only what can repeat gets that far. Copies of a whole text are settled by a digest, and a
minimizer counts only if different texts have it. The reference grows with the corpus and so has
no bound that would let it be broadcast whole: each shard goes to its pieces by their common key
instead. A shard with more than `SHARD_PIECES` distinct pieces is split further: its pieces are
cut again by the minimizers of another hash, up to `LEVELS` times, and what is still too large goes
window by window, each by its own 128-bit digest and its smallest document.

Windows are judged on the input, words as they are. Null or empty texts have no words. Rows with a
null id are never judged and never a reference; rows that share an id do not count as earlier than
each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.automaton import SuffixAutomaton
from cinefold.llm.tables import documents, maybe_in, read, stored
from cinefold.llm.words import Words, blocks, mix

WINDOW_WORDS = 50
SEED_WORDS = 18
SHARD_PIECES = 512
LEVELS = 3
# Pieces that one task's share of the shards holds, about.
TASK_PIECES = 20_000


def _minimizers(w: Words, window: int, seed: int,
                level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all whole windows, and place and hash of each one's minimizer."""
    starts = np.flatnonzero(w.runs(window))
    seeds = w.run_hashes(seed)
    if level:
        seeds = mix(seeds ^ np.uint64(level))
    if not len(starts):
        return starts, starts, seeds[:0]
    view = np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1)
    place = np.empty(len(starts), np.int64)
    for low in range(0, len(starts), 1 << 16):
        part = starts[low:low + (1 << 16)]
        place[low:low + (1 << 16)] = part + view[part].argmin(axis=1)
    return starts, place, seeds[place]


def _keyed(docs: DataFrame) -> DataFrame:
    """With a 128-bit digest of the text, in two columns."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"low": F.xxhash64(text),
                             "high": F.xxhash64(F.concat(F.lit("#"), text))})


def _sha(words: bytes) -> str:
    return hashlib.sha256(words).hexdigest()


def summary(docs: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS) -> DataFrame:
    """Per row: id, number of words, digest of the text, SHA-256 of its words joined by one space,
    and the distinct minimizers of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = Words(batch.column("text"))
            starts, _, keys = _minimizers(w, window, seed)
            text = w.text[starts]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
            text, keys = text[fresh], keys[fresh]
            _, firsts = np.unique(keys ^ mix(text.astype(np.uint64)), return_index=True)
            firsts.sort()
            text, keys = text[firsts], keys[firsts]
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            raw = w.data.tobytes()
            shas = [_sha(b" ".join(raw[a:b].split())) for a, b in zip(
                w.offsets[:-1].tolist(), w.offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts), batch.column("low"),
                 batch.column("high"), pa.array(shas), pa.ListArray.from_arrays(
                     pa.array(bounds.astype(np.int32)), pa.array(keys.view(np.int64)))],
                names=["doc_id", "n_words", "low", "high", "all_sha256", "seeds"])

    return _keyed(docs).mapInArrow(run, "doc_id bigint, n_words bigint, low bigint, high bigint, "
                                "all_sha256 string, seeds array<bigint>")


def _shared_seeds(firsts: DataFrame) -> DataFrame:
    """For each different text with one: the seeds that another text has too."""
    rows = firsts.select("doc_id", "low", F.explode("seeds").alias("seed"))
    shared = rows.groupBy("seed").agg(F.min("low").alias("x"), F.max("low").alias("y")).filter(
        "x <> y").select("seed")
    return rows.join(shared, "seed").groupBy("doc_id", "low").agg(
        F.collect_list("seed").alias("seeds"))


def _cut_pieces(w: Words, window: int, starts: np.ndarray, place: np.ndarray, keys: np.ndarray,
                ) -> tuple[np.ndarray, list[pa.Array], list[bytes]]:
    """Maximal runs of the windows given that share a minimizer: first words, the columns seed,
    low1, low2, start, n (windows), and the texts."""
    head = np.ones(len(starts), bool)
    head[1:] = (place[1:] != place[:-1]) | (np.diff(starts) > 1)
    heads = np.flatnonzero(head)
    n = np.diff(np.append(heads, len(starts)))
    first, stop = starts[heads], starts[heads] + n + window - 1
    raw = w.data.tobytes()
    texts = [b" ".join(raw[a:b].split())
             for a, b in zip(w.starts[first].tolist(), w.ends[stop - 1].tolist())]
    digest = np.frombuffer(b"".join(
        hashlib.blake2b(x, digest_size=16).digest() for x in texts), np.int64)
    return first, [pa.array(x) for x in (
        keys[heads].view(np.int64), digest[0::2], digest[1::2], first - w.first[w.text[first]], n,
    )], texts


def pieces(repeated: DataFrame, window: int, seed: int, texts: bool) -> DataFrame:
    """The pieces with a shared seed: seed, 128-bit digest, first word, number of windows,
    document, and the words if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = Words(batch.column("text"))
            starts, place, keys = _minimizers(w, window, seed)
            shared = batch.column("seeds")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(shared.value_lengths()))
            known = np.asarray(shared.flatten()).view(np.uint64) ^ mix(owner.astype(np.uint64))
            kept = np.isin(keys ^ mix(w.text[starts].astype(np.uint64)), known)
            first, columns, text = _cut_pieces(w, window, starts[kept], place[kept], keys[kept])
            row = pa.array(w.text[first])
            columns += [batch.column("doc_id").take(row), batch.column("low").take(row)]
            names = ["seed", "low1", "low2", "start", "n", "doc_id", "low"]
            if texts:
                columns.append(pa.array(text, pa.binary()))
                names.append("words")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return repeated.select("doc_id", "low", "text", "seeds").mapInArrow(
        run, "seed bigint, low1 bigint, low2 bigint, start bigint, n bigint, doc_id bigint, "
             "low bigint" + (", words binary" if texts else ""))


def _cut_again(large: DataFrame, window: int, seed: int, level: int) -> DataFrame:
    """The pieces of `large`, each cut by the minimizers of another hash; `whole1`, `whole2` is
    the digest of the piece it was part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            w = Words(batch.column("words"))
            first, columns, text = _cut_pieces(w, window, *_minimizers(w, window, seed, level))
            row = pa.array(w.text[first])
            yield pa.RecordBatch.from_arrays(
                [*columns, *(batch.column(c).take(row) for c in ("low1", "low2", "first_id")),
                 pa.array(text, pa.binary())],
                names=["seed", "low1", "low2", "start", "n", "whole1", "whole2", "first_id",
                       "words"])

    return large.select("low1", "low2", "first_id", "words").mapInArrow(
        run, "seed bigint, low1 bigint, low2 bigint, start bigint, n bigint, whole1 bigint, "
             "whole2 bigint, first_id bigint, words binary")


def _first_documents(shard: list[tuple[int, list[bytes]]], window: int) -> list[list[int]]:
    """For each piece of a shard, given as smallest document and words: the first document of each
    of its windows."""
    if len(shard) == 1:
        doc, words = shard[0]
        return [[doc] * (len(words) - window + 1)]
    reference = SuffixAutomaton()
    for doc, words in shard:
        reference.add(words, doc)
    reference.finish()
    return [[least for size, least in reference.matches(words, window) if size == window]
            for _, words in shard]


_DIGEST = ["low1", "low2"]
_SEGMENTS = "segments array<struct<at: bigint, seen: array<bigint>>>"


def _by_automata(distinct: DataFrame, window: int, tasks: int) -> DataFrame:
    """The segments of all pieces, one a piece, by an automaton for each shard."""

    def run(rows: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(rows.column("seed").combine_chunks()), kind="stable")
        rows = rows.take(pa.array(order))
        seeds = np.asarray(rows.column("seed").combine_chunks())
        cuts = [0, *(np.flatnonzero(np.diff(seeds)) + 1).tolist(), len(seeds)]
        docs, words = rows.column("first_id").to_pylist(), rows.column("words")
        seen: list[list[int]] = []
        for low, high in zip(cuts, cuts[1:]):
            seen += _first_documents([(docs[i], words[i].as_py().split(b" "))
                                      for i in range(low, high)], window)
        return rows.select(_DIGEST).append_column("segments", pa.array(
            [[{"at": 0, "seen": x}] for x in seen],
            pa.list_(pa.struct([("at", pa.int64()), ("seen", pa.list_(pa.int64()))]))))

    dealt = distinct.withColumn("task", F.pmod(F.xxhash64("seed"), F.lit(tasks)))
    return dealt.groupBy("task").applyInArrow(run, f"low1 bigint, low2 bigint, {_SEGMENTS}")


def _by_windows(distinct: DataFrame, window: int) -> DataFrame:
    """The same window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            w = Words(batch.column("words"))
            starts = np.flatnonzero(w.runs(window))
            digest = np.frombuffer(b"".join(
                hashlib.blake2b(w.data[a:b].tobytes(), digest_size=16).digest() for a, b in zip(
                    w.starts[starts].tolist(), w.ends[starts + window - 1].tolist())), np.int64)
            row = pa.array(w.text[starts])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(row) for c in ("low1", "low2", "first_id")),
                 pa.array(starts - w.first[w.text[starts]]), pa.array(digest[0::2]),
                 pa.array(digest[1::2])],
                names=["low1", "low2", "first_id", "at", "window1", "window2"])

    rows = distinct.select("low1", "low2", "first_id", "words").mapInArrow(
        run, "low1 bigint, low2 bigint, first_id bigint, at bigint, window1 bigint, "
             "window2 bigint")
    least = rows.groupBy("window1", "window2").agg(F.min("first_id").alias("doc"))
    return rows.join(least, ["window1", "window2"]).groupBy(*_DIGEST).agg(
        F.collect_list(F.struct("at", F.array("doc").alias("seen"))).alias("segments"))


def _first_seen(distinct: DataFrame, window: int, seed: int, shard_pieces: int,
                level: int = 0) -> DataFrame:
    """low1, low2 and `segments` of different pieces given as seed, low1, low2, first_id, words: a
    segment has the first document of each window from window `at` on. Of two segments over one
    window the smaller document holds."""
    if level == LEVELS:
        return _by_windows(distinct, window)
    counts = distinct.groupBy("seed").agg(F.count("*").alias("pieces"))
    total, large = counts.agg(F.coalesce(F.sum("pieces"), F.lit(0)),
                              F.count_if(F.col("pieces") > shard_pieces)).first()
    tasks = 8 * (1 + total // TASK_PIECES)
    if not large:
        return _by_automata(distinct, window, tasks)
    large = counts.filter(F.col("pieces") > shard_pieces).select("seed")
    usual = _by_automata(distinct.join(large, "seed", "left_anti"), window, tasks)
    large = distinct.join(large, "seed", "left_semi")
    parts = stored(_cut_again(large, window, seed, level + 1), "parts")
    # A part whose seed no other piece has is met by nothing else.
    shared = parts.groupBy("seed").agg(F.min("whole1").alias("x"), F.max("whole1").alias("y"))
    parts = parts.join(shared.filter("x <> y").select("seed"), "seed")
    again = stored(parts.groupBy("seed", *_DIGEST).agg(
        F.min("first_id").alias("first_id"), F.max("words").alias("words")), "pieces")
    found = parts.select(*_DIGEST, "start", "whole1", "whole2").join(
        _first_seen(again, window, seed, shard_pieces, level + 1), _DIGEST)
    moved = F.transform("segments", lambda s: F.struct(
        (s["at"] + F.col("start")).alias("at"), s["seen"].alias("seen")))
    found = found.select(F.col("whole1").alias("low1"), F.col("whole2").alias("low2"),
                         moved.alias("segments"))
    n = F.size(F.split(F.col("words").cast("string"), " ")) - window + 1
    own = large.select(*_DIGEST, F.array(F.struct(
        F.lit(0).cast("bigint").alias("at"),
        F.array_repeat("first_id", n).alias("seen"))).alias("segments"))
    found = found.union(own).groupBy(*_DIGEST).agg(
        F.flatten(F.collect_list("segments")).alias("segments"))
    return usual.union(found)


def _spans(repeated: DataFrame, window: int, seed: int, shard_pieces: int) -> DataFrame:
    """Per document: the pieces in which windows are to be removed, and which windows."""
    distinct = stored(
        pieces(repeated, window, seed, texts=True)
        .groupBy("seed", *_DIGEST).agg(F.min("doc_id").alias("first_id"),
                                       F.max("words").alias("words")), "pieces")
    seen = _first_seen(distinct, window, seed, shard_pieces)
    later = F.expr("exists(segments, s -> exists(s.seen, x -> x < doc_id))")
    moved = F.transform("segments", lambda s: F.struct(
        (s["at"] + F.col("start")).alias("start"), s["seen"].alias("seen")))
    return (
        pieces(repeated, window, seed, texts=False).join(seen, _DIGEST).filter(later)
        .groupBy("doc_id", "low").agg(F.flatten(F.collect_list(moved)).alias("spans"))
    )


def _cut(marked: DataFrame, window: int) -> DataFrame:
    """Per document with spans: how many words go, the SHA-256 of the rest, and the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            w = Words(batch.column("text"))
            edge = np.zeros(len(w) + 1, np.int64)
            for i, (doc, spans) in enumerate(zip(batch.column("doc_id").to_pylist(),
                                                 batch.column("spans"))):
                items = spans.values
                seen = items.field("seen")
                n = np.asarray(seen.value_lengths(), np.int64)
                start = np.repeat(np.asarray(items.field("start")) - np.cumsum(n) + n, n)
                at = w.first[i] + start + np.arange(n.sum())
                at = at[np.asarray(seen.flatten()) < doc]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            removed = np.bincount(w.text[gone], minlength=batch.num_rows)
            rest = []
            for i in range(batch.num_rows):
                at = np.flatnonzero(~gone[w.first[i]:w.first[i + 1]]) + w.first[i]
                rest.append(b" ".join(map(w.word, at.tolist())).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("low"), pa.array(removed),
                 pa.array([_sha(x.encode()) for x in rest]), pa.array(rest, pa.string())],
                names=["doc_id", "low", "n_cut", "rest_sha256", "rest"])

    return marked.mapInArrow(run, "doc_id bigint, low bigint, n_cut bigint, rest_sha256 string, "
                                  "rest string")


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, seed: int = SEED_WORDS,
                   shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256, and the kept words in
    `kept_text` where any were removed (else null)."""
    docs = documents(docs)
    rows = stored(summary(docs, window, seed), "summary")
    texts = rows.filter("doc_id IS NOT NULL AND n_words >= %d" % window)
    firsts = texts.groupBy("low", "high").agg(F.min("doc_id").alias("first_id"))
    firsts = stored(firsts, "firsts")
    different = texts.join(firsts.select("low", "high", F.col("first_id").alias("doc_id")),
                           ["low", "high", "doc_id"], "left_semi")
    shared = _shared_seeds(different.dropDuplicates(["low", "high", "doc_id"]))
    shared = stored(shared, "shared")
    texts = maybe_in(docs, "doc_id", shared.select("doc_id")).filter("maybe").drop("maybe")
    repeated = stored(_keyed(texts).join(shared, ["doc_id", "low"]).dropDuplicates(
        ["doc_id", "low"]), "repeated")
    spans = _spans(repeated, window, seed, shard_pieces)
    rest = _cut(repeated.select("doc_id", "low", "text").join(spans, ["doc_id", "low"]), window)
    copied = F.col("first_id") < F.col("doc_id")
    return (
        rows.drop("seeds").join(firsts, ["low", "high"], "left")
        .join(rest, ["doc_id", "low"], "left")
        .select(
            "doc_id", "n_words",
            F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0)))
            .alias("n_removed"),
            F.when(copied, F.lit(_sha(b""))).otherwise(F.coalesce("rest_sha256", "all_sha256"))
            .alias("kept_sha256"),
            F.when(copied, F.lit("")).otherwise(F.col("rest")).alias("kept_text"),
            "low", "high")
    )


def drop_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """`docs` with all its columns and the repeated passages gone from `text`: a changed text is
    its kept words joined by one space, `n_chars`, if there is one, follows it, and documents left
    without a word are dropped."""
    found = remove_repeats(docs, window).filter("n_removed > 0").select(
        "doc_id", "low", "high", "kept_text").distinct()
    found = stored(found, "changed")
    rows = docs.select(F.struct(*docs.columns).alias("row"), docs["text"].alias("text"),
                       docs["doc_id"].cast("bigint").alias("doc_id"))
    rows = maybe_in(rows, "doc_id", found.select("doc_id"))
    same = rows.filter("NOT maybe").select("row.*")
    rows = _keyed(rows.filter("maybe")).join(found, ["doc_id", "low", "high"], "left").filter(
        "kept_text IS NULL OR kept_text <> ''")
    changed = F.col("kept_text").isNotNull()
    row = F.col("row").withField("text", F.coalesce("kept_text", "row.text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        row = row.withField("n_chars", F.when(changed, F.char_length("kept_text").cast(kind))
                            .otherwise(F.col("row.n_chars")))
    return same.union(rows.select(row.alias("row")).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept_text", "low", "high")


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW_WORDS - 1}], ' ')) AS run
            FROM w, unnest(range(1, len(ws) - {WINDOW_WORDS - 2})) AS u(i)),
firsts AS (SELECT run, min(doc_id) AS first_id FROM windows GROUP BY run),
gone AS (SELECT DISTINCT doc_id, i + o AS place FROM windows JOIN firsts USING (run),
         range({WINDOW_WORDS}) AS r(o) WHERE first_id < doc_id),
words AS (SELECT doc_id, place, ws[place] AS word FROM w, unnest(range(1, len(ws) + 1)) AS u(place)),
rest AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS kept
         FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN rest USING (doc_id)
"""
