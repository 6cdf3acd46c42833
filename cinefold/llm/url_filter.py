"""URL rules by Bloom filter cascades.

Every key that a url could match, a host suffix with a prefix of the path as long as some rule's,
is looked up in cascades. The first level of a cascade encodes the listed keys; the second those
other keys of the corpus that the first lets through by mistake, the third the listed ones that
the second lets through, and so on until a level makes no mistake. As the levels are built on the
complete set of the corpus's keys, membership is exact for each of them, and no url is joined.

The first level's error rate follows the ratio of listed to all keys, so the second and later
levels hold about as many keys as are listed, and all levels together take about
1.44 * n * log2(keys / n) bits for n listed keys. Lists of more than `MAX_LISTED` keys are refused,
which bounds what is broadcast (under 16 MB for 10 ** 18 keys).

A url without `://`, or a null one, has an empty host and path and matches nothing. Of the rules
that fit, the one with most characters wins, and of equal ones the longer host.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import read
from cinefold.llm.words import mix

MAX_LISTED = 1_000_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ALLOW = ("com/", "www.example.com/en/")
BLOCK = ("example.com/en/", "net/es/", "net/fr/")
# Hosts blocked, with all below them, where no rule fits.
LISTED_HOSTS = tuple(
    f"{name}.example.{end}"
    for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    for end in ("com", "net", "org"))


@dataclass
class Level:
    salt: int
    probes: int
    size: int
    words: np.ndarray

    def bits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The places of each key, a row for each probe."""
        step = np.arange(self.probes, dtype=np.uint64)[:, None]
        turn = mix(np.uint64([self.salt * 64]) + step)
        return mix((first + second * turn) ^ turn) % np.uint64(self.size)

    def holds(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        at = self.bits(first, second)
        return ((self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=0)


class Cascade:
    """Exact membership for the keys it was built on, given as two hashes each."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), bool)
        left = np.arange(len(first))
        for i, level in enumerate(self.levels):
            held = level.holds(first[left], second[left])
            out[left[~held]] = i % 2 == 1
            left = left[held]
        out[left] = len(self.levels) % 2 == 1
        return out


def _hashes(key: F.Column) -> list[F.Column]:
    return [F.xxhash64(key).alias("first"), F.xxhash64(F.concat(F.lit("#"), key)).alias("second")]


def _pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.asarray(batch.column(c)).view(np.uint64) for c in ("first", "second"))


def _level(keys: DataFrame, count: int, error: float, salt: int) -> Level:
    size = max(64, math.ceil(count * math.log2(1 / error) / math.log(2)))
    level = Level(salt, max(1, round(math.log2(1 / error))), size, np.zeros(size // 64 + 1, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(level.bits(*_pair(batch)))
            words, first = np.unique(at >> np.uint64(6), return_index=True)
            masks = (np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                     if len(at) else at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.astype(np.int64)), pa.array(masks.view(np.int64))],
                names=["word", "mask"])

    rows = keys.mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(
        F.bit_or("mask").alias("mask")).toArrow()
    level.words[np.asarray(rows.column("word"))] = np.asarray(rows.column("mask")).view(np.uint64)
    return level


def _passing(keys: DataFrame, level: Level) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(level.holds(*_pair(batch))))

    return keys.mapInArrow(run, keys.schema)


def build(universe: DataFrame, size: int, listed: Sequence[str]) -> Cascade:
    """A cascade for `listed` on `universe`, `size` distinct keys as (key, first, second)."""
    if len(set(listed)) > MAX_LISTED:
        raise ValueError(f"more than {MAX_LISTED} listed keys")
    spark = universe.sparkSession
    table = F.broadcast(spark.createDataFrame([(x,) for x in set(listed)], "key string"))
    encode = universe.join(table, "key", "left_semi").checkpoint()
    other = universe.join(table, "key", "left_anti")
    count, levels = encode.count(), []
    error = min(0.5, math.sqrt(0.5) * max(count, 1) / max(size - count, 1))
    while count:
        levels.append(_level(encode, count, error, len(levels)))
        wrong = _passing(other, levels[-1]).checkpoint()
        encode, other, count, error = wrong, encode, wrong.count(), 0.5
        if len(levels) > 200:
            raise RuntimeError("keys of equal hashes are listed and not listed")
    return Cascade(levels)


def addresses(pages: DataFrame, lists: Sequence[str]) -> DataFrame:
    """page_id, host, path and `keys`, all keys that could be in one of the lists."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rows = pages.select(pages["page_id"].cast("bigint").alias("page_id"),
                        pages["url"].cast("string").alias("url")).withColumn("rest", rest)
    rows = rows.withColumn("name", F.regexp_extract("rest", "^[^/?#]*", 0))
    rows = rows.withColumn("path", F.regexp_extract(
        F.expr("substring(rest, char_length(name) + 1)"), "^[^?#]*", 0))
    rows = rows.withColumn("host", F.translate("name", CAPITALS, SMALL))
    # No key has more labels or another length of path than some listed one.
    hosts = max((x.split("/", 1)[0].count(".") + 1 for x in lists), default=1)
    cuts = sorted({len(x) - len(x.split("/", 1)[0]) for x in lists})
    tails = F.array_compact(F.array(*(
        F.when(F.size("labels") >= n, F.concat_ws(".", F.slice("labels", -n, n)))
        for n in range(1, hosts + 1))))
    heads = F.array_compact(F.array(*(
        F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in cuts)))
    keys = F.flatten(F.transform("tails", lambda t: F.transform("heads", lambda h: F.concat(t, h))))
    return (
        rows.withColumn("labels", F.split(F.substring_index("host", ".", -hosts - 1), r"\."))
        .withColumns({"tails": tails, "heads": heads})
        .select("page_id", "host", "path", F.when(F.col("host") == "", F.array().cast("array<string>"))
                .otherwise(keys).alias("keys"))
    )


def judge(pages: DataFrame, allow: Sequence[str] = ALLOW, block: Sequence[str] = BLOCK,
          listed: Sequence[str] = LISTED_HOSTS) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, and whether the host is listed."""
    lists = [*allow, *block, *listed]
    rows = addresses(pages, lists)
    universe = rows.select(F.explode("keys").alias("key")).distinct().select(
        "key", *_hashes(F.col("key"))).checkpoint()
    size = universe.count()
    cascades = rows.sparkSession.sparkContext.broadcast(
        [build(universe, size, x) for x in (allow, block, listed)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (np.asarray(batch.column(c).flatten()).view(np.uint64)
                             for c in ("first", "second"))
            row = np.repeat(np.arange(batch.num_rows),
                            np.asarray(batch.column("keys").value_lengths()))
            allowed, blocked, hosts = (c.listed(first, second) for c in cascades.value)
            bad = np.zeros(batch.num_rows, bool)
            bad[row[hosts]] = True
            best: dict[int, tuple] = {}
            hit = np.flatnonzero(allowed | blocked)
            keys = batch.column("keys").flatten().take(pa.array(hit)).to_pylist()
            for r, key, ok in zip(row[hit].tolist(), keys, allowed[hit].tolist()):
                found = (len(key), len(key.split("/", 1)[0]), key, "allow" if ok else "block")
                best[r] = max(best.get(r, found), found)
            verdicts = np.where(bad, "block", "allow").tolist()
            rules: list[str | None] = [None] * batch.num_rows
            for r, (_, _, key, verdict) in best.items():
                rules[r], verdicts[r] = key, verdict
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("host"), batch.column("path"),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(bad)],
                names=["page_id", "host", "path", "rule", "verdict", "listed"])

    hashed = rows.withColumns({
        "first": F.transform("keys", lambda k: F.xxhash64(k)),
        "second": F.transform("keys", lambda k: F.xxhash64(F.concat(F.lit("#"), k)))})
    return hashed.mapInArrow(run, "page_id bigint, host string, path string, rule string, "
                                  "verdict string, listed boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


_RULES = ", ".join(f"('{x.split('/', 1)[0]}', '/{x.split('/', 1)[1]}', '{v}')"
                   for v, rules in (("allow", ALLOW), ("block", BLOCK)) for x in rules)
_HOSTS = ", ".join(f"('{x}')" for x in LISTED_HOSTS)
ORACLE_SQL = f"""
WITH rules(rhost, rpath, verdict) AS (VALUES {_RULES}), bad(bhost) AS (VALUES {_HOSTS}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
      FROM pages),
n AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS name FROM r),
a AS (SELECT page_id, translate(name, '{CAPITALS}', '{SMALL}') AS host,
             regexp_extract(substr(rest, length(name) + 1), '^[^?#]*') AS path FROM n),
f AS (SELECT page_id, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS place
      FROM a JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
l AS (SELECT DISTINCT page_id FROM a JOIN bad
      ON host = bhost OR ends_with(host, '.' || bhost))
SELECT a.page_id, a.host, a.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       l.page_id IS NOT NULL AS listed
FROM a LEFT JOIN f ON f.page_id = a.page_id AND f.place = 1 LEFT JOIN l ON l.page_id = a.page_id
"""
