"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together in another order.

A text is a sequence of units, runs of ASCII letters or single other characters, matched from left
to right. Two ranks among its units cut it. To get from a rank to a place in the text, an indexable
skip list stands over the units: every place between two units is a node, random nodes stand on
express lanes too, and each link of a lane carries its width in units and in code points. A search
starts at the head of the text on the highest lane, goes on as long as the next link does not reach
beyond the rank, and goes down a lane otherwise; the widths it has passed add up to the rank itself
and to the code points before it. All texts of a block share the arrays of a lane, and all their
searches descend together.

What a text gets depends on its id and itself alone, so tasks may run again. A null text is empty; a
null id counts as the empty string where ids are hashed. A text that is empty, or that contains one
of the marks, stays as it is (`plain`), and so does a share of all others. Rows that repeat an id or
a whole row are rows of their own; an empty table gives no rows; other columns are not read. Long
texts are cut whole, and memory follows the longest single text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.llm.tables import documents, read
from cinefold.llm.words import blocks, mix, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
# Hundredths of all texts that stay plain, and of the others that get the suffix first.
PLAIN_PCT, SPM_PCT = 10, 20
# A node stands on the next lane too with chance 1 / 2 ** LANE_BITS.
LANE_BITS = 3
_END = np.iinfo(np.int64).max // 2
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass
class Lane:
    """The nodes of all texts on one lane, text after text. A node's link reaches to the next node
    of its text; the link of the last one reaches beyond any rank."""

    units: np.ndarray  # width of the link in units
    chars: np.ndarray  # and in code points
    down: np.ndarray  # the same node on the lane below
    heads: np.ndarray  # the node before the first unit of each text


class SkipLists:
    """One indexable skip list per text: `count` has the units of each, `cut` finds places."""

    def __init__(self, texts: pa.Array, lane_bits: int = LANE_BITS):
        offsets, data = text_bytes(texts)
        head = (data & 0xC0) != 0x80
        letter = _LETTER[data]
        begins = head.copy()
        begins[1:] &= ~(letter[1:] & letter[:-1])
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[starts] = True
        at = np.flatnonzero(begins)
        chars_before = np.cumsum(head) - head
        first = np.searchsorted(at, offsets)
        self.count = np.diff(first)
        # A node before each unit and one after the last: text t has count[t] + 1 of them.
        nodes = self.count + 1
        heads = np.cumsum(nodes) - nodes
        total = int(nodes.sum())
        rank = np.arange(total) - np.repeat(heads, nodes)
        last = heads + self.count
        place = np.empty(total, np.int64)
        inner = np.ones(total, bool)
        inner[last] = False
        place[inner] = chars_before[at]
        ends = np.append(chars_before, head.sum())
        place[last] = ends[offsets[1:]]
        units, chars = np.ones(total, np.int64), np.diff(place, append=0)
        units[last] = chars[last] = _END
        self.lanes = [Lane(units, chars, np.arange(total), heads)]
        height = self._heights(rank, lane_bits)
        keep = np.flatnonzero((height >= 1) | (rank == 0))
        while len(keep) < len(self.lanes[-1].units) and len(keep) > len(nodes):
            self.lanes.append(self._above(self.lanes[-1], keep))
            rank, height = rank[keep], height[keep]
            keep = np.flatnonzero((height >= len(self.lanes)) | (rank == 0))

    @staticmethod
    def _heights(rank: np.ndarray, lane_bits: int) -> np.ndarray:
        """How many lanes above the lowest a node stands on: geometric, from its rank."""
        draw = mix(rank.astype(np.uint64) + np.uint64(1))
        low = draw & (~draw + np.uint64(1))
        zeros = np.where(draw == 0, 64, np.log2(np.maximum(low, 1).astype(np.float64)))
        return zeros.astype(np.int64) // lane_bits

    @staticmethod
    def _above(lane: Lane, keep: np.ndarray) -> Lane:
        """The lane of the kept nodes: the widths between two of them add up. The link beyond the
        end is left out of the sums and put back on each text's last node."""
        open_ = lane.units < _END
        units = np.add.reduceat(np.where(open_, lane.units, 0), keep)
        chars = np.add.reduceat(np.where(open_, lane.chars, 0), keep)
        heads = np.searchsorted(keep, lane.heads)
        last = np.append(heads[1:], len(keep)) - 1
        units[last] = chars[last] = _END
        return Lane(units, chars, keep, heads)

    def cut(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Code points before the unit of that rank in that text, for many searches at once."""
        units, chars = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
        at = self.lanes[-1].heads[text]
        for lane in reversed(self.lanes):
            todo = np.arange(len(text))
            while len(todo):
                width = lane.units[at[todo]]
                ahead = units[todo] + width <= rank[todo]
                todo, width = todo[ahead], width[ahead]
                units[todo] += width
                chars[todo] += lane.chars[at[todo]]
                at[todo] += 1
            at = lane.down[at]
        if not np.array_equal(units, rank):
            raise ValueError("a rank beyond the units of its text")
        return chars


def draws(ids: list[int | None], seed: str = SEED) -> np.ndarray:
    """Four 32-bit numbers per id, from a digest of the seed and the id."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, seed: str = SEED, plain_pct: int = PLAIN_PCT,
                   spm_pct: int = SPM_PCT, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if
    plain), and output, the text in its new order with the marks."""
    rows = documents(docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            texts = pc.fill_null(batch.column("text"), "")
            lists, h = SkipLists(texts), draws(batch.column("doc_id").to_pylist(), seed)
            every = np.arange(len(texts))
            ranks = h[:, :2] % (lists.count + 1)[:, None]
            low = lists.cut(every, ranks.min(axis=1)).tolist()
            high = lists.cut(every, ranks.max(axis=1)).tolist()
            marked = pc.match_substring_regex(texts, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
            plain = ((lists.count == 0) | np.asarray(marked) | (h[:, 2] % 100 >= 100 - plain_pct))
            form = np.where(plain, "plain", np.where(h[:, 3] % 100 < spm_pct, "spm", "psm")).tolist()
            out = [assemble(t, f, a, b) for t, f, a, b in zip(texts.to_pylist(), form, low, high)]
            width = np.array(high, np.int64) - np.array(low, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lists.count), pa.array(form, pa.string()),
                 pa.array(np.array(low, np.int64), mask=plain), pa.array(width, mask=plain),
                 pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, "
                                "middle_chars bigint, output string")


def assemble(text: str, form: str, low: int, high: int) -> str:
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form == "psm":
        return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return text


def restored(output: str = "output", form: str = "form") -> F.Column:
    """The text that `output` was made from. A text with marks in it is plain, and no mark can
    begin inside another, so each mark is found once."""
    part = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(F.col(form) == "psm", F.concat(part[1], part[3], part[2]))
            .when(F.col(form) == "spm", F.concat(part[2], part[3], part[1]))
            .otherwise(F.col(output)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(read(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       digest(F.col("output")).alias("output_sha256"),
                       digest(restored()).alias("restored_sha256"))


_DRAW = "cast(concat('0x', substr(digest, {}, 8)) as bigint)"
ORACLE_SQL = f"""
with given as (
  select doc_id, coalesce(text, '') as text,
         sha256(concat('1:', coalesce(cast(doc_id as varchar), ''))) as digest from documents),
cut as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units,
         {_DRAW.format(1)} as h1, {_DRAW.format(9)} as h2,
         {_DRAW.format(17)} as h3, {_DRAW.format(25)} as h4 from given),
ranks as (
  select *, cast(len(units) as bigint) as n,
         least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a,
         greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
         case when text = '' or regexp_matches(text, '<P>|<S>|<M>') or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form from cut),
parts as (
  select *, array_to_string(units[1:a], '') as p, array_to_string(units[a + 1:b], '') as m,
         array_to_string(units[b + 1:], '') as s from ranks)
select doc_id, n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'psm' then concat('<P>', p, '<S>', s, '<M>', m)
                        when 'spm' then concat('<S>', s, '<P>', p, '<M>', m)
                        else text end) as output_sha256,
       sha256(text) as restored_sha256
from parts"""
