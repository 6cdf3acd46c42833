"""Fill-in-middle, packing and hard negatives against plain versions, with the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinefold.llm import fill_in_middle as fim
from cinefold.llm import hard_negatives as mining
from cinefold.llm import packing
from helpers import odd_documents

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts_for_cuts():
    texts = [t for _, t, *_ in odd_documents()]
    texts += ["<P>", "a<S", "S><M", "<", ">", "<<P", "P><P", "é" * 40 + "ab" + "\U0001f600" * 9, "\0\n\r a",
              "aB" * 50_000 + "." * 50_000, "abc def " * 3, "Z"]
    return texts * 3


def test_skip_lists_find_every_rank():
    texts = ["", "abc", "a1b2", "éx\U0001f600yz!", "word " * 700, "....", "x" * 500]
    lists = fim.SkipLists(pa.array(texts), lane_bits=1)
    assert len(lists.lanes) > 4
    for t, text in enumerate(texts):
        units = UNITS.findall(text)
        assert lists.count[t] == len(units)
        ranks = np.arange(len(units) + 1)
        found = lists.cut(np.full(len(ranks), t), ranks)
        assert found.tolist() == np.cumsum([0, *map(len, units)]).tolist()
    with pytest.raises(ValueError):
        lists.cut(np.array([1]), np.array([2]))


def test_lanes_carry_the_widths_of_the_lane_below():
    lists = fim.SkipLists(pa.array(["ab c d-e " * 300, "x", "ééé"]), lane_bits=1)
    for lane in lists.lanes:
        ends = np.append(lane.heads[1:], len(lane.units))
        for t, (a, b) in enumerate(zip(lane.heads, ends)):
            # All links but the last, which reaches beyond the text.
            assert lane.units[a:b - 1].sum() <= lists.count[t]
            assert lane.units[b - 1] > lists.count[t]


def test_fill_in_middle(spark):
    rows = list(enumerate(odd_texts_for_cuts())) + [(None, "no id here"), (None, None), (-4, "minus four")]
    docs = spark.createDataFrame([(t, i, "x", "y") for i, t in rows],
                                 "text string, doc_id bigint, output string, form string").repartition(3)
    made = fim.fill_in_middle(docs).withColumn("again", fim.restored())
    found = Counter(tuple(r)[:6] for r in made.drop("again").collect())
    assert found == Counter((i, *plain_fim(i, t)) for i, t in rows)
    assert Counter((r.doc_id, r.again) for r in made.collect()) == Counter((i, t or "") for i, t in rows)
    forms = {f for _, _, f, *_ in found}
    assert forms == {"plain", "psm", "spm"}


def test_fill_in_middle_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.fill_in_middle(none).count() == 0


def test_binary_pieces():
    sizes = np.array([1, 5000, 4096, 8191, 3])
    document, start, length = packing.binary_pieces(sizes)
    for d, n in enumerate(sizes):
        own = document == d
        assert length[own].sum() == n
        assert start[own].tolist() == (np.cumsum(length[own]) - length[own]).tolist()
        rest = [x for x in length[own] if x < 4096]
        assert len(set(rest)) == len(rest) and all(x & (x - 1) == 0 for x in length[own])


def test_tokens_are_the_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.TOKENIZER_FILE)
    draw = random.Random(3)
    letters = ["a", "B", "'s", "́", "é", "<|endoftext|>", "Σ", "İ", "1", "日", "!", "\x1c", "\x85",
               "\xa0", " ", " ", "\t", "\x0b", "\x0c", "\r\n", "'LL", "ﬁ", "ᄀ", "ᅡ", "\0", "q" * 300,
               "É", "ñ", "½", "²", "ª", "\xad", "Ǆ", "Ÿ", "'", "#1", "<|", "|>", "ŉ", "ß", "Æ", "\x7f", "~"]
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 9))) for _ in range(9000)]
    tokens = packing.Tokens(packing.TOKENIZER_FILE)
    for part in (texts[:1000], texts[1000:], texts):
        ids, sizes = tokens.encode(pa.array(part), 2)
        ends = np.cumsum(sizes)
        for text, a, b in zip(part, ends - sizes, ends):
            assert ids[a:b].tolist() == whole.encode(text, add_special_tokens=False).ids + [2]


def test_tokens_are_forgotten_and_learnt_again(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 3)
    tokens = packing.Tokens(packing.TOKENIZER_FILE)
    first = tokens.encode(pa.array(["one two three four five", None]), 2)
    second = tokens.encode(pa.array(["one two three four five", None]), 2)
    assert first[0].tolist() == second[0].tolist() and first[1].tolist() == [6, 1]


def check_packed(spark, docs, rows, longest):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.TOKENIZER_FILE)
    made = packing.pack_documents(docs, longest, chunk_pieces=7).collect()
    assert len({r.sequence_id for r in made}) == len(made)
    places = defaultdict(list)
    for r in made:
        assert r.offset == 0 and r.length == r.bucket <= longest and r.length & (r.length - 1) == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        places[r.bucket].append(r.place)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())
    wanted = Counter()
    for i, t in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        _, start, length = packing.binary_pieces(np.array([len(ids)]), longest)
        for a, n in zip(start.tolist(), length.tolist()):
            wanted[i, a, n, len(ids), tuple(ids[a:a + n])] += 1
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens, tuple(r.ids)) for r in made) == wanted
    return made


@pytest.mark.parametrize("longest", [1, 64, 4096])
def test_packing(spark, odd, longest):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    made = check_packed(spark, odd, rows, longest)
    again = packing.pack_documents(odd.repartition(2), longest, chunk_pieces=7).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


def test_packing_odd_tables(spark, nobody, unnamed):
    assert packing.pack_documents(nobody).count() == 0
    check_packed(spark, unnamed, [(r.doc_id, r.text) for r in unnamed.collect()], 4096)
    with pytest.raises(ValueError):
        packing.cut_documents(nobody, longest=100)


def test_strassen_is_exact():
    draw = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (17, 64, 33), (70, 65, 131), (256, 64, 100), (5, 200, 7)):
        a, b = draw.integers(-2**20, 2**20, (m, k)), draw.integers(-2**20, 2**20, (k, n))
        assert np.array_equal(mining.strassen(a, b, leaf=4), a @ b)


def test_heaps_merge_in_any_order():
    draw = np.random.default_rng(2)
    owner, scores = draw.integers(0, 5, 400), draw.integers(-6, 6, 400)
    ids = draw.permutation(400)
    wanted = [sorted((-s, i) for o, s, i in zip(owner, scores, ids) if o == k)[:5] for k in range(5)]
    for cuts in ((400,), (3, 50, 51, 400), (200, 400)):
        parts, low = [], 0
        for high in cuts:
            part = mining.Heaps(5, 5)
            part.push(owner[low:high], scores[low:high], ids[low:high])
            parts.append(mining.Heaps.unpack(part.pack(), 5, 5))
            low = high
        whole = parts.pop()
        for part in parts:
            whole.merge(part)
        assert [[(-s, i) for s, i in zip(*x)] for x in zip(whole.scores, whole.ids)] == wanted


def plain_negatives(rows, every, positives=5, negatives=5, low=80, scale=256):
    good = [(i, label, np.floor(scale * np.array(v, float)).astype(int)) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(
                x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for *_, v in good), default=0)
    good = [(i, label, np.pad(v, (0, width - len(v)))) for i, label, v in good]
    out = []
    for i, label, v in good:
        if i % every:
            continue
        scored = sorted((-int(v @ w), j, k) for j, k, w in good)
        for p, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            window = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= 100 * -p]
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(window[:negatives])]
    return Counter(out)


def vectors(seed, count, width=13, labels=4):
    draw = np.random.default_rng(seed)
    rows = [(i, int(draw.integers(0, labels)), [float(x) for x in draw.normal(0.2, 0.3, width)])
            for i in range(count)]
    # A third of all rows are one vector, under all labels.
    return [(i, label, rows[0][2] if i % 3 == 0 else v) for i, label, v in rows]


def test_hard_negatives(spark):
    rows = vectors(4, 700)
    rows += [(None, 1, rows[5][2]), (800, None, rows[5][2]), (801, 1, None), (802, 1, [None] * 13),
             (803, 1, [float("nan")] * 13), (804, 1, [float("inf")] + [0.0] * 12), (810, 1, [0.5, 0.5]),
             (820, 2, []), (-10, 2, rows[7][2]), (30, 3, rows[8][2]), (40, rows[40][1], rows[40][2]),
             (900, 77, rows[6][2])]
    table = spark.createDataFrame([(i, label, v, "x", 1) for i, label, v in rows],
                                  "vec_id bigint, label int, embedding array<double>, tile string, part int")
    for cells in ({}, {"cell_anchors": 20, "cell_candidates": 60}):
        made = mining.hard_negatives(table.repartition(5), F.col("vec_id") % 10 == 0, **cells)
        assert Counter(map(tuple, made.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_merge_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(mining, "FAN", 2)
    monkeypatch.setattr(mining, "ANCHOR_TILE", 3)
    monkeypatch.setattr(mining, "CANDIDATE_TILE", 16)
    rows = vectors(5, 200)
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(4)
    made = mining.hard_negatives(table, F.col("vec_id") % 10 == 0, cell_anchors=6, cell_candidates=30)
    assert Counter(map(tuple, made.collect())) == plain_negatives(rows, 10)


def test_hard_negatives_of_nothing_and_of_large_numbers(spark):
    schema = "vec_id bigint, label int, embedding array<double>"
    anchor = F.col("vec_id") % 10 == 0
    assert mining.hard_negatives(spark.createDataFrame([], schema), anchor).count() == 0
    assert mining.hard_negatives(spark.createDataFrame([(10, 1, [1.0])], schema), anchor).count() == 0
    large = [(0, 1, [1e7, 0.0]), (1, 1, [1e7, 0.0]), (2, 2, [9e6, 1e5]), (3, 2, [1e6, 0.0])]
    made = mining.hard_negatives(spark.createDataFrame(large, schema), anchor).collect()
    assert [(r.positive_id, r.negative_id, r.negative_score) for r in made] == [
        (1, 2, 256 * 10**7 * 256 * 9 * 10**6)]
    with pytest.raises(Exception, match="does not fit"):
        mining.hard_negatives(spark.createDataFrame([(0, 1, [1e20])], schema), anchor).collect()
