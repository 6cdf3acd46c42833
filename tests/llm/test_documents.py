"""The operators on documents against plain versions, on a table of odd cases."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import (
    katz as plain_katz,
    licenses,
    mix_targets,
    near_duplicates,
    odd_documents,
    quality as plain_quality,
    say,
    toxic,
    words,
    without_repeats,
)
from support import plan_of

from cinefold.llm import katz, license_scan, minhash_forest, mixing, pieces, quality, substring_dedup
from cinefold.llm.automaton import SuffixAutomaton


def test_quality_measures(odd, odd_texts):
    rows = quality.assess(odd).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert plain_quality(odd_texts[r.doc_id]) == (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
        assert not (r.kept and r.base_failed)
    assert {r.doc_id for r in rows if not r.kept and not r.base_failed} == set()


@pytest.fixture(scope="module")
def judged(spark):
    """Texts in several scripts with their labels: ids up to 19 are toxic, most others not."""
    rude = ["gr\u00e4\u00dflich%d", "odious%d", "\u65e5\u672c\u8a9e\u306e\u60aa\u53e3%d"]
    rows = []
    for i in range(60):
        plain = [f"word{(i * 7 + j * j) % 97}" for j in range(40 + i)]
        if i < 20:
            for k, w in enumerate(rude):
                plain[5 + 3 * k] = w % (i * 10 + k)
        rows.append((i, " ".join(plain)))
    rows += [
        (60, "Odious1 " + " ".join(f"fair{j}" for j in range(40))),                         # one word only
        (61, "ODIOUS1, (odious2) " + " ".join(f"fair{j}" for j in range(1200))),             # two of more than 1000 words
        (62, "odious3 odious4 " + "well said " * 20), (63, None), (64, ""), (None, "odious5 odious6 too"),
        (3, rows[3][1]), (3, rows[3][1]), (65, "odious7 " * 3 + "x " * 40),
    ]
    labels = [(i, int(i < 20), "x") for i in range(50)] + [
        (63, 1, "x"), (64, 0, "x"), (None, 1, "x"), (7, None, "x"), (7, 0, "x"), (65, 0, "x"), (999, 1, "x")]
    return (rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), labels,
            spark.createDataFrame(labels, "doc_id bigint, toxic int, text string"))


def test_toxic_words_are_learnt(judged, nobody):
    rows, docs, labels, table = judged
    want = toxic(rows, [x[:2] for x in labels])
    assert {*range(20), 62, None, 65} == want
    rule = quality.toxic_rule(docs, table)
    found = rule.apply(quality.Block(pa.array([t for _, t in rows])))
    assert {i for (i, _), bad in zip(rows, found) if bad} == want
    kept = quality.assess(docs, [*quality.BASE, rule]).filter("kept").collect()
    assert not want & {r.doc_id for r in kept} and {30, 60, 61} <= {r.doc_id for r in kept}
    rules = quality.learnt(docs, table)
    assert {r.name for r in rules} == {r.name for r in quality.RULES} | {"toxic"}
    for few in (quality.toxic_rule(docs, table.limit(0)), quality.toxic_rule(nobody, table),
                quality.toxic_rule(docs, table.filter("doc_id > 14"))):
        assert not few.apply(quality.Block(pa.array([t for _, t in rows]))).any()


def test_toxic_words_are_learnt_from_a_bounded_sample(judged):
    _, docs, _, table = judged
    assert len(quality.toxic_rule(docs, table, labelled=6).marked) == 0
    assert len(quality.toxic_rule(docs, table).marked) > 0


def test_quality_order_does_not_matter(odd):
    forward = {r.doc_id: r.kept for r in quality.assess(odd, quality.RULES).collect()}
    back = {r.doc_id: r.kept for r in quality.assess(odd, quality.RULES[::-1]).collect()}
    assert forward == back


def test_quality_is_ordered_in_little_memory():
    import tracemalloc

    texts = pa.array([" ".join(f"w{(i * j) % 977}" for j in range(500)) for i in range(2_000)])
    rules = [*quality.RULES, quality.ToxicRule(np.arange(9, dtype=np.uint64))]
    tracemalloc.start()
    try:
        assert {r.name for r in quality.order(quality.Block(texts), rules)} == {r.name for r in rules}
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_quality_puts_cheap_rejections_first():
    def slow(n):
        import time
        time.sleep(0.02)
        return n < 5

    texts = pa.array(["a b", "c d e", "f " * 30])
    block = quality.Block(texts)
    dear = quality.Rule("dear", ("n_words",), slow)
    cheap = quality.Rule("cheap", ("n_words",), lambda n: n < 5)
    never = quality.Rule("never", ("n_words",), lambda n: n < 0)
    assert [r.name for r in quality.order(block, [never, dear, cheap])][0] == "cheap"


def test_quality_filter_keeps_columns(odd, nobody):
    kept = quality.filter_documents(odd)
    assert kept.columns == odd.columns
    want = {r.doc_id for r in quality.assess(odd).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == want
    assert quality.assess(nobody).count() == 0


def test_rows_without_ids_or_texts(unnamed, nobody):
    assert sorted((r.doc_id, r.n_words, r.kept) for r in quality.assess(unnamed).collect()) == [
        (None, 0, False), (None, 3, False)]
    assert sorted((r.doc_id, r.n_words, r.labels) for r in license_scan.scan(unnamed).collect()) == [
        (None, 0, ""), (None, 3, "")]
    pieced = pieces.encode_documents(unnamed).collect()
    assert sorted((r.doc_id, r.n_pieces > 0, r.exact) for r in pieced) == [(None, False, True), (None, True, True)]
    assert pieces.encode_documents(nobody).count() == 0


@pytest.mark.parametrize("region", [256, 2])
def test_near_duplicates(odd, odd_texts, region, monkeypatch):
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", region)
    want = near_duplicates(list(odd_texts.items()))
    rows = minhash_forest.near_duplicates(odd).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert want[r.doc_id] == (r.n_shingles, r.component_id)
        assert r.kept == (r.doc_id == r.component_id)


def test_a_large_family_hangs_together(spark, monkeypatch):
    """Copies with one word changed each: alike to the first text, not to each other."""
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", 16)
    base = [f"w{i}" for i in range(24)]
    texts = [" ".join(base)] + [
        " ".join(base[:k % 24] + [f"x{k}"] + base[k % 24 + 1:]) for k in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = minhash_forest.near_duplicates(docs).select("doc_id", "component_id").collect()
    want = near_duplicates(list(enumerate(texts)))
    assert sum(want[r.doc_id][1] != r.component_id for r in found) == 0


def _crowd():
    """A template that all share, too little of it to be alike, and two texts for each rest."""
    base, texts = [f"t{i}" for i in range(100)], []
    for k in range(150):
        own = [f"o{k}x{i}" for i in range(14)]
        twin = [f"y{k}x{i}" if i % 2 and i > 2 else w for i, w in enumerate(own)]
        texts += [" ".join(base + own), " ".join(base + twin)]
    return texts


def _chain():
    """Each text alike to the next one only; all share the head."""
    head = [f"h{i}" for i in range(60)]
    return [" ".join(head + [f"c{i}" for i in range(10 * k, 10 * k + 44)]) for k in range(150)]


@pytest.mark.parametrize("texts", [_crowd(), _chain()], ids=["crowd", "chain"])
def test_dense_regions_are_joined_whole(spark, monkeypatch, texts):
    monkeypatch.setattr(minhash_forest, "REGION_ROWS", 16)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = minhash_forest.near_duplicates(docs).select("doc_id", "component_id").collect()
    want = near_duplicates(list(enumerate(texts)))
    assert len({c for _, c in want.values()}) in (150, 1)
    assert sum(want[r.doc_id][1] != r.component_id for r in found) == 0


def test_near_duplicates_without_rows_or_ids(nobody, unnamed):
    assert minhash_forest.near_duplicates(nobody).count() == 0
    assert [(r.component_id, r.kept) for r in minhash_forest.near_duplicates(unnamed).collect()] == [
        (None, True)] * 2
    assert minhash_forest.drop_near_duplicates(unnamed).count() == 2


@pytest.mark.parametrize("shard", [512, 1])
def test_repeats(odd, odd_texts, shard):
    want = without_repeats(list(odd_texts.items()))
    rows = substring_dedup.remove_repeats(odd, shard_pieces=shard).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert want[r.doc_id][:3] == (r.n_words, r.n_removed, r.kept_sha256)


def test_repeats_leave_columns(odd, odd_texts, nobody, unnamed):
    want = without_repeats(list(odd_texts.items()))
    kept = substring_dedup.drop_repeats(odd)
    assert kept.columns == odd.columns
    rows = {r.doc_id: r for r in kept.collect()}
    assert set(rows) == {i for i, x in want.items() if x[0] != x[1] or not x[1]}
    for i, r in rows.items():
        assert r.text == (want[i][3] if want[i][1] else odd_texts[i])
    assert substring_dedup.remove_repeats(nobody).count() == 0
    assert {r.n_removed for r in substring_dedup.remove_repeats(unnamed).collect()} == {0}


def test_automaton_knows_the_first_document():
    reference = SuffixAutomaton()
    reference.add(list("abcabd"), 5)
    reference.add(list("xabc"), 3)
    reference.finish()
    assert reference.matches(list("abd"), 9)[-1] == (3, 5)
    assert reference.matches(list("zabcq"), 9) == [(0, None), (1, 3), (2, 3), (3, 3), (0, None)]
    assert reference.matches(list("abcab"), 2)[-1] == (2, 3)


def test_mix(odd, odd_texts):
    rows = mixing.Mix(odd, block_words=8).taken().collect()
    assert len(rows) == len(odd_documents())
    sizes = {i: len(words(t)) for i, t in odd_texts.items()}
    per, goal = {}, {}
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"]
        key = r.source_size, r.target
        per[key] = per.get(key, 0) + r.taken
        goal[key] = r.target
    total = sum(r["size"] for r in rows)
    assert sum(goal.values()) == pytest.approx(total)
    for key, taken in per.items():
        assert abs(taken - goal[key]) < 8 * 4
    source = {r.doc_id: r.source for r in odd.collect()}
    words_of = {}
    for r in rows:
        words_of[source[r.doc_id]] = words_of.get(source[r.doc_id], 0) + r["size"]
    want = mix_targets(words_of)
    for r in rows:
        assert r.source_size == words_of[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]])
    again = mixing.Mix(odd, block_words=8).taken().collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_targets():
    assert mixing.targets([10, 100, 5, 0], [5, 2, 1, 5]) == [30.0, 70.0, 15.0, 0.0]
    assert mixing.targets([], []) == []
    assert sum(mixing.targets([7, 1, 1, 40], [5, 2, 1, 5])) == pytest.approx(49)


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 100, "c": 5, None: 7}, {"Z": 1, "a": 1000, "\u00e9": 1, "\U0001d4b3": 1},
    {"a": 3}, {None: 9}, {"a": 1, "b": 1, "c": 30, "d": 0}])
def test_mix_targets_of_a_table(spark, sizes):
    rows = [(i, say(n, i), s) for i, (s, n) in enumerate(sizes.items())]
    found = mixing.Mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).taken().collect()
    want = mix_targets(sizes)
    source = {i: s for i, _, s in rows}
    for r in found:
        assert r.target == pytest.approx(want[source[r.doc_id]], abs=1e-6)
        assert r.taken <= 3 * r["size"]


def test_mix_permutation():
    import numpy as np
    for n in (1, 2, 3, 37, 64, 1000):
        got = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))
        assert sorted(got) == list(range(n))


def test_mixed_texts_hold_the_words_taken(odd, nobody, unnamed):
    taken = {r.doc_id: r.taken for r in mixing.Mix(odd).taken().collect()}
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    for r in mixed.collect():
        assert len(words(r.text)) == taken[r.doc_id]
        assert r.n_chars == len(r.text)
    assert mixing.Mix(nobody).taken().count() == 0
    assert mixing.Mix(unnamed).taken().count() == 2


def test_licenses(odd, odd_texts, nobody):
    rows = license_scan.scan(odd).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert tuple(r)[1:] == licenses(odd_texts[r.doc_id], license_scan.PHRASES,
                                        license_scan.TEMPLATES)
    assert license_scan.scan(nobody).count() == 0
    found = license_scan.similar_blocks(odd).filter("doc_id = 18").collect()
    assert [(r.label, r.containment) for r in found] == [("mit", 1.0)]


@pytest.mark.parametrize("size, hot", [(1 << 20, 1 << 18), (300, 20)])
def test_katz(odd, odd_texts, size, hot):
    rows = odd_documents()
    want, sums = plain_katz([r[:2] for r in rows], katz.discounts, katz._threshold, size)
    assert all(abs(s - 1) < 1e-9 for s in sums.values())
    found = katz.score_documents(odd, size, hot).collect()
    assert len(found) == len(rows)
    for r in found:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert r.base_score == pytest.approx(x[4]) and r.score == pytest.approx(x[5])


@pytest.mark.parametrize("numbered", [300, 3, 0])
def test_katz_knows_words_beyond_those_held_in_memory(odd, numbered):
    rows = odd_documents()
    want, _ = plain_katz([r[:2] for r in rows], katz.discounts, katz._threshold, 1 << 20)
    found = katz.score_documents(odd, hot=20, numbered=numbered).collect()
    assert len(found) == len(rows)
    for r in found:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert r.base_score == pytest.approx(x[4]) and r.score == pytest.approx(x[5])


@pytest.mark.parametrize("numbered", [300, 3])
def test_katz_with_many_buckets(odd, numbered, monkeypatch):
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 90)
    monkeypatch.setattr(katz, "RARE_TOKENS", 40)
    rows = odd_documents()
    want, _ = plain_katz([r[:2] for r in rows], katz.discounts, katz._threshold, 1 << 20)
    # Equal rows among those held out, which do not change the model.
    again = odd.filter("crc32(binary(string(doc_id))) % 5 = 1")
    found = katz.score_documents(odd.unionAll(again), hot=20, numbered=numbered).collect()
    assert len(found) == len(rows) + again.count() > len(rows)
    for r in found:
        x = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == x[:4]
        assert r.base_score == pytest.approx(x[4]) and r.score == pytest.approx(x[5])


def test_katz_reads_texts_once_to_score(odd):
    plan = plan_of(katz.score_documents(odd, hot=20, numbered=3))
    # One of texts and one of the pairs that were counted.
    assert plan.count("MapInArrow") == 2 and "Join" not in plan


def test_katz_without_rows_or_training(spark, nobody, unnamed):
    assert katz.score_documents(nobody).count() == 0
    assert katz.score_documents(unnamed).count() == 2
    alone = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    held = [i for i in range(40) if __import__("zlib").crc32(str(i).encode()) % 5 == 1][0]
    alone = alone.selectExpr(f"bigint({held}) AS doc_id", "text")
    assert [(r.train_tokens, r.n_tokens) for r in katz.score_documents(alone).collect()] == [(0, 3)]


def test_pieces_are_those_of_the_library(odd, odd_texts):
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    rows = pieces.encode_documents(odd).collect()
    assert len(rows) == len(odd_documents())
    for r in rows:
        assert r.pieces == file.encode(odd_texts[r.doc_id] or "")
        assert r.exact and r.n_pieces == len(r.pieces)


def test_pieces_of_spaces_and_unknown_characters():
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    texts = ["  a", "a  ", "   \u65e5  \u672c", " " * 70 + "x", "\t\n a\u2581b", "\U0001d4b3 \x00 y", " "]
    encoder = pieces.Encoder(pieces.load())
    ids = encoder.encode(pa.array(texts))
    assert ids.to_pylist() == [file.encode(t) for t in texts]
    assert encoder.decode(ids).to_pylist() == [t.replace("\u2581", " ") for t in texts]


def test_unigram_search_is_the_best_path():
    import itertools

    import numpy as np

    names = ["<unk>", "\u2581", "a", "b", "c", "ab", "bc", "abc", "\u2581a", "ca", "\u2581ab"]
    scores = np.array([0, -3, -2, -2.5, -2.2, -3.1, -3.3, -6.5, -3.2, -3.6, -5.9])
    model = pieces.build(names, scores, {}, {0}, merges=False)
    ids = {n.replace("\u2581", " "): i for i, n in enumerate(names) if i}
    texts = ["".join(x) for n in range(1, 6) for x in itertools.product("abc", repeat=n)]
    found = pieces.Encoder(model).encode(pa.array(texts)).to_pylist()

    def best(text):
        top = {0: (0.0, [])}
        for end in range(1, len(text) + 1):
            top[end] = max(((top[s][0] + scores[ids[text[s:end]]], top[s][1] + [ids[text[s:end]]])
                            for s in range(end) if s in top and text[s:end] in ids),
                           key=lambda x: x[0])
        return top[len(text)]

    for t, got in zip(texts, found):
        assert sum(scores[i] for i in got) == pytest.approx(best(" " + t)[0])
        assert "".join(names[i] for i in got).replace("\u2581", " ") == " " + t


def test_words_and_hashes():
    import numpy as np

    from cinefold.llm.words import Words, hash_bytes

    texts = pa.array(["a b\x0bc", None, "", " long" + "x" * 100 + " \u00e9\u2003y", "a b"])
    w = Words(texts)
    assert [w.word(i).decode() for i in range(len(w))] == [
        "a", "b", "c", "long" + "x" * 100, "\u00e9\u2003y", "a", "b"]
    assert w.counts.tolist() == [3, 0, 0, 2, 2]
    assert w.hashes.tolist() == [hash_bytes(w.word(i)) for i in range(len(w))]
    two = w.run_hashes(2)
    assert two[0] == two[5] and len(set(two[w.runs(2)].tolist())) == 3
    sliced = Words(texts.slice(3, 2))
    assert np.array_equal(sliced.hashes, w.hashes[3:])


def test_sha_of_an_empty_text(unnamed):
    rows = substring_dedup.remove_repeats(unnamed).collect()
    assert {r.kept_sha256 for r in rows} == {
        hashlib.sha256(x).hexdigest() for x in (b"a b c", b"")}
