"""The pipeline stage by stage against plain versions of what each stage does."""

from collections import Counter

import pytest
from helpers import near_duplicates, say, without_repeats, words

import corpus_pipeline
from cinefold.llm import mixing, pieces, quality


@pytest.fixture(scope="module")
def folder(odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    # Rows that share an id are one document; a mix of copies of one row is told in its own test.
    odd.dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(
        f"{path}/documents.parquet")
    odd.sparkSession.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        out = f"{folder}/stage-{len(found)}"
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        found.append(docs)
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(spark, folder, stages):
    columns = spark.read.parquet(f"{folder}/documents.parquet").columns
    assert [s.columns for s in stages[:-1]] == [columns] * (len(stages) - 1)


def test_quality_near_duplicates_and_passages(spark, folder, stages):
    docs = texts(spark.read.parquet(f"{folder}/documents.parquet"))
    judged = {r.doc_id for r in quality.assess(
        spark.read.parquet(f"{folder}/documents.parquet")).collect() if r.kept}
    good = texts(stages[0])
    assert good == {i: docs[i] for i in judged}
    groups = near_duplicates(list(good.items()))
    single = texts(stages[1])
    assert single == {i: t for i, t in good.items() if groups[i][1] == i}
    rest = without_repeats(list(single.items()))
    assert texts(stages[2]) == {
        i: rest[i][3] if rest[i][1] else t for i, t in single.items() if rest[i][0] != rest[i][1]}


def kept_by_five_words(rows):
    """Ids of the smallest document of each group that is alike in runs of five words."""
    sets, root = {}, {}
    for i, t in rows:
        w = [x.lower() for x in words(t)]
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        root[i] = i
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def test_near_duplicates_are_alike_in_five_words(spark, folder, stages):
    base = [f"w{i}" for i in range(100)]
    scattered = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(base)]
    made = [(101, " ".join(base)), (102, " ".join(scattered)), (103, " ".join(base + ["more"]))]
    docs = spark.createDataFrame(made, "doc_id bigint, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, folder)
    assert {r.doc_id for r in left.collect()} == {101, 102} == kept_by_five_words(made)
    good = texts(stages[0])
    assert set(texts(stages[1])) == kept_by_five_words(list(good.items()))


def test_the_mix_takes_words_of_the_stage_before(stages):
    before = texts(stages[2])
    taken = {r.doc_id: r.taken for r in mixing.Mix(stages[2]).taken().collect()}
    mixed = texts(stages[3])
    assert set(mixed) == {i for i, n in taken.items() if n}
    for i, t in mixed.items():
        have, had = Counter(words(t)), Counter(words(before[i]))
        assert sum(have.values()) == taken[i]
        assert all(n <= 3 * had[w] for w, n in have.items())


def test_the_last_stage_encodes_whole_texts(spark, folder, stages):
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    mixed = texts(stages[3])
    rows = stages[4].collect()
    assert {r.doc_id: r.pieces for r in rows} == {i: file.encode(t) for i, t in mixed.items()}
    assert all(r.exact for r in rows)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def run_on(spark, path, docs, labels):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(i, t, "en", "a", len(t) if t is not None else None) for i, t in docs]
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return corpus_pipeline.run(spark, path)


def test_pipeline_of_nothing(spark, tmp_path):
    result = run_on(spark, str(tmp_path), [], [])
    assert result.columns == ["doc_id", "n_pieces", "pieces", "exact"]
    assert result.collect() == []


def test_pipeline_of_null_and_repeated_rows(spark, tmp_path):
    docs = [(None, say(60, 31)), (None, None), (4, None), (5, say(60, 32)), (5, say(60, 32)), (6, say(60, 32)),
            (7, ""), (8, say(60, 33))]
    result = run_on(spark, str(tmp_path), docs, [(None, 1, 1), (5, None, None), (99, 0, 1)])
    rows = result.collect()
    # One source is mixed from itself, so whatever the earlier stages keep is taken whole.
    assert {r.doc_id for r in rows} == {None, 5, 8}
    assert all(r.exact and r.n_pieces > 60 for r in rows)
