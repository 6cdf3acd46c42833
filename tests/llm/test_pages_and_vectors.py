import numpy as np
import pytest

from cinefold.llm import html_text, neighbours, url_filter


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, host string, text string")


URLS = [
    (None, "", "", None), ("", "", "", None), ("http://", "", "", None),
    ("HTTP://WWW.Example.COM/en/x?y", "www.example.com", "/en/x", "www.example.com/en/"),
    ("a://b://c.net/es/", "b:", "//c.net/es/", None), ("x://net/es/", "net", "/es/", "net/es/"),
    ("x://a.net/ES/", "a.net", "/ES/", None), ("x://example.com/en", "example.com", "/en", "com/"),
    ("x://com", "com", "", None), ("x://m.example.com/en/#", "m.example.com", "/en/", "example.com/en/"),
    ("x://notexample.org/en/", "notexample.org", "/en/", None),
    ("x://" + "a." * 3000 + "net/fr/1", "a." * 3000 + "net", "/fr/1", "net/fr/"),
    ("x://\u00e9.net/fr/\u00e9", "\u00e9.net", "/fr/\u00e9", "net/fr/"),
]


def test_urls(spark):
    table = pages(spark, [(i, u[0], "", "clash", "") for i, u in enumerate(URLS)])
    rows = url_filter.judge(table.union(table)).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r.host, r.path, r.rule) == URLS[r.page_id][1:]
        if r.rule:
            assert r.verdict == ("allow" if r.rule in url_filter.ALLOW else "block")
    assert url_filter.judge(table.limit(0)).count() == 0


def test_listed_hosts_are_blocked_where_no_rule_fits(spark):
    rows = url_filter.judge(pages(spark, [
        (1, "x://www.spam-farm.example.org", "", "", ""), (2, "x://a.spam-farm.example.com/z", "", "", ""),
        (3, "x://fine.example.org/", "", "", "")])).collect()
    assert {r.page_id: (r.verdict, r.listed) for r in rows} == {
        1: ("block", True), 2: ("allow", True), 3: ("allow", False)}


def test_a_cascade_is_exact_on_all_keys(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    universe = keys.select("key", *url_filter._hashes(F.col("key")))
    listed = [f"k{i}" for i in range(0, 20_000, 37)]
    cascade = url_filter.build(universe, 20_000, listed)
    rows = universe.toArrow()
    got = cascade.listed(*(np.asarray(rows.column(c)).view(np.uint64) for c in ("first", "second")))
    assert {k for k, ok in zip(rows.column("key").to_pylist(), got) if ok} == set(listed)
    assert len(cascade.levels) > 1
    assert sum(x.size for x in cascade.levels) < 13 * len(listed)


HELD_OUT = [
    ("<html><body><nav><a href=a>A</a> <a href=b>B</a></nav><main><h1>Title here</h1><p>One &amp; two"
     "<b>three</b> four.<p>Short.</main><aside>By the way, some more to read here.</aside>"
     "<footer>All rights</footer></body></html>", "Title here One & twothree four. Short."),
    ("<header>Site name</header><article><p>Text <script>var a='<p>no</p>'</script>goes on<br>and on"
     "</p><div class='ad-box'>Buy it now, this is quite a long advert text.</div><ul><li>x</li>"
     "<li>y z</li></ul></article><section id=comments><p>First! I think that this is a good text "
     "and would read it again.</p></section>", "Text goes on and on x y z"),
    ("<article><!-- <p>hidden</p> --><p>A &lt;tag&gt;&nbsp;&#233;</p><form><p>Your name</p></form>"
     "<p style='display:none'>secret</p></article>", "A <tag> \u00e9"),
    ("", ""), (None, ""), ("<article></article>", ""), ("<article><p>open", "open"),
    ("<article><p>a < b and <i>c</p><p>d</p></article>", "a < b and c d"),
]


def test_html(spark):
    table = pages(spark, [(i, None, h, "clash", "clash") for i, (h, _) in enumerate(HELD_OUT)])
    rows = html_text.extract(table.union(table)).collect()
    assert len(rows) == 2 * len(HELD_OUT)
    for r in rows:
        assert r.text == HELD_OUT[r.page_id][1]
        assert r.n_chars == len(r.text)
    assert html_text.extract(table.limit(0)).count() == 0


def test_html_tree_learns_the_labelled_table(spark):
    rows, main = html_text.labelled()
    tree = html_text.train(spark, rows, main)
    assert (tree.predict(rows) == main).mean() > 0.97
    # Without the marks, a long page between links is still told by words and link density.
    page = html_text.cut("".join(f"<div><a href='{i}'>a b</a></div>" for i in range(4)) + "".join(
        f"<div>{'word ' * 60}</div>" for _ in range(4)) + "<div><a href='z'>c d e</a></div>")
    assert tree.predict(html_text.features([page])).tolist() == [False] * 4 + [True] * 4 + [False]


def test_a_long_page(spark):
    long = "<article>" + "<p>word and word</p>" * 20_000 + "</article>"
    [row] = html_text.extract(pages(spark, [(1, "u", long, "", "")])).collect()
    assert row.n_chars == 20_000 * 14 - 1


def vectors(n, dims=16, seed=3, scale=False):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, dims)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * draw.uniform(0.5, 2, (n, 1)).astype(np.float32) if scale else x


def plain_neighbours(ids, x, every=20, nearest=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = x.astype(float) @ x[i].astype(float)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:nearest]
        out[int(ids[i])] = [int(ids[j]) for j in order], s[order]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    x, ids = vectors(1500, scale=scale), np.arange(1500)
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)],
                                  "vec_id bigint, embedding array<float>, rank int")
    rows = neighbours.nearest_neighbours(table, beam=128).collect()
    want, found = plain_neighbours(ids, x), {}
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert set(found) == set(want)
    recall = np.mean([len({v for v, _, _ in found[q]} & set(want[q][0])) / 20 for q in want])
    assert recall >= 0.9
    for q, got in found.items():
        assert [k for _, _, k in got] == list(range(1, 21))
        assert [(-s, v) for v, s, _ in got] == sorted((-s, v) for v, s, _ in got)
        exact = [float(x[v].astype(float) @ x[q].astype(float)) for v, _, _ in got]
        assert np.allclose([s for _, s, _ in got], exact, rtol=0, atol=1e-12)


def test_a_small_beam_finds_neighbours_in_64_dimensions(spark):
    """The graph itself has to be good: a search of few nodes does not mend a poor one."""
    x, ids = vectors(4000, dims=64), np.arange(4000)
    table = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x)],
                                  "vec_id bigint, embedding array<float>, rank int")
    found = {}
    for r in neighbours.nearest_neighbours(table, beam=40).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain_neighbours(ids, x)
    recall = np.mean([len(found[q] & set(want[q][0])) / 20 for q in want])
    assert recall >= 0.9


def test_leaves_halve_what_is_too_large():
    near = np.ones((5000, 4), np.float32)  # no plane parts these
    leaves = list(neighbours._leaves(near, np.random.default_rng(1)))
    assert max(map(len, leaves)) <= neighbours.LEAF_NODES
    assert sorted(np.concatenate(leaves)) == list(range(5000))


def test_rounds_end_when_lists_are_settled(spark):
    x = vectors(3000, dims=32)
    nodes = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)],
                                  "id bigint, vector array<double>, block int")
    changed = [neighbours.build(nodes, 3, settled=share).agg({"changed": "sum"}).first()[0]
               for share in (0.1, 0.0)]
    assert 0 < changed[0] <= 0.1 * 3000 * neighbours.DEGREE and changed[1] == 0


def test_odd_vectors(spark):
    x = vectors(30, dims=4)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(100 + i, x[0].tolist()) for i in range(50)] + [(20, x[20].tolist())]
    bad = [(200, None), (201, []), (202, [0.0] * 4), (220, [1.0, None, 0.0, 0.0]),
           (240, [float("nan"), 0.0, 0.0, 1.0]), (260, [float("inf"), 0.0, 0.0, 1.0]),
           (280, [1.0, 2.0]), (None, x[3].tolist())]
    table = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>")
    found = neighbours.nearest_neighbours(table).collect()
    kept = dict(rows)
    ids = np.array(sorted(kept))
    want = plain_neighbours(ids, np.array([kept[i] for i in ids], np.float32))
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: v for q, (v, _) in want.items()}
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<float>")
    assert neighbours.nearest_neighbours(few).count() == 2
    assert neighbours.nearest_neighbours(few.limit(0)).count() == 0
