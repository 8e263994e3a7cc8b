"""Each operator against a plain model, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import contextlib
import io
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from llm import models as m
from pyspark.sql import functions as F

from foliomill.llm import decontam, html_text, jaccard_join, langid, lm_score, mixing, quality_knn, quality_rules, sharding, suffix_array, suffix_dedup
from foliomill.llm.common import id_bucket
from foliomill.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None, None, None, None), (2, "", "en", "", 0), (3, "a", "en", "a", 1), (3, "a", "en", "a", 1), (None, "b c", "fr", "a", 3), (4, "x " * 30000, "en", "b", 60000), (5, " \n\t", None, "b", 3)]


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")


# --- sharding


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "en", "abcde"[min(i % 7, 4)], 1) for i in range(1000)]
    got = sharding.interleave_shards(docs(spark, rows), 24).collect()
    sizes = Counter(r.shard for r in got)
    assert len(got) == 1000 and set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    whole = Counter(r[3] for r in rows)
    for s in range(24):
        own = Counter(r.source for r in got if r.shard == s)
        assert all(abs(own[k] - sizes[s] * n / 1000) <= 2 for k, n in whole.items())


def test_shards_are_reproducible_and_take_edge_rows(spark):
    frame = docs(spark, EDGES).withColumn("shard", F.lit("old"))
    first, second = (sorted((str(r.doc_id), str(r.source), r.shard, r.slot) for r in sharding.interleave_shards(f, 3).collect()) for f in (frame, frame.repartition(7)))
    assert first == second and len(first) == len(EDGES)
    assert sharding.interleave_shards(frame.limit(0), 3).count() == 0


def test_shards_exchange_texts_once_and_take_rows_of_an_id_in_order(spark):
    rows = [(i % 40 if i % 9 else None, f"text {i * 7 % 120:03d}", "en", "ab"[i % 2], 1) for i in range(120)]
    cut = sharding.interleave_shards(spark.createDataFrame(rows, DOCS), 1, ties=("text",))
    with contextlib.redirect_stdout(io.StringIO()) as plan:
        cut.explain("formatted")
    assert sum("text#" in columns for columns in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan.getvalue())) == 1
    got = sorted(cut.collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(120)) and sorted((r.doc_id or -1, r.text) for r in got) == sorted((r[0] or -1, r[1]) for r in rows)
    for key in {(r.source, r.doc_id) for r in got}:
        own = [r.text for r in got if (r.source, r.doc_id) == key]
        assert own == sorted(own)


def test_many_single_strata_spread(spark):
    rows = [(i, "t", "en", f"s{i}", 1) for i in range(300)]
    assert max(Counter(r.shard for r in sharding.interleave_shards(docs(spark, rows), 5).collect()).values()) == 60


# --- mixing


def test_mix_meets_weights(spark):
    rows = [(i, "t", "en", "big" if i % 10 else "small", 1) for i in range(4000)]
    got = mixing.poisson_mix(docs(spark, rows), {"big": 1, "small": 1}, rows_out=4000).groupBy("source").count().collect()
    n = {r["source"]: r["count"] for r in got}
    assert abs(n["big"] - 2000) < 5 * math.sqrt(2000) and abs(n["small"] - 2000) < 5 * math.sqrt(2000 * 5)


def test_mix_is_poisson_and_order_is_global(spark):
    rows = [(i, "t", "en", "a", 1) for i in range(6000)]
    got = mixing.poisson_mix(docs(spark, rows), rows_out=9000).collect()
    copies = Counter(Counter(r.doc_id for r in got).values())
    for k in range(1, 5):
        p = math.exp(-1.5) * 1.5**k / math.factorial(k)
        assert abs(copies[k] - 6000 * p) < 5 * math.sqrt(6000 * p)
    assert [r.order_key for r in got] == sorted(r.order_key for r in got)
    assert all(r.copy <= r.copies for r in got)


def test_mix_with_high_rates_and_salted_join(spark):
    rows = [(i, "t", "en", "a" if i else "b", 1) for i in range(50)]
    frame = docs(spark, rows)
    high = mixing.poisson_mix(frame, {"b": 1}, rows_out=400)
    n = high.count()
    assert {r.source for r in high.collect()} == {"b"} and abs(n - 400) < 100
    one, two = (sorted(map(tuple, mixing.poisson_mix(frame, broadcast_sources=k).collect())) for k in (10, 1))
    assert one == two


def test_mix_edges(spark):
    frame = docs(spark, EDGES).withColumn("copy", F.lit("old"))
    got = mixing.poisson_mix(frame, rows_out=70)
    assert set(got.columns) >= {"doc_id", "text", "source", "copy", "copies", "order_key"} and got.count() > 20
    assert mixing.poisson_mix(frame.limit(0)).count() == 0


# --- HTML


def test_html_layout():
    page = """<html><head><title>no</title></head><body><h1>T &amp; t</h1><p>One<p>Two <b>bold
 text</b><br>next<ul><li>a<li>b<ul><li>c</ul><li>d</ul><ol start=3><li>x<li>z</ol><table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table>tail
<div hidden>no</div><span style="display: none">no</span><!-- no --><pre>  a
   b</pre><script>if (a<b) x="</p>"</script></td> end"""
    assert html_text.render(page) == "T & t\n\nOne\n\nTwo bold text\nnext\n\n- a\n- b\n  - c\n- d\n\n3. x\n4. z\n\nName       Qty\nApple pie  3\n\ntail\n\n  a\n   b\n\nend"


@pytest.mark.parametrize("page", ["", None, "<", "<<>>", "<p", "</div></p>", "<td>x</td>", "<table><td>a<table><tr><td>b", "<li>a</ul></ol>", "&bogus; &amp", "<script>", "<!--", "<details><p>x", "<q>a</q>" * 3, "<div>" * 3000 + "deep"])
def test_html_never_fails(page):
    assert isinstance(html_text.render(page), str)


def test_html_visibility():
    assert html_text.render("<details><summary>S</summary>hid<p>den</details><details open><summary>S</summary>seen</details>") == "S\nS\nseen"
    assert html_text.render('<noscript>n</noscript><input type=submit value="Go"><template>t</template><dialog>d</dialog>') == "Go"


def test_html_nested_details():
    assert html_text.render("<details open><summary>A</summary>a<details><summary>B</summary>b</details><p>seen</p>too</details>") == "A\na\nB\n\nseen\n\ntoo"
    assert html_text.render("<details><summary>A</summary>a<details open><summary>B</summary>b</details><p>no</p>no</details>end") == "A\nend"


def test_html_formulas_and_graphics():
    assert html_text.render("<p>If <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation>x=2 tex</annotation></semantics></math> then") == "If x=2 then"
    assert html_text.render('<svg><title>t</title><defs/><defs><text>no</text></defs><desc>d</desc><metadata>m</metadata><path d="M0"/><text>One</text><text>Two</text></svg>end').split() == ["One", "Twoend"]
    assert html_text.render("<desc>kept</desc><p>a") == "kept\n\na"


def test_html_visibility_is_inherited_and_taken_back():
    assert html_text.render('<div style="visibility:hidden">no<b style="visibility: visible">yes<i>too</i></b><ul><li>no<li style="visibility:visible">item</ul></div>end').split() == ["yestoo", "-", "item", "end"]
    assert html_text.render('<div style="display:none">no<b style="visibility:visible">no</b></div>end') == "end"
    assert html_text.render('<table><tr><td style="visibility:hidden">ab<td>c<tr><td>defg<td>h</table>') == "      c\ndefg  h"


def test_html_spans_keep_columns():
    assert html_text.render("<table><tr><td rowspan=2>aa<td>b<td>c<tr><td>dddd<td>e<tr><td>f<td>g<td>h</table>") == "aa  b     c\n    dddd  e\nf   g     h"
    assert html_text.render("<table><tr><td colspan=2>wide<td>x<tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e</table>") == "wide  x\na  b  c\nd     e"
    assert html_text.render("<table><tr><td colspan=1000 rowspan=99999>a<td>b<tr><td>c</table>") == "a  b\n   c"


def test_html_unclosed_markup():
    assert html_text.render("<p>a < b and <c d") == "a < b and"
    assert html_text.render("<p title='it>shown</p><p>too</p>") == "shown\n\ntoo"
    assert html_text.render("<a href=x'y>link</a> <b title=\"a>b\">c</b>") == "link c"


HOSTILE = {
    "unclosed tags": "a <b " * 200_000,
    "open brackets": "<" * 1_000_000,
    "comparisons": "a < b and <c " * 80_000,
    "quotes": "<a x='" * 150_000,
    "equal signs": "<a " + "= " * 500_000,
    "elements": "<div>x" * 150_000,
    "inline": "<b>x" * 200_000,
    "lists": "<ul><li>x" * 100_000,
    "tables": "<table><tr><td>x" * 60_000,
    "columns": "<table><tr>" + "<td colspan=1000>x" * 50_000,
    "rows": "<table>" + "<tr><td rowspan=1000>x" * 40_000,
    "raw": "<script></script" * 60_000,
    "end tags": "</p>" * 250_000,
}


@pytest.mark.parametrize("kind", HOSTILE)
def test_html_hostile_pages_take_linear_time(kind):
    start = time.process_time()
    html_text.render(HOSTILE[kind])
    assert time.process_time() - start < 30


class _Visible(HTMLParser):
    """Words of a page by the standard library's parser, without layout."""

    def __init__(self):
        super().__init__()
        self.skip, self.out = [], []

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag not in html_text.VOID and (self.skip or tag in html_text.HIDDEN or "hidden" in given or "none" in (given.get("style") or "")):
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_html_shows_what_another_parser_finds(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        other = _Visible()
        other.feed(r.html or "")
        squeezed = "".join("".join(other.out).split())
        shown = iter("".join(html_text.render(r.html).split()))
        assert all(c in shown for c in squeezed)  # in this order


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "<p>a", "old"), (1, "<p>a", "old"), (2, None, None)], "page_id long, html string, text string")
    assert sorted((r.page_id, r.text) for r in html_text.extract_text(df).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert html_text.extract_text(df.limit(0)).count() == 0


# --- Jaccard join


def mutated(rnd, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = rnd.randrange(len(words) + 1), rnd.random()
        if kind < 0.4 or not words:
            words.insert(at, rnd.choice(vocabulary))
        elif kind < 0.7:
            words.pop(at % len(words))
        else:
            words[at % len(words)] = rnd.choice(vocabulary)
    return words


def near_copies(seed, n, vocabulary, lengths, edits):
    rnd, rows = random.Random(seed), []
    for i in range(n):
        base = rnd.choice(rows)[1].split() if i % 3 and rows else [rnd.choice(vocabulary) for _ in range(rnd.choice(lengths))]
        rows.append((i, " ".join(mutated(rnd, base, vocabulary, rnd.choice(edits)))))
    return rows


def groups_of(spark, rows, k, percent):
    return sorted(map(tuple, jaccard_join.similar_groups(docs(spark, rows, "doc_id long, text string"), k, percent).collect()))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    rows = near_copies(5, 500, [f"w{i}" for i in range(40)], [1, 2, 3, 4, 8, 11, 13, 20, 30, 60, 150], [0, 1, 1, 2, 3])
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (5, rows[5][1]), (2003, rows[7][1].upper()), (2004, "  " + rows[8][1].replace(" ", "\n"))]
    want, links = m.jaccard_groups(rows, k, percent)
    assert links > 100 and groups_of(spark, rows, k, percent) == want


def test_jaccard_groups_of_copies_that_are_not_linked_with_their_head(spark):
    """One original, families of near copies of far copies of it: links run inside families only."""
    rnd = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(300)]
    rows = [(0, " ".join(base))]
    for family in range(12):
        far = mutated(rnd, base, vocabulary, rnd.choice([6, 10, 12, 14, 18]))
        rows += [(1 + family * 10 + j, " ".join(mutated(rnd, far, vocabulary, rnd.choice([0, 1, 3, 5])))) for j in range(10)]
    want, links = m.jaccard_groups(rows, 3, 90)
    assert links > 200 and len({c for *_, c in want}) > 3
    assert groups_of(spark, rows, 3, 90) == want


@pytest.mark.parametrize("seed", [1])
def test_jaccard_groups_larger_than_their_sample(spark, seed):
    """Families of edited copies, so many that heads give way to centres; edits repeat, so that members share them."""
    rnd = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(90)]
    families = [mutated(rnd, base, vocabulary, n) for n in (0, 4, 12)]
    rows = []
    for i in range(400):
        words = list(families[min(i % 5, 2)])
        for _ in range(rnd.choice([1, 2, 2, 3, 4, 5])):
            at = rnd.randrange(12) * 7
            words[at] = rnd.choice(["x", "y", words[at]]) if rnd.random() < 0.5 else rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                words.pop(at)
        rows.append((i, " ".join(words)))
    for k, percent in ((3, 90), (5, 80)):
        want, links = m.jaccard_groups(rows, k, percent)
        assert links > 100 and len({c for *_, c in want}) > 3
        assert groups_of(spark, rows, k, percent) == want


def thue_morse(n, swap=False):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_different_words_of_equal_polynomials_are_different(spark):
    one, other = thue_morse(2048), thue_morse(2048, True)
    rows = [(1, one), (2, other), (3, f"see {one} there now"), (4, f"see {other} there now")]
    assert groups_of(spark, rows, 3, 90) == m.jaccard_groups(rows, 3, 90)[0]
    assert {c for *_, c in groups_of(spark, rows, 3, 90)} == {1, 2, 3, 4}


def test_words_of_equal_hashes_are_compared_themselves(monkeypatch):
    texts = [("a b c d", "a b c e"), ("x y z", "X y z"), (None, "")]
    batch = pa.RecordBatch.from_arrays([pa.array([b"1"] * 3), pa.array([b"2"] * 3), *(pa.array([t[j] for t in texts]) for j in (0, 1))], names=["a", "b", "text_a", "text_b"])
    counts = lambda: [tuple(r[c] for c in ("shared", "size_a", "size_b")) for out in jaccard_join._overlaps(3, 90, False)([batch]) for r in out.to_pylist()]
    want = [(1, 2, 2), (1, 1, 1), (0, 0, 0)]
    assert counts() == want
    monkeypatch.setattr(jaccard_join.tb, "word_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    assert counts() == want


def test_jaccard_takes_null_ids_long_texts_and_clashing_columns(spark):
    long = " ".join(f"w{i}" for i in range(60000))
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "alone here now"), (8, long), (9, long + " end"), (8, "other text of one id")]
    frame = docs(spark, rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("n_shingles", "component_id", "node", "head", "sig")})
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.similar_groups(frame, 3, 90).collect())
    assert got == Counter([(None, 7), (7, 7), (None, None), (8, 8), (9, 8), (8, 8)])


def test_jaccard_on_documents(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    assert groups_of(spark, rows, 3, 90) == m.jaccard_groups(rows, 3, 90)[0]


def test_one_deletions_are_indexed_where_they_pay(spark):
    """With a billion documents in each band, small sets use segments of budget 2; every link must still meet."""
    rows = near_copies(6, 500, [f"w{i}" for i in range(40)], [11, 14, 20, 30, 45, 70], [0, 1, 1, 2])
    crowded = dict.fromkeys(range(40), 10**9)
    assert jaccard_join.scheme_for(4, *jaccard_join._LIMITS[4], 10**9, 90).double > 0
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows])], names=["text"])
    exact, gone = {}, {}
    at = 0
    for out in jaccard_join._index(3, 90, crowded)([batch]):
        for e, g in zip(*(out.column(j).to_pylist() for j in (1, 2)), strict=True):
            exact[at], gone[at] = set(e), set(g)
            at += 1
    sets = {i: m.shingles(t, 3) for i, t in rows}
    checked = 0
    for i in sets:
        for j in sets:
            if i < j and sets[i] != sets[j] and exact[i] and exact[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                assert exact[i] & exact[j] or exact[i] & gone[j] or gone[i] & exact[j]
                checked += 1
    assert checked > 20


def test_jaccard_empty(spark):
    assert groups_of(spark, [], 3, 90) == []


def test_components(spark, tmp_path):
    rnd = random.Random(2)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path), "t").collect()))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# --- quality classifier


def test_knn_separates_junk(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality_knn.learn(d, labels, id_bucket(F.col("doc_id"), 5) != 0)
    scored = quality_knn.classify(d, model).join(labels, "doc_id").where(id_bucket(F.col("doc_id"), 5) == 0).collect()
    good = [r.score for r in scored if r.quality == 1]
    bad = [r.score for r in scored if r.quality == 0]
    assert np.mean([s >= 0.3 for s in good]) > 0.95 and np.mean([g > b for g in good for b in bad]) > 0.9


def test_knn_edges(spark):
    frame = docs(spark, EDGES).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(2, 1), (3, 0), (4, 0), (9, 1), (5, None)], "doc_id long, quality int")
    model = quality_knn.learn(frame, labels, F.lit(True))
    got = quality_knn.classify(frame, model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    none = quality_knn.learn(frame, labels.limit(0), F.lit(True))
    assert {r.score for r in quality_knn.classify(frame, none).collect()} == {0.5}
    assert quality_knn.classify(frame.limit(0), model).count() == 0


def test_votes_match_a_plain_model_and_ties_go_to_the_first():
    rnd = np.random.default_rng(3)
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = unit(rnd.normal(size=(40, 8)))
    vectors[20:] = vectors[:20]  # every vector twice, with another label
    labels = np.concatenate([np.ones(20), np.zeros(20)]).astype(np.float32)
    model = quality_knn.Neighbours(np.ones(8), np.eye(8), vectors, labels)
    asked = unit(rnd.normal(size=(600, 8)))
    got = quality_knn.vote(asked, model, 5)
    for x, score in zip(asked, got, strict=True):
        cos = vectors @ x
        near = sorted(range(40), key=lambda i: (-round(float(cos[i % 20]), 6), i))[:5]
        weight = [max(float(cos[i]), 0) ** 4 + 1e-9 for i in near]
        assert score == pytest.approx(sum(w for w, i in zip(weight, near, strict=True) if i < 20) / sum(weight), abs=1e-4)


def test_repeated_ids_do_not_add_neighbours(spark):
    frame = docs(spark, [(1, f"text number {i} of one id") for i in range(50)] + [(2, "x y z")], "doc_id long, text string")
    model = quality_knn.learn(frame, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), F.lit(True))
    assert len(model.labels) == 2


# --- suffix arrays


def test_suffix_arrays_and_common_prefixes():
    rnd = random.Random(1)
    for _ in range(400):
        n, k = rnd.choice([1, 2, 3, 5, 10, 30, 100]), rnd.choice([1, 2, 3, 5])
        s = np.tile(np.array([rnd.randrange(k) for _ in range(n)], np.int16), rnd.choice([1, 1, 2, 4]))
        t = s.tolist()
        want = sorted(range(len(t)), key=lambda i: t[i:])
        sa = suffix_array.suffix_array(s, 6)
        assert sa.tolist() == want
        shared = [0] * len(t)
        for a, b in zip(want, want[1:], strict=False):
            while max(a, b) + shared[b] < len(t) and t[a + shared[b]] == t[b + shared[b]]:
                shared[b] += 1
        assert suffix_array.permuted_common_prefixes(s, sa).tolist() == shared


def test_doubling_sorts_like_recursion():
    rnd = random.Random(4)
    names = np.array([rnd.randrange(3) for _ in range(300)])
    t = names.tolist()
    assert suffix_array._by_doubling(names).tolist() == sorted(range(300), key=lambda i: t[i:])


@pytest.mark.parametrize("group_bytes", [suffix_dedup.GROUP_BYTES, 300, 1])
def test_repeats_removed(spark, group_bytes):
    rnd = random.Random(3)
    passages = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.choice([20, 30, 45, 60, 90]))) for _ in range(12)]
    pick = lambda: rnd.choice([rnd.choice(passages), "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(1, 60))), "ab" * rnd.randrange(1, 60), "x" * rnd.randrange(1, 90)])
    rows = [(i, "".join(pick() for _ in range(rnd.randrange(0, 6))) if i % 40 else None) for i in range(160)] + [(7, "y" * 50), (7, "y" * 50)]
    got = suffix_dedup.remove_repeats(docs(spark, rows, "doc_id long, text string").withColumn("kept", F.lit(1)), 40, group_bytes=group_bytes).collect()
    import hashlib

    assert sorted((r.doc_id, r.n_bytes, sum(s.length for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == m.repeats_removed(rows, 40)


def test_repeated_passages_of_words(spark, real):
    rows = [(r.doc_id, r.text) for r in real.collect()]
    shared = " ".join(f"p{i}" for i in range(51))
    rows += [(-1, f"one {shared} more"), (-2, f"other\n{shared.upper()}"), (-3, shared[:-2]), (None, "x"), (-4, shared + " " + shared)]
    texts = {t for _, t in rows if t}
    windows = lambda t: [tuple(w[i : i + 51]) for w in [m.WORD.findall(m.lower(t))] for i in range(len(w) - 50)]
    seen = Counter(x for t in texts for x in set(windows(t)))
    copies = Counter(t for _, t in rows)
    want = sorted((str(i), sum(seen[x] > 1 or copies[t] > 1 for x in windows(t))) for i, t in rows)
    frame = docs(spark, rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_repeat_windows) for r in suffix_dedup.remove_repeats(frame).select("doc_id", "n_repeat_windows").collect())
    assert got == want and sum(n > 0 for _, n in got) > 5


def test_strings_of_equal_polynomials_do_not_repeat(spark):
    rows = [(1, thue_morse(2048)), (2, thue_morse(2048, True)), (None, "x" * 90), (3, None)]
    got = [(r.doc_id, sum(x.length for x in r.removed)) for r in suffix_dedup.remove_repeats(docs(spark, rows, "doc_id long, text string"), 1024).collect()]
    assert dict(got) == {i: n for i, _, n, *_ in m.repeats_removed([r for r in rows if r[0]], 1024)} | {None: 0}


def test_repeats_on_documents(spark, real):
    import hashlib

    rows = [(r.doc_id, r.text) for r in real.collect()]
    got = suffix_dedup.remove_repeats(real.select("doc_id", "text"), 400).collect()
    assert sorted((r.doc_id, r.n_bytes, sum(s.length for s in r.removed), len(r.removed), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in got) == m.repeats_removed(rows, 400)
    assert suffix_dedup.remove_repeats(real.limit(0), 400).count() == 0


# --- language identification


def test_suffix_automaton_accepts_exactly_the_substrings():
    rnd = random.Random(1)
    text = [rnd.randrange(3) for _ in range(60)]
    moves = langid.suffix_automaton(text)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i, 61)}

    def accepts(s):
        state = 0
        for c in s:
            if c not in moves[state]:
                return False
            state = moves[state][c]
        return True

    for _ in range(500):
        s = tuple(rnd.randrange(3) for _ in range(rnd.randrange(1, 8)))
        assert accepts(s) == (s in inside)


def test_phrases_are_the_longest_matches():
    rnd = random.Random(2)
    train = "".join(rnd.choice("ab ") for _ in range(200))
    of = {" ": 0, "a": 2, "b": 3}
    parsers = langid.parsers_of({"x": train})
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 80))) for _ in range(50)]
    codes = [[of.get(c, 1) for c in t] for t in texts]

    def greedy(t):
        n = at = 0
        while at < len(t):
            size = 1
            while at + size < len(t) and t[at : at + size + 1] in train:
                size += 1
            at, n = at + size, n + 1
        return n

    flat, bounds = np.array([c for t in codes for c in t], np.uint16), np.concatenate([[0], np.cumsum([len(t) for t in codes])])
    assert langid.phrase_counts(flat, bounds, parsers)[:, 0].tolist() == [greedy(t) for t in texts]


def _greedy(text, train):
    """Phrases of a text by the plain reading of the method."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in train:
            size += 1
        at, n = at + size, n + 1
    return n


def test_phrases_run_on_across_blocks(monkeypatch):
    rnd = random.Random(3)
    trains = {"x": "".join(rnd.choice("ab ") for _ in range(300)) + "a" * 40, "y": "".join(rnd.choice("bc ") for _ in range(300))}
    texts = ["".join(rnd.choice("abcd ") for _ in range(10_000)), "a" * 10_000, "ab" * 3, "", trains["x"] * 20]
    texts = [langid._letters(t) for t in texts]
    codes, bounds = langid._encode(pa.array(texts), {"a": 2, "b": 3, "c": 4, " ": 0})
    expected = [[_greedy(t, train) for train in trains.values()] for t in texts]
    for block in (7, 100, 4096, 1 << 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert langid.phrase_counts(codes, bounds, langid.parsers_of(trains)).tolist() == expected


def test_transitions_are_bounded_by_the_training_text():
    rnd = random.Random(4)
    trains = {k: "".join(chr(base + rnd.randrange(6000)) for _ in range(16_000)) for k, base in (("han", 0x4E00), ("high", 0x20000))}
    parsers = langid.parsers_of(trains)
    assert sum(x.nbytes for x in (parsers.table, parsers.first)) < 8 << 20
    codes, bounds = langid._encode(pa.array([trains["han"][50:90], trains["high"][7:60], "z"]), {c: i + 2 for i, c in enumerate(parsers.alphabet)} | {" ": 0})
    counts = langid.phrase_counts(codes, bounds, parsers)
    assert counts[0, 0] == counts[1, 1] == 1 and counts[0, 1] == 40 and counts[1, 0] == 53 and counts[2].tolist() == [1, 1]


def test_language_predictions_equal_a_plain_model(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    usable = id_bucket(F.col("doc_id"), 4) != 2
    # With room for every passage the training text is all usable text, in some order of passages.
    parsers = langid.learn(d, usable, train_rows=40, passage=200)
    again = langid.learn(d.repartition(7), usable, train_rows=40, passage=200)
    assert parsers.languages == again.languages and (parsers.table == again.table).all()
    whole = langid.learn(d.unionByName(d), usable, train_rows=40, passage=200)
    assert (whole.table == parsers.table).all()
    trains = {}
    rows = d.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.transform(F.sequence(F.lit(0), F.lit(9999)), lambda k: F.xxhash64(F.col("doc_id").cast("string"), k)).alias("u")).collect()
    for r in rows:
        if any(c.isalpha() for c in r.text):
            pieces = [r.text[i : i + 200] for i in range(0, len(r.text), 200)]
            trains.setdefault(r.lang, set()).update(zip(r.u, pieces, strict=False))
    trains = {k: " ".join(x for x in (langid._letters(p) for _, p in sorted(v)[:40]) if x) for k, v in sorted(trains.items())}
    assert parsers.languages == list(trains) and parsers.weights.tolist() == [np.log2(len(t) + 1) for t in trains.values()]
    for r in langid.predict(d, parsers).limit(12).collect():
        t = langid._letters(r.text or "")
        if t:
            cost = {k: _greedy(t, x) * np.log2(len(x) + 1) for k, x in trains.items()}
            assert r.lang_pred == min(cost, key=lambda k: (cost[k], k))


def test_language_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text")
    held = id_bucket(F.col("doc_id"), 4) == 2
    got = langid.predict(d, langid.learn(d, ~held)).where(held).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.98


def test_language_edges(spark):
    frame = docs(spark, EDGES).withColumn("score", F.lit("old"))
    got = langid.predict(frame, langid.learn(frame, F.lit(True))).collect()
    assert {r.doc_id: r.lang_pred for r in got if r.doc_id in (1, 2, 5)} == dict.fromkeys((1, 2, 5), "und")
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, None)} <= {"en", "fr"} and all(0 <= r.score <= 1 for r in got)
    untrained = langid.learn(frame, F.lit(False))
    assert {r.lang_pred for r in langid.predict(frame, untrained).collect()} == {"und"}
    assert langid.predict(frame.limit(0), untrained).count() == 0


# --- quality rules


def test_measures(spark):
    rnd = random.Random(1)
    texts = [None, "", " \n", "a b c d e f g h " * 3, "x " * 5000, "l one\nl one\n\n \nl two\r\nl two\r"]
    texts += ["".join(rnd.choice(["ab ", "c# ", "é\n", "d\t", "  ", "<e> ", "f\x0b", " g "]) for _ in range(rnd.randrange(0, 120))) for _ in range(60)]
    frame = docs(spark, [(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("n_words", F.lit("old"))
    got = {r.doc_id: r for r in quality_rules.apply_rules(frame).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == m.quality(t)
        assert not (r.base_failed and r.kept)


def test_rule_order_does_not_change_verdicts(spark, real):
    rules = quality_rules.DEFAULT_RULES
    one, two = (sorted(map(tuple, quality_rules.apply_rules(real, r).select("doc_id", "kept").collect())) for r in (rules, rules[::-1]))
    assert one == two and {True, False} == {k for _, k in one}
    assert quality_rules.apply_rules(real.limit(0)).count() == 0


# --- language model


def test_base_scores_and_join_way(spark, sf_dir, real):
    train = id_bucket(F.col("doc_id"), 5) != 1
    extra = docs(spark, [(9001, None), (9002, ""), (9003, "zzqq unseen"), (9003, "zzqq unseen")], "doc_id long, text string")
    frame = real.select("doc_id", "text").union(extra)
    got = lm_score.score_texts(frame.withColumn("score", F.lit("old")), train).collect()
    other = {r.doc_id: r for r in lm_score.score_texts(frame, train, broadcast_tokens=10).collect()}
    rows = [(r.doc_id, [*m.WORD.findall(m.lower(r.text)), None]) for r in frame.collect()]
    counts = Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in rows}
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert abs(r.base_score - want[r.doc_id][3]) < 1e-6 and r.score < 0
        o = other[r.doc_id]
        assert o.n_known == r.n_known and abs(o.score - r.score) < 1e-6 * abs(r.score) and abs(o.base_score - r.base_score) < 1e-6


def test_model_beats_the_unigram_and_sums_to_one(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = id_bucket(F.col("doc_id"), 5) == 1
    r = lm_score.score_texts(d, ~held).where(held).agg(F.sum("base_score").alias("b"), F.sum("score").alias("s")).first()
    assert r.s > r.b


def test_all_training_tokens_depend_on_the_words_before(spark):
    """2,000 pairs of equally frequent words: each second word follows its first only."""
    rnd = random.Random(5)
    rows = [(i, " ".join(f"a{k} b{k}" for k in (rnd.randrange(2000) for _ in range(100)))) for i in range(1000)]
    frame = docs(spark, [*rows, (9001, "a7 b7 a1500 b1500"), (9002, "b7 a7 b1500 a1500")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_score.score_texts(frame, F.col("doc_id") < 9000).collect()}
    assert got[9001].base_score == pytest.approx(got[9002].base_score)
    assert got[9001].score > got[9002].score + 1 and got[9001].score > got[9001].base_score


def test_scores_do_not_depend_on_partitions(spark):
    """Within a millionth, at 1, 2 and 64 partitions in different orders."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    train = id_bucket(F.col("doc_id"), 5) != 1
    one, *others = ({r.doc_id: r.score for r in lm_score.score_texts(x, train).collect()} for x in (d.coalesce(1), d.repartition(2, "text"), d.orderBy(F.desc("doc_id")).repartition(64)))
    for other in others:
        assert all(abs(one[i] - s) <= 1e-6 * abs(one[i]) for i, s in other.items())


def test_tree_sums_to_one(spark):
    rows = [(1, " ".join(f"w{i % (1 + i % 97)}" for i in range(3000)))]
    frame = docs(spark, rows, "doc_id long, text string")
    vocabulary = frame.select("text").mapInArrow(lm_score._counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = np.array([r.token for r in vocabulary.collect()], np.int64).view(np.uint64)
    tree = lm_score.plant(vocabulary, 3001, len(tokens))
    tree = lm_score.replace(tree, weights=np.random.default_rng(0).normal(size=len(tree.weights)).astype(np.float32))
    codes, lengths = tree.codes(tokens)
    bits = [format(int(c), f"0{n}b") for c, n in zip(codes, lengths, strict=True)]
    assert len(set(bits)) == len(bits) and not any(a != b and b.startswith(a) for a in bits for b in bits)
    # The first words of as many texts: all have the same context
    tree = lm_score.replace(tree, bias=np.where(np.abs(tree.bias) > 3, tree.bias * 9, tree.bias))
    assert np.exp(lm_score._walk(tree, tokens, np.arange(len(tokens) + 1))).sum() <= 1 + 1e-4


def test_language_model_vocabulary_is_not_collected_at_once(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"word{i} word{i + 1} the of {'the ' * (i % 5)}") for i in range(300)], "doc_id long, text string")
    train = F.col("doc_id") % 5 != 1
    whole = {r.doc_id: r for r in lm_score.score_texts(frame, train, broadcast_tokens=10).collect()}
    got, to_arrow = [], type(frame).toArrow
    monkeypatch.setattr(type(frame), "toArrow", lambda self: got.append(to_arrow(self)) or got[-1])
    monkeypatch.setattr(lm_score, "HEAD", 301)
    held = {r.doc_id: r for r in lm_score.score_texts(frame, train).collect()}
    assert [x.num_rows for x in got] == [301]  # the head alone, of 304 types
    assert all(held[i][c] == whole[i][c] for i in whole for c in ("doc_id", "n_tokens", "n_known", "train_tokens")) and all(held[i].base_score == pytest.approx(whole[i].base_score) for i in whole)


def test_lm_without_training_rows(spark):
    frame = docs(spark, [(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm_score.score_texts(frame, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in got)
    assert lm_score.score_texts(frame.limit(0), F.lit(True)).count() == 0


# --- decontamination


@pytest.mark.parametrize("block", [decontam.BLOCK_WINDOWS, 3])
def test_contamination(spark, block):
    rnd = random.Random(1)
    word = lambda: rnd.choice(["a", "B", "c1", "é", " x", "dd"])
    sep = lambda: rnd.choice([" ", ", ", "\n", "--", "\x7f"])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    items = [(i, text(rnd.choice([0, 1, 3, 4, 6, 9]))) for i in range(8)] + [(20, None), (21, "dd dd dd dd dd"), (None, "a a a a"), (None, "é é é é"), (21, "dd dd dd dd dd")]
    rows = [(i, text(rnd.randrange(0, 60))) for i in range(60)] + [(97, "A, a a a"), (98, None), (99, "?!"), (100, "no " * 40000 + "dd dd dd dd")]
    frame = docs(spark, rows, "doc_id long, text string").withColumn("hits", F.lit("old"))
    found = decontam.find_contamination(frame, docs(spark, items, "item_id long, text string"), window=4, block_windows=block)
    got = found.withColumn("n_hit", decontam.n_hit_words()).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got) == m.contamination(rows, items, 4)
    texts = dict(rows)
    for r in got:
        for h in r.hits:
            assert len(decontam.words_of(texts[r.doc_id][h.from_char : h.to_char])) == h.length


def test_offsets_map_to_the_original():
    text = "Foo,  BAR--bäz! qux"
    spans = decontam.original_spans(text, [(1, 2)])
    assert [text[a:b] for a, b in spans] == ["BAR--bäz"]


def test_no_items(spark):
    frame = docs(spark, [(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.hits, r.item_ids) for r in decontam.find_contamination(frame, none).collect()] == [(2, [], [])]
    assert decontam.find_contamination(frame.limit(0), none).count() == 0
