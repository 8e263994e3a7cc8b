"""Structure operators against plain models and at their thresholds."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.operators import lines as L
from foliomill.operators import paragraphs as P
from foliomill.operators import quality as Q
from foliomill.operators import slicing as S

SCHEMA = "book_id long, page_number int, line_idx long, text string, x1 double, y1 double, x2 double, y2 double, confidence double, page_w double, page_h double"


def line(idx, text, page=1, x1=200.0, y1=None, x2=1500.0, h=24.0, conf=0.5, book=1):
    y1 = 100.0 + 30 * idx if y1 is None else y1
    return (book, page, idx, text, x1, y1, x2, y1 + h, conf, 1700.0, 2200.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_same_line_merge_against_model(spark):
    rnd = random.Random(1)
    rows = [line(i, rnd.choice(["ab", "c-", ",d", "e"]), page=rnd.randrange(1, 4), x1=float(rnd.randrange(0, 900)), y1=float(rnd.randrange(0, 60)), x2=0.0, h=float(rnd.choice([10, 12, 20]))) for i in range(60)]
    rows = [(*r[:6], r[4] + 8.0 * len(r[3]), *r[7:]) for r in rows]
    got = sorted((r.page_number, r.line_idx, r.text, r.x1, r.y2) for r in L.merge_same_line(frame(spark, rows)).collect())
    want = []
    for page in sorted({r[1] for r in rows}):
        own = sorted([r for r in rows if r[1] == page], key=lambda r: (r[5], r[2]))
        heights = sorted(r[7] - r[5] for r in own)
        n = len(heights)
        tolerance = (heights[n // 2] + heights[(n - 1) // 2]) / 2 * 0.4
        groups = []
        for r in own:
            c = (r[5] + r[7]) / 2
            home = next((g for g in groups if abs(c - (g[0][5] + g[0][7]) / 2) < tolerance), None)
            if home is None:
                groups.append([r])
            else:
                home.append(r)
        for k, g in enumerate(groups):
            g.sort(key=lambda r: r[4])
            text = g[0][3]
            for a, b in zip(g, g[1:], strict=False):
                wide = max((b[7] - b[5]) * 0.5, 4.0)
                space = a[3] and b[3] and not a[3].endswith("-") and b[3][0] not in ",.:;!?)]}%>" and b[4] - a[6] >= wide * 0.5
                text += (" " if space else "") + b[3]
            want.append((page, k, text, min(r[4] for r in g), max(r[7] for r in g)))
    assert got == sorted(want)


def test_hyphen_chains(spark):
    rows = [line(0, "the inter-"), line(1, "esting sub-"), line(2, "marine Next"), line(3, "word-", page=1), line(4, "less", page=3), line(5, "Foo-"), line(6, "bar baz")]
    got = [r.text for r in L.join_hyphenated(frame(spark, rows)).orderBy("line_idx").collect()]
    assert got == ["the interesting submarine Next", "word-", "less", "Foo-", "bar baz"]


def plain_fold(rows):
    """Lines of one book, one after another: each joins the last one or is added."""
    out = []
    for r in sorted(rows, key=lambda r: r[2]):
        r = list(r)
        if out:
            head = out[-1]
            first, second = head[3].rstrip(), r[3].lstrip()
            if first.endswith("-") and second[:1].islower() and r[1] - head[1] in (0, 1):
                first = first[:-1].strip()
                both = len(first) + len(second)
                if min(len(first), len(second)) > 2 and (second.lower() in T.SUFFIXES or first.lower() in T.PREFIXES or (not first[0].isupper() and both >= 6)):
                    head[8] = round((head[8] * len(first) + r[8] * len(second)) / both, 4)
                    head[3], head[6], head[7] = first + second, max(head[6], r[6]), max(head[7], r[7])
                    continue
        out.append(r)
    return [tuple(r) for r in out]


def test_hyphens_equal_a_fold(spark):
    rnd = random.Random(4)
    parts = ["coun-", "ter-", "inter-", " esting- ", "Foo-", "bar", "ly", "al-", "word", "Xa-", "ing", "multi-", "-", "", "sub-", "un-", "é-", "pre-part-", "　wide-	"]
    rows = []
    for book in range(1, 30):
        page = 1
        for k in range(60):
            page += rnd.random() < 0.15
            page += rnd.random() < 0.03
            rows.append(line(k, rnd.choice(parts), page=page, book=book, conf=rnd.randrange(1, 16) / 16, x2=float(rnd.randrange(900, 1500))))
    want = [r for book in range(1, 30) for r in plain_fold([r for r in rows if r[0] == book])]
    got = [tuple(r) for r in L.join_hyphenated(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(want) and len(want) < len(rows) - 100
    # A book whose every line goes on from the one before.
    chain = [line(k, "goes-", page=1 + k // 40) for k in range(400)]
    assert sorted(tuple(r) for r in L.join_hyphenated(frame(spark, chain)).collect()) == sorted(plain_fold(chain))


def test_no_python_groups_in_the_assembly(spark, sf_dir, capsys):
    from foliomill.plans import structure

    structure.hyphen_merge(spark, sf_dir).explain()
    structure.same_line_merge(spark, sf_dir).explain()
    structure.assemble_end_to_end(spark, sf_dir).explain()
    shown = capsys.readouterr().out
    assert "Physical Plan" in shown and "Pandas" not in shown and "Python" not in shown and "Arrow" not in shown


def test_headers_need_three_pages(spark):
    body = lambda p: [line(p * 10 + k, f"text {p} {k}", page=p, y1=800.0 + 40 * k) for k in range(3)]
    edge = lambda p: [line(p * 10 + 8, "Title", page=p, y1=50.0), line(p * 10 + 9, str(p), page=p, y1=2120.0)]
    two = [r for p in (1, 2) for r in body(p) + edge(p)]
    three = [r for p in (1, 2, 3) for r in body(p) + edge(p)]
    assert L.remove_headers_and_footers(frame(spark, two)).count() == len(two)
    assert {r.text[:4] for r in L.remove_headers_and_footers(frame(spark, three)).collect()} == {"text"}


def test_breaks_at_thresholds(spark):
    cases = {
        "gap": ([line(0, "a", y1=100.0), line(1, "b", y1=160.0)], False),
        "wide gap": ([line(0, "a", y1=100.0), line(1, "b", y1=160.1)], True),
        "indent": ([line(0, "a"), line(1, "b", x1=216.0), line(2, "c"), line(3, "d")], True),
        "ratio": ([line(0, "a", y1=100.0, h=20.0), line(1, "b", y1=122.0, h=26.0)], False),
        "taller": ([line(0, "a", y1=100.0, h=20.0), line(1, "b", y1=122.0, h=26.1)], True),
        "short end": ([line(0, "a.", x2=1134.0), line(1, "b")], True),
        "long end": ([line(0, "a.", x2=1136.0), line(1, "b")], False),
        "centred": ([line(0, "a"), line(1, "b", x1=700.0, x2=1000.0)], True),
        "blank": ([line(0, "a"), line(1, "  ")], True),
    }
    for k, (name, (rows, _)) in enumerate(cases.items()):
        cases[name] = ([(k, *r[1:]) for r in rows], cases[name][1])
    got = P.mark_breaks(frame(spark, [r for rows, _ in cases.values() for r in rows])).where("line_idx = 1").orderBy("book_id").collect()
    assert {n: r.is_break for n, r in zip(cases, got, strict=True)} == {n: want for n, (_, want) in cases.items()}


def test_merge_across_pages_folds_confidence(spark):
    paras = [(1, 0, "one two", 1, 1, 0.5, False), (1, 1, "three", 2, 2, 0.75, False), (1, 2, "four.", 2, 3, 0.9, False), (1, 3, "five", 3, 3, 0.1, False), (1, 4, "Six", 3, 3, 0.2, False), (1, 5, "seven", 5, 5, 0.2, False)]
    df = spark.createDataFrame(paras, "book_id long, para_idx int, text string, page_number int, page_end int, confidence double, is_centred boolean")
    got = P.merge_across_pages(df).orderBy("para_idx").collect()
    assert [r.text for r in got] == ["one two three four.", "five", "Six", "seven"]
    c = round((0.5 * 7 + 0.75 * 5) / 12, 4)
    assert got[0].confidence == round((c * 13 + 0.9 * 5) / 18, 4)
    assert (got[0].page_number, got[0].page_end) == (1, 3)


def test_chapters(spark):
    rows = [(1, 0, "front"), (1, 1, "Chapter 1"), (1, 2, "Chapter 2"), (1, 3, "body"), (2, 0, "only"), (2, 1, " "), (3, 0, " "), (3, 1, "Chapter 1"), (3, 2, "x")]
    df = spark.createDataFrame(rows, "book_id long, para_idx int, text string")
    got = [tuple(r) for r in P.chapters(P.assign_chapters(df)).orderBy("book_id", "chapter_order").collect()]
    assert got == [(1, 0, "Front Matter", 1), (1, 1, "Chapter 1", 0), (1, 2, "Chapter 2", 1), (2, 0, "全文", 1), (3, 0, "Chapter 1", 1)]


def test_native_gate(spark):
    texts = {"a" * 40: True, "a" * 9: False, "a" * 10: True, "a" * 39: True, "a" * 22 + "-" * 18: True, "a" * 21 + "-" * 19: False, "a" * 8 + "--": True, "a" * 7 + "---": False, "a" * 49 + "�": True, "a" * 48 + "��": False}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(Q.native_text_passes(F.col("x"))).collect()] == list(texts.values())


def test_retry_choice(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 0.5, 0.6), (3, None, 0.9), (4, 0.5, None)], "book_id long, score double, retry_score double").orderBy("book_id")
    assert [r.chosen for r in Q.choose_recognition(df).collect()] == ["first", "retry", "failed", "first"]


def test_file_match_prefers_first_file(spark):
    files = spark.createDataFrame([(1, 0, "a/x.html"), (1, 1, "b/x.html"), (1, 2, "Y.html"), (1, 3, "z1.html")], "book_id long, spine_idx int, file string")
    wanted = [("b/x.html", 0), ("y.html", 2), ("c/az1.html", 3), ("1.html", 3), ("q.html", None), ("", None)]
    entries = spark.createDataFrame([(1, i, f) for i, (f, _) in enumerate(wanted)], "book_id long, toc_index int, toc_file string")
    got = S.match_files(entries, files).orderBy("toc_index").collect()
    assert [r.spine_idx for r in got] == [w for _, w in wanted]


def test_file_match_of_repeated_names(spark):
    """Many files of one base name, and a file without a name, which every path ends with."""
    files = spark.range(1, 301).selectExpr("1L AS book_id", "CAST(id AS INT) AS spine_idx", "concat('d', id, '/') AS file").union(spark.createDataFrame([(2, 0, "a/B"), (2, 1, ""), (2, 2, "a/b")], "book_id long, spine_idx int, file string"))
    entries = spark.range(1, 301).selectExpr("1L AS book_id", "CAST(id AS INT) AS toc_index", "concat('e', id, '/') AS toc_file").union(spark.createDataFrame([(2, 0, "c/d"), (2, 1, "x/b"), (2, 2, "a/B")], "book_id long, toc_index int, toc_file string"))
    got = {(r.book_id, r.toc_index): r.spine_idx for r in S.match_files(entries, files).collect()}
    assert got == {(1, i): 1 for i in range(1, 301)} | {(2, 0): 1, (2, 1): 1, (2, 2): 0}


def test_slices(spark):
    blocks = spark.createDataFrame([(1, i, f"t{i}", "paragraph", None) for i in range(5)] + [(2, 0, "h", "heading", 1), (2, 1, "p", "paragraph", None)], "book_id long, block_index int, text string, type string, level int")
    cuts = spark.createDataFrame([(1, 1, "A", 0, 0), (1, 1, "B", 1, 1), (1, 3, "C", 0, 2), (2, 1, "one", 0, 0)], "book_id long, block_index int, title string, depth int, toc_index int")
    got = [(r.book_id, r.block_index, r.chapter_order, r.title) for r in S.build_book(blocks, cuts).orderBy("book_id", "block_index").collect()]
    assert got == [(1, 0, 0, "Front Matter"), (1, 1, 1, "A"), (1, 2, 1, "A"), (1, 3, 2, "C"), (1, 4, 2, "C"), (2, 0, 0, "h"), (2, 1, 0, "h")]


def test_recognition_boundary(spark):
    pages = spark.createDataFrame([(1, 1, 100.0, 200.0, bytearray(b"ok")), (1, 2, 100.0, 200.0, bytearray(b"bad"))], "book_id long, page_number int, page_w double, page_h double, image binary")

    def engine():
        def read(image):
            if bytes(image) == b"bad":
                raise RuntimeError("unreadable")
            return [([[1.0, 2.0], [9.0, 2.0], [9.0, 5.0], [1.0, 5.0]], " word ", 0.9), ([[0.0, 0.0]], "---", 0.5), ("short",)]

        return read

    got = L.ocr_lines(L.recognise(pages, engine)).collect()
    assert [(r.page_number, r.text, r.x1, r.y1, r.x2, r.y2) for r in got] == [(1, "word", 1.0, 2.0, 9.0, 5.0)]


def test_native_lines(spark):
    block = (0, [([72.0, 36.0, 144.0, 48.0], [("He",), ("llo ",)]), ([0.0, 0.0, 1.0, 1.0], [("x",)])])
    df = spark.createDataFrame([(1, 1, 612.0, 792.0, [block, (1, [])])], "book_id long, page_number int, page_w double, page_h double, blocks array<struct<type:int,lines:array<struct<bbox:array<double>,spans:array<struct<text:string>>>>>>")
    got = L.native_lines(df).collect()
    assert [(r.text, round(r.x1, 6), r.confidence) for r in got] == [("Hello", 200.0, 1.0)]


def test_assemble_is_independent_of_partitions(spark, sf_dir):
    from foliomill.plans import fixtures as X

    lines = X.page_lines(spark, sf_dir).where("book_id < 40")
    first, second = (sorted(map(tuple, P.assemble(x)[0].collect())) for x in (lines, lines.repartition(7).orderBy(F.rand(1))))
    assert first == second
