from __future__ import annotations

import html
import re

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.functions.rounding import py_round


def values(spark, column, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(i, d) for i, d in enumerate(data)], f"i int, {schema}").orderBy("i").select(column).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.integers(-10**7, 10**7).map(lambda n: n / 1000), st.integers(0, 10**6).map(lambda n: n / 64)), min_size=20, max_size=200))
def test_py_round_is_pythons(spark, xs):
    df = spark.createDataFrame(pd.DataFrame({"i": range(len(xs)), "x": [float(x) for x in xs]}))
    got = df.select("i", *[py_round(F.col("x"), p).alias(f"p{p}") for p in (1, 4, 6)]).orderBy("i").toPandas()
    for p in (1, 4, 6):
        assert got[f"p{p}"].tolist() == [round(float(x), p) for x in xs]


def test_known_ties(spark):
    assert values(spark, py_round(F.col("x"), 1), [0.25, 0.35, 0.45, 2.5, -0.25], "x double") == [0.2, 0.3, 0.5, 2.5, -0.2]
    assert values(spark, py_round(F.col("x"), 4), [0.90625, 0.55625, None], "x double") == [0.9062, round(0.55625, 4), None]


def test_garbage(spark):
    cases = {"": True, "   ": True, "---": True, "[": True, "【」": True, "‘": True, "“": False, "”": False, "’": False, "a": False, ". .": True}
    assert values(spark, T.is_garbage(F.col("x")), list(cases)) == list(cases.values())


def test_headings(spark):
    cases = {
        "Chapter 1": True, "ch. 2:": True, "CHAPTER twenty five": True, "Chapter 1 of": False, "Part 3.": True, "Summary of it": True, "Summaries": False, "ChapterOne": True,
        "第3章 始": True, "第十部": True, "前言": True, "II. The": True, "I. The": False, "": False, "  Chapter 9  ": True, "A Chapter 1": False,
    }
    assert values(spark, T.is_heading(F.col("x")), list(cases)) == list(cases.values())


def test_clean_text(spark):
    assert values(spark, T.clean_pdf_text(F.col("x")), ["a  b ,c ( d ) !", " x "]) == ["a b,c (d)!", "x"]
    assert values(spark, T.clean_book_text(F.col("x")), ["a b­c ‐ situa- tion post- Soviet ,"]) == ["a bc - situation post- Soviet,"]


def test_normalise_and_escape(spark):
    texts = ["  A-B  c‐d, É_x! ", "", 'a<b>&"\''] 
    model = lambda t: re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", t.lower().strip()).replace("-", "").replace("‐", "").replace("‑", "")).strip()
    assert values(spark, T.normalise_for_match(F.col("x")), texts) == [model(t) for t in texts]
    assert values(spark, T.html_escape(F.col("x")), texts) == [html.escape(t) for t in texts]


def test_ratios(spark):
    assert values(spark, T.meaningful_ratio(F.col("x")), ["", "ab-", "日本!", None]) == [0.0, 2 / 3, 2 / 3, 0.0]
    assert values(spark, T.replacement_ratio(F.col("x")), ["�a b", " "]) == [1 / 3, 0.0]


def test_hyphens(spark):
    cases = [("inter", "esting", True), ("Inter", "esting", True), ("Foo", "bars", False), ("Foo", "tion", True), ("fo", "obar", False), ("the cat", "alog", True), ("abc", "de", False)]
    df = spark.createDataFrame(cases, "a string, b string, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.joins_by_hyphen(F.col("a"), F.col("b")), "want").collect())


def test_space_rule(spark):
    cases = [("a", "b", 5.0, True), ("a", "b", 3.9, False), ("a-", "b", 9.0, False), ("a", ",b", 9.0, False), ("", "b", 9.0, False)]
    df = spark.createDataFrame(cases, "a string, b string, gap double, want boolean")
    assert all(r[0] == r[1] for r in df.select(T.needs_space(F.col("a"), F.col("b"), F.col("gap"), F.lit(8.0)), "want").collect())
