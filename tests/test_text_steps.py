"""Text steps that many queries share: cheaper, with the results of their plain patterns."""

from __future__ import annotations

from duck import assert_same
from pyspark.sql import functions as F

from foliomill.functions import text as T
from foliomill.plans import fixtures as X


def values(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(column).collect()]


def test_clean_text_equals_its_patterns(spark):
    texts = ["", None, "plain text", "a , b", "é ,x", "x　)", "(\t a", "¿ que", "a , b", "a  b", "( )", "a .", "a\x1f.", " ", "é, ü. [ü]", "a,\nb", "a\n,b", "{ z", "…. ."]

    def plain(x):
        x = F.regexp_replace(x, " {2,}", " ")
        x = F.regexp_replace(x, r"(?U)\s+([,.:;!?)\]}>%])", "$1")
        return T.strip(F.regexp_replace(x, r"(?U)([\[({¿¡])\s+", "$1"))

    assert values(spark, T.clean_pdf_text(F.col("x")), texts) == values(spark, plain(F.col("x")), texts)


def test_texts_without_odd_spaces_meet_no_replacement(spark):
    """The patterns of the clean-up are behind a condition, those of headings behind a look at two characters."""
    plan = spark.range(1).select(T.clean_pdf_text(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan
    heads = spark.range(1).select(T.is_heading(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert "substring" in heads


def test_headings_equal_their_patterns(spark):
    pattern = "^(?:" + "|".join(f"(?:{p})" for p in T.HEADINGS) + ")"
    body = T.strip(F.col("x"))
    plain = (body != "") & (body.rlike(pattern) | T.camel_split(body).rlike(pattern))
    texts = ["cHapter 1", "PT. 3", "Pt 4", "ſummary of", "aBout the author", "aboutThe author", "AboutThe Author", "IX. x", "ix. x", "I. x", "序", "第 3 章", "序言", "reference x", "noTes", "Foreword", "ch 1", "c", "", None, "ChapterOne", "index", "İndex"]
    assert values(spark, T.is_heading(F.col("x")), texts) == values(spark, plain, texts)


def test_lines_that_end_in_a_carriage_return_equal_sql(spark, tmp_path):
    """A full stop before \\r is no end of the text, as in SQL."""
    import duckdb

    text = "\n".join(f"Line {k} ends.\r" for k in range(30))
    spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = X.body_lines(spark, str(tmp_path)).select("line_idx", "text")
    assert_same(got, con, f"WITH {X.BODY_SQL} SELECT line_idx, text FROM body")
