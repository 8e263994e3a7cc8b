"""Queries over translation items: one job for each book, its paragraphs in order."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import enrich as E
from foliomill.operators import migrate as M
from foliomill.operators import paragraphs as P
from foliomill.plans import fixtures as X
from foliomill.sources.scratch import saved, shared_folder


class EchoProvider:
    """A deterministic provider: lower case behind a mark; some lengths fail or go missing."""

    def one(self, prompt: str, text: str) -> str:
        if len(text) % 13 == 0:
            raise ValueError("provider error")
        return "" if len(text) % 17 == 0 else f"zh:{text.lower()}"

    def batch(self, prompt: str, items: list[tuple[str, str]]) -> str:
        return json.dumps([{"id": i, "translation": f"zh:{t.lower()}"} for i, t in items if len(t) % 13 and len(t) % 17])


def items(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs before merging: job_id, id, para_idx, text."""
    paras = P.merge_paragraphs(P.mark_breaks(X.body_lines(spark, d)))
    return paras.select(F.col("book_id").alias("job_id"), F.concat_ws("-", F.col("book_id").cast("string"), F.col("para_idx").cast("string")).alias("id"), "para_idx", "text")


def cache_of(own: DataFrame) -> DataFrame:
    """Texts of every third book are known."""
    known = E.with_hash(own.where("job_id % 3 = 0")).select("source_hash", "text").distinct()
    return known.select("source_hash", F.concat(F.lit("old:"), F.col("text")).alias("translated_text"), F.lit("completed").alias("status"))


def cache(spark: SparkSession, d: str) -> DataFrame:
    return cache_of(items(spark, d))


def job(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Items, assembled once, and the cache."""
    own = saved(items(spark, d), shared_folder(spark), "items")
    return own, cache_of(own)


ITEMS_SQL = "WITH " + X.BODY_SQL + X.BREAKS_SQL.replace("{source}", "body") + """,
items AS (SELECT book_id AS job_id, concat_ws('-', CAST(book_id AS VARCHAR), CAST(para_idx AS VARCHAR)) AS id, para_idx, text, md5(text) AS source_hash, CAST(floor((row_number() OVER (PARTITION BY book_id ORDER BY para_idx) - 1) / 8) AS INT) AS batch_no FROM paras),
known AS (SELECT source_hash, min('old:' || text) AS cached_text FROM items WHERE job_id % 3 = 0 GROUP BY source_hash),
hits AS (SELECT i.*, cached_text, text <> '' AND (cached_text IS NOT NULL OR batch_no > min(batch_no) OVER (PARTITION BY job_id, i.source_hash)) AS cached FROM items i LEFT JOIN known k ON i.source_hash = k.source_hash)"""


def source_hash(spark: SparkSession, d: str) -> DataFrame:
    return E.with_hash(items(spark, d)).select("job_id", "id", "source_hash")


def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    return E.lookup(E.with_hash(items(spark, d)), cache(spark, d)).select("job_id", "id", "cached_text")


def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return E.number_batches(items(spark, d), ["para_idx"]).select("job_id", "id", "batch_no")


def cached_attribution(spark: SparkSession, d: str) -> DataFrame:
    known = E.lookup(E.number_batches(E.with_hash(items(spark, d)), ["para_idx"]), cache(spark, d))
    return E.attribute_hits(known).select("job_id", "id", "batch_no", "cached")


def translate_batches(spark: SparkSession, d: str) -> DataFrame:
    done = E.translate(*job(spark, d), EchoProvider, ["para_idx"])
    return done.select("job_id", "id", "batch_no", "cached", "translation", "error", "status", "message")


def cache_writes(spark: SparkSession, d: str) -> DataFrame:
    return E.cache_rows(E.translate(*job(spark, d), EchoProvider, ["para_idx"])).select("id", "source_hash", "translated_text")


def parse_batch_response(spark: SparkSession, d: str) -> DataFrame:
    """Replies of every fourth turn are fenced, of every fifth broken."""
    turns = X.table(spark, d, "conversations")
    body = F.to_json(F.array(F.struct(F.col("turn").cast("string").alias("id"), F.col("text").alias("translation")), F.struct(F.lit("extra").alias("id"), F.col("role").alias("translation"))))
    reply = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 5 == 3, F.lit("no json")).otherwise(body)
    replies = turns.select("conv_id", F.col("turn").cast("string").alias("want"), reply.alias("reply"))
    parsed = E.parse_replies(replies)
    wanted = turns.select("conv_id", F.col("turn").cast("string").alias("id"))
    return E.associate(wanted, parsed.select("conv_id", "id", "pos", "translation"), ["conv_id", "id"]).select("conv_id", "id", "translation", "error")


def translation_status(spark: SparkSession, d: str) -> DataFrame:
    turns = X.table(spark, d, "conversations")
    rows = turns.select("conv_id", "turn", F.when(F.length("text") % 5 == 0, "").otherwise(F.col("text")).alias("translation"), F.when(F.length("text") % 7 == 0, F.repeat(F.col("role"), 200)).alias("error"))
    return E.with_status(rows).select("conv_id", "turn", "status", "message")


def glossary(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("text", " ")
    return X.table(spark, d, "benchmark").select((F.col("item_id") % 5).alias("book_id"), F.get(words, F.lit(0)).alias("term"), F.coalesce(F.get(words, F.lit(1)), F.lit("")).alias("translation")).distinct()


def glossary_prompt(spark: SparkSession, d: str) -> DataFrame:
    terms = E.glossary_lines(glossary(spark, d))
    books = X.table(spark, d, "documents").select(F.col("doc_id").alias("book_id"), F.col("text").alias("context"))
    joined = books.withColumn("group_id", F.col("book_id") % 7).join(terms.withColumnRenamed("book_id", "group_id"), "group_id", "left")
    empty = F.expr("cast(array() as array<string>)")
    return joined.select("book_id", E.build_prompt(F.lit("Translate."), F.coalesce("terms", empty), F.col("context")).alias("prompt"))


def _updates(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.length("event_type") % 3 == 0, "failed").when(F.length("event_type") % 3 == 1, "completed").otherwise("pending")
    return X.table(spark, d, "events").select(F.col("user_id").alias("job_id"), state.alias("status"), "ts", "event_id")


UPDATES_SQL = "updates AS (SELECT user_id AS job_id, CASE length(event_type) % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'pending' END AS status, ts, event_id FROM events)"
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending"


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return E.status_counts(_updates(spark, d), ["job_id"])


def job_rollup(spark: SparkSession, d: str) -> DataFrame:
    return E.status_counts(_updates(spark, d), ["job_id"]).withColumn("job_status", E.job_status())


def chapter_rollup(spark: SparkSession, d: str) -> DataFrame:
    days = _updates(spark, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return E.status_counts(days, ["job_id", "day"]).withColumn("chapter_status", E.chapter_status())


def _old_new(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """New paragraphs from pages of four lines, old ones from pages of five; every second old one is translated."""
    new = P.merge_paragraphs(P.mark_breaks(X.body_lines(spark, d, 5, dealt=True))).select("book_id", F.col("para_idx").alias("new_id"), "page_number", "text")
    old = P.merge_paragraphs(P.mark_breaks(X.body_lines(spark, d, dealt=True))).select("book_id", F.col("para_idx").alias("old_id"), F.col("para_idx").alias("old_order"), "page_number", F.col("text").alias("old_text"), F.when(F.col("para_idx") % 2 == 0, F.concat(F.lit("zh:"), F.col("text"))).otherwise("").alias("translation"))
    return new, old


def match_candidates(spark: SparkSession, d: str) -> DataFrame:
    new, old = _old_new(spark, d)
    return M.candidates(new, old).groupBy("book_id", "new_id").agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(F.col("tier") == 0).alias("n_close"), F.min("old_id").alias("first_old"), F.max("old_id").alias("last_old"))


def match_translation(spark: SparkSession, d: str) -> DataFrame:
    return M.best_matches(*_old_new(spark, d))


def match_equal_texts(spark: SparkSession, d: str) -> DataFrame:
    """New paragraphs with candidates of equal text, and which of them counts."""
    new, old = _old_new(spark, d)
    pairs = M.prepared_pairs(new, old)
    return M.equal_matches(pairs)


def match_statistics(spark: SparkSession, d: str) -> DataFrame:
    return M.match_statistics(M.best_similarities(*_old_new(spark, d)))


class PromptEcho:
    """Answers every item with the prompt it came with."""

    def one(self, prompt: str, text: str) -> str:
        return prompt

    def batch(self, prompt: str, items: list[tuple[str, str]]) -> str:
        return json.dumps([{"id": i, "translation": prompt} for i, _ in items])


def book_terms(spark: SparkSession, d: str) -> DataFrame:
    """A glossary for each language: the first two words of every benchmark text."""
    words = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    items = X.table(spark, d, "benchmark").select(words.alias("w")).where(F.size("w") > 0)
    one = items.select(F.get("w", F.lit(0)).alias("term"), F.lit("one").alias("translation"))
    two = items.where(F.size("w") > 1).select(F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1))).alias("term"), F.lit("two").alias("translation"))
    return one.unionByName(two).distinct().withColumn("kind", F.lit(0))


def translate_with_glossary(spark: SparkSession, d: str) -> DataFrame:
    """The prompt that each item's batch was sent with: the terms in it, and the known translation before it."""
    own, known = job(spark, d)
    done = E.translate(own.withColumn("kind", F.lit(0)), known, PromptEcho, ["para_idx"], "Translate.", book_terms(spark, d), "kind")
    return done.where("NOT cached").select("job_id", "id", "batch_no", "translation", "status")


def job_throughput(spark: SparkSession, d: str) -> DataFrame:
    """Events as paragraphs done: sessions of each user with their rates and share of cache hits."""
    done = X.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), F.length("props").alias("n_chars"), (F.col("event_type") == "view").alias("cached"))
    rates = E.throughput(done, "12 hours")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    rounded = [F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("paragraphs_per_second", "chars_per_second", "hit_ratio")]
    return rates.select("job_id", text("started_at"), text("ended_at"), "paragraphs", "chars", *rounded)


QUERIES = {
    "translate_with_glossary": translate_with_glossary, "job_throughput": job_throughput,
    "source_hash": source_hash, "cache_lookup": cache_lookup, "batch_numbers": batch_numbers, "cached_attribution": cached_attribution, "translate_batches": translate_batches, "cache_writes": cache_writes,
    "parse_batch_response": parse_batch_response, "translation_status": translation_status, "glossary_prompt": glossary_prompt, "status_counts": status_counts, "job_rollup": job_rollup, "chapter_rollup": chapter_rollup,
    "match_candidates": match_candidates, "match_translation": match_translation, "match_equal_texts": match_equal_texts, "match_statistics": match_statistics,
}

_RESULTS = ITEMS_SQL + """,
asked AS (SELECT *, CASE WHEN length(text) % 13 = 0 OR length(text) % 17 = 0 THEN NULL ELSE 'zh:' || lower(text) END AS answer FROM hits WHERE NOT cached AND text <> ''),
earlier AS (SELECT job_id, source_hash, min(answer) AS earlier FROM asked WHERE answer IS NOT NULL GROUP BY ALL),
results AS (SELECT h.job_id, h.id, h.batch_no, h.source_hash, h.cached,
    CASE WHEN h.text = '' THEN '' WHEN h.cached THEN coalesce(h.cached_text, earlier, '') ELSE coalesce(a.answer, '') END AS translation,
    CASE WHEN h.text <> '' AND NOT h.cached AND a.answer IS NULL THEN 'missing translation' END AS error
  FROM hits h LEFT JOIN asked a ON h.id = a.id LEFT JOIN earlier e ON h.job_id = e.job_id AND h.source_hash = e.source_hash),
final AS (SELECT *, CASE WHEN error IS NULL AND translation <> '' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN error IS NULL AND translation <> '' THEN '' ELSE coalesce(error, 'empty translation') END AS message FROM results)"""
_CANDIDATES = (
    "WITH " + X.BODY_SQL.replace("k // 4", "k // 5").replace("k % 4 ", "k % 5 ").replace("(k % 4)", "(k % 5)") + X.BREAKS_SQL.replace("{source}", "body") + ", new AS (SELECT * FROM paras)"
)
_OLD = X.BODY_SQL.replace("body AS", "body2 AS") + X.BREAKS_SQL.replace("{source}", "body2").replace("gaps", "gaps2").replace("marked", "marked2").replace("paras AS", "paras2 AS")

_NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'), '[-‐‑]', '', 'g'), '[^\p{{L}}\p{{N}}\p{{Mn}}\p{{Mc}}\p{{Pc}}\s]', '', 'g'), '^\s+|\s+$', '', 'g')"""

ORACLES = {
    "source_hash": ITEMS_SQL + " SELECT job_id, id, source_hash FROM items",
    "cache_lookup": ITEMS_SQL + " SELECT job_id, id, cached_text FROM hits",
    "batch_numbers": ITEMS_SQL + " SELECT job_id, id, batch_no FROM items",
    "cached_attribution": ITEMS_SQL + " SELECT job_id, id, batch_no, cached FROM hits",
    "translate_batches": _RESULTS + " SELECT job_id, id, batch_no, cached, translation, error, status, message FROM final",
    "cache_writes": _RESULTS + " SELECT source_hash || '_zh' AS id, source_hash, arg_max(translation, id) AS translated_text FROM final WHERE status = 'completed' AND NOT cached GROUP BY source_hash",
    "parse_batch_response": "SELECT conv_id, CAST(turn AS VARCHAR) AS id, CASE WHEN (turn % 4 <> 0 AND turn % 5 = 3) OR text = '' THEN '' ELSE text END AS translation, CASE WHEN (turn % 4 <> 0 AND turn % 5 = 3) OR text = '' THEN 'missing translation' END AS error FROM conversations",
    "translation_status": """WITH r AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN '' ELSE text END AS t, CASE WHEN length(text) % 7 = 0 THEN repeat(role, 200) END AS e FROM conversations)
SELECT conv_id, turn, CASE WHEN e IS NULL AND t <> '' THEN 'completed' ELSE 'failed' END AS status, CASE WHEN e IS NULL AND t <> '' THEN '' ELSE substr(coalesce(e, 'empty translation'), 1, 500) END AS message FROM r""",
    "glossary_prompt": """WITH g AS (SELECT DISTINCT item_id % 5 AS book_id, string_split(text, ' ')[1] AS term, coalesce(string_split(text, ' ')[2], '') AS translation FROM benchmark),
t AS (SELECT book_id, string_agg(term || ' → ' || translation, chr(10) ORDER BY term, translation) AS terms FROM g GROUP BY book_id)
SELECT doc_id AS book_id, 'Translate.' || CASE WHEN terms IS NOT NULL THEN chr(10) || chr(10) || 'Glossary:' || chr(10) || terms ELSE '' END || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'Context:' || chr(10) || substr(text, 1, 500) ELSE '' END AS prompt
FROM documents LEFT JOIN t ON doc_id % 7 = t.book_id""",
    "status_counts": f"WITH {UPDATES_SQL} SELECT job_id, {_COUNTS} FROM updates GROUP BY job_id",
    "job_rollup": f"WITH {UPDATES_SQL}, c AS (SELECT job_id, {_COUNTS} FROM updates GROUP BY job_id) SELECT *, CASE WHEN failed = total THEN 'failed' WHEN failed = 0 AND completed = total THEN 'completed' ELSE 'partial' END AS job_status FROM c",
    "chapter_rollup": f"WITH {UPDATES_SQL}, c AS (SELECT job_id, strftime(ts, '%Y-%m-%d') AS day, {_COUNTS} FROM updates GROUP BY ALL) SELECT *, CASE WHEN failed > 0 OR pending > 0 THEN 'partial' WHEN completed > 0 THEN 'completed' ELSE 'pending' END AS chapter_status FROM c",
    "match_candidates": _CANDIDATES + ", " + _OLD + """,
pairs AS (SELECT n.book_id, n.para_idx AS new_id, o.para_idx AS old_id, abs(o.page_number - n.page_number) <= 1 AS close FROM new n JOIN paras2 o ON n.book_id = o.book_id AND o.page_number BETWEEN greatest(1, n.page_number - 3) AND n.page_number + 3),
c AS (SELECT *, count(*) FILTER (close) OVER (PARTITION BY book_id, new_id) AS n_close FROM pairs)
SELECT book_id, new_id, count(*) AS n_candidates, any_value(n_close) AS n_close, min(old_id) AS first_old, max(old_id) AS last_old FROM c WHERE close OR n_close < 5 GROUP BY book_id, new_id""",
    "match_equal_texts": _CANDIDATES + ", " + _OLD + """,
pairs AS (SELECT n.book_id, n.para_idx AS new_id, o.para_idx AS old_id, o.page_number AS old_page, n.text AS a, o.text AS b, abs(o.page_number - n.page_number) <= 1 AS close
  FROM new n JOIN paras2 o ON n.book_id = o.book_id AND o.page_number BETWEEN greatest(1, n.page_number - 3) AND n.page_number + 3 WHERE n.text <> '' AND o.text <> ''),
c AS (SELECT *, count(*) FILTER (close) OVER (PARTITION BY book_id, new_id) AS n_close FROM pairs),
e AS (SELECT *, row_number() OVER (PARTITION BY book_id, new_id ORDER BY NOT close, old_page, old_id) AS r FROM c WHERE (close OR n_close < 5) AND """ + _NORM.format("a") + " = " + _NORM.format("b") + """)
SELECT book_id, new_id, old_id, 1.0::DOUBLE AS similarity FROM e WHERE r = 1""",
    "translate_with_glossary": ITEMS_SQL + r""",
ws AS (SELECT regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM benchmark),
terms AS (SELECT DISTINCT w[1] AS term, 'one' AS translation FROM ws WHERE len(w) > 0 UNION SELECT DISTINCT w[1] || ' ' || w[2], 'two' FROM ws WHERE len(w) > 1),
spoken AS (SELECT job_id, batch_no, para_idx, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM items),
grams AS (SELECT job_id, batch_no, w[i] AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM spoken) UNION SELECT job_id, batch_no, w[i] || ' ' || w[i + 1] FROM (SELECT *, unnest(range(1, len(w))) AS i FROM spoken)),
lines AS (SELECT job_id, batch_no, string_agg(term || ' → ' || translation, chr(10) ORDER BY term, translation) AS terms FROM grams JOIN terms ON term = gram GROUP BY ALL),
before AS (SELECT job_id, batch_no, arg_min(prev, para_idx) AS context FROM (SELECT job_id, batch_no, para_idx, coalesce(lag(cached_text) OVER (PARTITION BY job_id ORDER BY para_idx), '') AS prev FROM hits) GROUP BY ALL)
SELECT h.job_id, h.id, h.batch_no, CASE WHEN h.text = '' THEN '' ELSE 'Translate.' || CASE WHEN terms IS NOT NULL THEN chr(10) || chr(10) || 'Glossary:' || chr(10) || terms ELSE '' END
  || CASE WHEN context <> '' THEN chr(10) || chr(10) || 'Context:' || chr(10) || substr(context, 1, 500) ELSE '' END END AS translation, CASE WHEN h.text = '' THEN 'failed' ELSE 'completed' END AS status
FROM hits h LEFT JOIN lines USING (job_id, batch_no) LEFT JOIN before USING (job_id, batch_no) WHERE NOT cached""",
    "job_throughput": """WITH e AS (SELECT user_id AS job_id, ts, length(props) AS n, event_type = 'view' AS cached, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 12 HOUR, TRUE) AS opens FROM events),
s AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts) AS session FROM e),
g AS (SELECT job_id, session, min(ts) AS a, max(ts) AS b, count(*) AS paragraphs, CAST(sum(n) AS BIGINT) AS chars, count(*) FILTER (cached) AS hits FROM s GROUP BY job_id, session)
SELECT job_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS started_at, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS ended_at, paragraphs, chars,
  CASE WHEN b > a THEN round(paragraphs / ((epoch_us(b) - epoch_us(a)) / 1e6), 6) ELSE -1.0 END AS paragraphs_per_second, CASE WHEN b > a THEN round(chars / ((epoch_us(b) - epoch_us(a)) / 1e6), 6) ELSE -1.0 END AS chars_per_second, round(hits / paragraphs, 6) AS hit_ratio FROM g""",
}
