"""Queries over tables that change: upserts, deletes, recovery, schema evolution, and progress as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from foliomill.operators import reader as R
from foliomill.operators import store as T
from foliomill.plans import fixtures as X
from foliomill.plans.enrichment import UPDATES_SQL, _updates
from foliomill.plans.live import stream_of
from foliomill.plans.reading import BOOKS_SQL, books
from foliomill.sources.scratch import shared_folder
from foliomill.streaming import progress as G


def _pages(spark: SparkSession, d: str) -> DataFrame:
    lines = X.body_lines(spark, d)
    return lines.groupBy("book_id", "page_number").agg(F.count(F.lit(1)).alias("n_lines"), F.max("text").alias("raw_text")).withColumn("version", F.lit(1))


def upsert_pages(spark: SparkSession, d: str) -> DataFrame:
    """Even pages of every third book are parsed again, twice; page 1000 is new."""
    old = _pages(spark, d)
    again = old.where("book_id % 3 = 0 AND page_number % 2 = 0")
    new = again.withColumn("version", F.lit(2)).unionByName(again.withColumns({"version": F.lit(3), "raw_text": F.concat(F.lit("again: "), F.col("raw_text"))}))
    added = old.where("page_number = 1").withColumns({"page_number": F.lit(1000), "version": F.lit(2)})
    return T.upsert(old, new.unionByName(added), ["book_id", "page_number"], "version").select("book_id", "page_number", "n_lines", "raw_text", "version")


def upsert_cache(spark: SparkSession, d: str) -> DataFrame:
    docs = X.table(spark, d, "documents")
    old = docs.where("doc_id % 3 <> 0").select(F.md5("text").alias("source_hash"), F.lit("old").alias("translated_text")).distinct()
    new = docs.where("doc_id % 3 = 0 OR doc_id % 2 = 0").groupBy(F.md5("text").alias("source_hash")).agg(F.max("lang").alias("translated_text"))
    return T.upsert(old, new, ["source_hash"])


def _parse_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    pages = _pages(spark, d)
    chapters = pages.select("book_id", (F.floor(F.col("page_number") / 3)).alias("no")).distinct().select("book_id", F.concat_ws("-", F.col("book_id").cast("string"), F.col("no").cast("string")).alias("chapter_id"))
    paragraphs = pages.select(F.concat_ws("-", F.col("book_id").cast("string"), F.floor(F.col("page_number") / 3).cast("string")).alias("chapter_id"), F.concat_ws("/", F.col("book_id").cast("string"), F.col("page_number").cast("string")).alias("paragraph_id"))
    return {"pages": pages.select("book_id", "page_number"), "chapters": chapters, "paragraphs": paragraphs, "fragments": paragraphs.select("paragraph_id"), "translations": paragraphs.select("paragraph_id"), "jobs": chapters.select("chapter_id")}


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """What is left, by table, after the books of one source are deleted but for their pages."""
    gone = X.table(spark, d, "documents").where("source = 'src0' OR doc_id % 4 = 1").select(F.col("doc_id").alias("book_id"))
    left = T.delete_books(_parse_tables(spark, d), gone, keep_pages=True)
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in sorted(left.items())]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def retry_failed(spark: SparkSession, d: str) -> DataFrame:
    rows = _updates(spark, d).withColumn("error_message", F.when(F.col("status") == "failed", "timeout").otherwise(""))
    return T.retry_failed(rows).select("event_id", "job_id", "status", "error_message")


def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    return T.recover_crashed(books(spark, d)).select("book_id", "parse_status")


def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Rows of an older layout beside newer ones."""
    target = StructType([StructField("book_id", LongType()), StructField("lang", StringType()), StructField("page_end", IntegerType())])
    docs = X.table(spark, d, "documents")
    old = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("book_id"), "lang")
    new = docs.where("doc_id % 2 = 1").select(F.floor(F.col("n_chars") / 100).alias("page_end"), "lang", F.col("doc_id").cast("string").alias("book_id"))
    both = T.evolve(old, target).unionByName(T.evolve(new, target))
    return both.withColumn("page_end", F.coalesce("page_end", F.lit(-1)))


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    return G.job_progress(_updates(spark, d)).select("job_id", "total", "completed", "failed", "pending", "status")


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.length("event_type") % 3 == 0, "failed").when(F.length("event_type") % 3 == 1, "completed").otherwise("pending")
    return stream_of(spark, d, "events").select(F.col("user_id").alias("job_id"), state.alias("status"), F.col("ts").cast("timestamp").alias("ts"))


def stream_job_progress(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from a stream over the events."""
    stream = G.job_progress(_event_stream(spark, d), until="100000 hours")
    return G.drain_complete(stream, shared_folder(spark)).select("job_id", "total", "completed", "failed", "pending", "status")


def stream_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    stream = G.windowed_counts(_event_stream(spark, d), "1 day", "100000 hours")
    return G.drain_complete(stream, shared_folder(spark)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n")


def progress_frames(spark: SparkSession, d: str) -> DataFrame:
    return G.frames(G.job_progress(_updates(spark, d)))


def page_progress(spark: SparkSession, d: str) -> DataFrame:
    rows = _pages(spark, d).withColumn("status", F.when(F.col("page_number") % 5 == 0, "failed").otherwise("completed"))
    return G.page_progress(rows)


def job_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Every job as the JSON body of its route, under the names that readers know."""
    jobs = G.job_progress(_updates(spark, d)).withColumnsRenamed({"total": "total_paragraphs", "completed": "completed_paragraphs", "failed": "failed_paragraphs"})
    fields = R.api_fields(jobs)
    return fields.select("job_id", F.to_json(F.struct("job_id", "status", "total", "completed", "failed")).alias("body"))


QUERIES = {
    "job_payloads": job_payloads,
    "upsert_pages": upsert_pages, "upsert_cache": upsert_cache, "cascade_delete": cascade_delete, "retry_failed": retry_failed, "crash_recovery": crash_recovery, "schema_evolution": schema_evolution,
    "job_progress": job_progress, "stream_job_progress": stream_job_progress, "stream_windowed_counts": stream_windowed_counts, "progress_frames": progress_frames, "page_progress": page_progress,
}

_PAGES_SQL = X.BODY_SQL + ", pages_ AS (SELECT book_id, page_number, count(*) AS n_lines, max(text) AS raw_text FROM body GROUP BY ALL)"
_PROGRESS = f"""WITH {UPDATES_SQL}, c AS (SELECT job_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending FROM updates GROUP BY job_id),
p AS (SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN failed = total THEN 'failed' WHEN failed = 0 AND completed = total THEN 'completed' ELSE 'partial' END AS status FROM c)"""

ORACLES = {
    "upsert_pages": f"""WITH {_PAGES_SQL} SELECT book_id, page_number, n_lines, CASE WHEN book_id % 3 = 0 AND page_number % 2 = 0 THEN 'again: ' || raw_text ELSE raw_text END AS raw_text, CASE WHEN book_id % 3 = 0 AND page_number % 2 = 0 THEN 3 ELSE 1 END AS version FROM pages_
UNION ALL SELECT book_id, 1000, n_lines, raw_text, 2 FROM pages_ WHERE page_number = 1""",
    "upsert_cache": "WITH n AS (SELECT md5(text) AS source_hash, max(lang) AS translated_text FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0 GROUP BY ALL), o AS (SELECT DISTINCT md5(text) AS source_hash FROM documents WHERE doc_id % 3 <> 0) SELECT * FROM n UNION ALL SELECT source_hash, 'old' FROM o WHERE source_hash NOT IN (SELECT source_hash FROM n)",
    "cascade_delete": f"""WITH {_PAGES_SQL}, kept AS (SELECT doc_id AS book_id FROM documents WHERE NOT (source = 'src0' OR doc_id % 4 = 1)), live AS (SELECT * FROM pages_ WHERE book_id IN (SELECT book_id FROM kept)),
c AS (SELECT count(DISTINCT (book_id, page_number // 3)) AS n FROM live), p AS (SELECT count(*) AS n FROM live)
SELECT 'chapters' AS table_name, n AS n_rows FROM c UNION ALL SELECT 'jobs', n FROM c UNION ALL SELECT 'paragraphs', n FROM p UNION ALL SELECT 'fragments', n FROM p UNION ALL SELECT 'translations', n FROM p UNION ALL SELECT 'pages', count(*) FROM pages_""",
    "retry_failed": f"WITH {UPDATES_SQL} SELECT event_id, job_id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status, '' AS error_message FROM updates",
    "crash_recovery": f"WITH {BOOKS_SQL} SELECT book_id, CASE WHEN parse_status IN ('parsing', 'assembling') THEN 'failed' ELSE parse_status END AS parse_status FROM books",
    "schema_evolution": "SELECT doc_id AS book_id, lang, CASE WHEN doc_id % 2 = 1 THEN CAST(floor(n_chars / 100.0) AS INT) ELSE -1 END AS page_end FROM documents",
    "job_progress": _PROGRESS + " SELECT * FROM p",
    "stream_job_progress": _PROGRESS + " SELECT * FROM p",
    "stream_windowed_counts": f"WITH {UPDATES_SQL} SELECT strftime(ts, '%Y-%m-%d') AS day, status, count(*) AS n FROM updates GROUP BY ALL",
    "progress_frames": _PROGRESS + """ SELECT job_id, 'data: {"job_id":' || job_id || ',"status":"' || status || '","total":' || total || ',"completed":' || completed || ',"failed":' || failed || '}' || chr(10) || chr(10) AS frame, status <> 'running' AS terminal FROM p""",
    "page_progress": f"WITH {_PAGES_SQL} SELECT book_id, max(page_number) AS parsed_pages, count(*) FILTER (page_number % 5 = 0) AS failed_pages FROM pages_ GROUP BY book_id",
    "job_payloads": _PROGRESS + """ SELECT job_id, '{"job_id":' || job_id || ',"status":"' || status || '","total":' || total || ',"completed":' || completed || ',"failed":' || failed || '}' AS body FROM p""",
}
