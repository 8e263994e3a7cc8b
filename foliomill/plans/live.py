"""Live progress and job control: streams with keyed state, and logs of commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.operators import scans as S
from foliomill.plans import fixtures as X
from foliomill.sources.scratch import shared_folder
from foliomill.streaming import keyed as K


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream. Streams read folders: the table's own, or - for a table of one file - a pattern that only this file matches."""
    schema = X.table(spark, d, name).schema
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
    is_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile()
    pattern = f"{d}/{name[:-1]}[{name[-1]}].parquet" if is_file else f"{d}/{name}.parquet"
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(pattern)


def job_updates(events: DataFrame) -> DataFrame:
    """A user's events as updates of one job of 5 to 34 paragraphs."""
    event = F.col("event_type")
    pause = F.when(F.col("event_id") % 2 == 0, "pause").otherwise("resume")
    kind = F.when(event == "signup", "start").when(event == "click", "completed").when(event == "error", "failed").when(event == "view", "poll").otherwise(pause)
    return events.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("kind"), (5 + F.col("event_id") % 30).alias("total"))


UPDATES_SQL = """updates AS (SELECT user_id AS job_id, ts, event_id, 5 + event_id % 30 AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r,
  CASE event_type WHEN 'signup' THEN 'start' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'poll' ELSE CASE WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END END AS kind
  FROM events WHERE user_id IS NOT NULL)"""


def stream_job_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of every job from a stream of its updates: a frame on each change, none after the last."""
    own, folder = K.session(spark), shared_folder(spark)
    stream = K.frames(job_updates(stream_of(own, d, "events")), "job_id", K.JobFold(), ["ts", "event_id"])
    return K.drain(stream, f"{folder}/frames", f"{folder}/checkpoint").select("job_id", "event_id", "frame", "terminal")


def page_results(docs: DataFrame) -> DataFrame:
    """One row for each page of a book that has a line, every fifth page failed; works on a stream."""
    filled = F.filter(F.split("text", "\n"), lambda line: F.trim(line) != "")
    numbers = F.transform(F.split("text", "\n"), lambda line, k: F.when(F.trim(line) != "", F.floor(k / X.PAGE_LINES).cast("int") + 1))
    pages = docs.where(F.size(filled) > 0).select(F.col("doc_id").alias("book_id"), F.array_distinct(F.array_compact(numbers)).alias("pages"))
    rows = pages.select("book_id", F.array_max("pages").alias("total_pages"), F.explode("pages").alias("page_number"))
    return rows.withColumn("status", F.when(F.col("page_number") % 5 == 0, "failed").otherwise("completed"))


def stream_page_progress(spark: SparkSession, d: str) -> DataFrame:
    """Progress of every book after each of its pages, from a stream of documents."""
    own, folder = K.session(spark), shared_folder(spark)
    stream = K.frames(page_results(stream_of(own, d, "documents")), "book_id", K.PageFold(), ["page_number"])
    return K.drain(stream, f"{folder}/frames", f"{folder}/checkpoint")


def commands(spark: SparkSession, d: str) -> DataFrame:
    """A user's events as commands about one chapter."""
    event, n = F.col("event_type"), F.col("event_id")
    ended = F.element_at(F.array(*[F.lit(f"finish_{s}") for s in ("completed", "partial", "failed")]), (n % 3 + 1).cast("int"))
    command = F.when(event == "signup", "start").when(event == "view", "open").when(event == "error", ended).when(event == "click", F.when(n % 2 == 0, "pause").otherwise("resume"))
    return X.table(spark, d, "events").select(F.col("user_id").alias("chapter_id"), "ts", "event_id", command.otherwise(F.when(n % 7 == 0, "unheard-of").otherwise("retry")).alias("command"))


COMMANDS_SQL = """commands AS (SELECT user_id AS chapter_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r, CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'open'
  WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'finish_completed' WHEN 1 THEN 'finish_partial' ELSE 'finish_failed' END WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'pause' ELSE 'resume' END
  ELSE CASE WHEN event_id % 7 = 0 THEN 'unheard-of' ELSE 'retry' END END AS command FROM events)"""


def job_commands(spark: SparkSession, d: str) -> DataFrame:
    """Every command with the state of its chapter's job before and after, and whether it was refused."""
    done = S.judged(commands(spark, d), S.CHAPTER_JOB, ["chapter_id"], ["ts", "event_id"])
    return done.select("chapter_id", "event_id", "command", "state_before", "state_after", "code", "accepted")


def book_commands(spark: SparkSession, d: str) -> DataFrame:
    """Events as commands about the parsing of books: a second parse is refused while one goes on."""
    event = F.col("event_type")
    command = F.when(event == "signup", "parse").when(event == "click", "pages_done").when(event == "view", "assembled").when((event == "error") | (F.col("event_id") % 11 > 0), "crash").otherwise("delete")
    log = X.table(spark, d, "events").select((F.col("user_id") % 97).alias("book_id"), "ts", "event_id", command.alias("command"))
    done = S.judged(log, S.BOOK_PARSE, ["book_id"], ["ts", "event_id"])
    return done.select("book_id", "event_id", "command", "state_before", "state_after", "code")


QUERIES = {"stream_job_frames": stream_job_frames, "stream_page_progress": stream_page_progress, "job_commands": job_commands, "book_commands": book_commands}

ORACLES = {
    "stream_job_frames": f"""WITH {UPDATES_SQL},
begun AS (SELECT *, min(r) FILTER (kind = 'start') OVER (PARTITION BY job_id) AS r0 FROM updates),
sized AS (SELECT *, max(CASE WHEN r = r0 THEN total END) OVER (PARTITION BY job_id) AS size,
  count(*) FILTER (r > r0 AND kind = 'completed') OVER w AS completed, count(*) FILTER (r > r0 AND kind = 'failed') OVER w AS failed,
  coalesce(last_value(CASE WHEN r >= r0 AND kind IN ('pause', 'resume') THEN kind END IGNORE NULLS) OVER w = 'pause', FALSE) AS paused
  FROM begun WINDOW w AS (PARTITION BY job_id ORDER BY r ROWS UNBOUNDED PRECEDING)),
live AS (SELECT *, min(r) FILTER (completed + failed >= size) OVER (PARTITION BY job_id) AS r1 FROM sized WHERE r >= r0),
told AS (SELECT *, CASE WHEN completed + failed < size THEN CASE WHEN paused THEN 'paused' ELSE 'running' END WHEN failed = size THEN 'failed' WHEN failed > 0 THEN 'partial' ELSE 'completed' END AS status
  FROM live WHERE r1 IS NULL OR r <= r1),
changed AS (SELECT *, (status, completed, failed) AS now, lag((status, completed, failed)) OVER (PARTITION BY job_id ORDER BY r) AS before FROM told)
SELECT job_id, event_id, 'data: {{"job_id":' || job_id || ',"status":"' || status || '","total":' || size || ',"completed":' || completed || ',"failed":' || failed || '}}' || chr(10) || chr(10) AS frame, completed + failed >= size AS terminal
FROM changed WHERE before IS NULL OR now <> before
UNION ALL SELECT job_id, event_id, 'data: {{"error":"job not found"}}' || chr(10) || chr(10), FALSE FROM begun WHERE kind = 'poll' AND (r0 IS NULL OR r < r0)""",
    "stream_page_progress": f"""WITH {X.BODY_SQL}, pages AS (SELECT DISTINCT book_id, page_number FROM body),
told AS (SELECT *, max(page_number) OVER (PARTITION BY book_id) AS total, count(*) FILTER (page_number % 5 = 0) OVER (PARTITION BY book_id ORDER BY page_number) AS failed FROM pages)
SELECT book_id, page_number, 'data: {{"book_id":' || book_id || ',"status":"' || CASE WHEN page_number < total THEN 'parsing' WHEN failed = total THEN 'failed' ELSE 'completed' END || '","total_pages":' || total
  || ',"parsed_pages":' || page_number || ',"failed_pages":' || failed || ',"progress":' || format('{{:.1f}}', page_number / total * 100) || '}}' || chr(10) || chr(10) AS frame, page_number = total AS terminal FROM told""",
    "job_commands": f"""WITH RECURSIVE {COMMANDS_SQL},
walk AS (
  SELECT chapter_id, 0 AS r, CAST(NULL AS BIGINT) AS event_id, '' AS command, 'none' AS state_before, 'none' AS state_after, 0 AS code FROM (SELECT DISTINCT chapter_id FROM commands)
  UNION ALL
  SELECT c.chapter_id, c.r, c.event_id, c.command, s,
    CASE WHEN c.command IN ('start', 'open') AND s = 'none' THEN 'running' WHEN c.command = 'pause' AND s = 'running' THEN 'paused' WHEN c.command = 'resume' AND s = 'paused' THEN 'running'
      WHEN c.command = 'retry' AND s IN ('partial', 'failed') THEN 'running' WHEN c.command LIKE 'finish_%' AND s = 'running' THEN substr(c.command, 8) ELSE s END,
    CASE c.command
      WHEN 'start' THEN CASE WHEN s = 'none' THEN 200 WHEN s IN ('running', 'paused') THEN 409 ELSE 400 END
      WHEN 'open' THEN CASE WHEN s = 'none' THEN 200 ELSE 204 END
      WHEN 'pause' THEN CASE s WHEN 'running' THEN 200 WHEN 'paused' THEN 204 ELSE 404 END
      WHEN 'resume' THEN CASE s WHEN 'paused' THEN 200 WHEN 'running' THEN 204 ELSE 404 END
      WHEN 'retry' THEN CASE WHEN s IN ('partial', 'failed') THEN 200 WHEN s = 'completed' THEN 204 WHEN s = 'none' THEN 404 ELSE 409 END
      WHEN 'unheard-of' THEN 400
      ELSE CASE WHEN s = 'running' THEN 200 ELSE 409 END END
  FROM (SELECT chapter_id, r, state_after AS s FROM walk) w JOIN commands c ON c.chapter_id IS NOT DISTINCT FROM w.chapter_id AND c.r = w.r + 1)
SELECT chapter_id, event_id, command, state_before, state_after, code, code = 200 AS accepted FROM walk WHERE r > 0""",
    "book_commands": """WITH RECURSIVE commands AS (SELECT user_id % 97 AS book_id, event_id, row_number() OVER (PARTITION BY user_id % 97 ORDER BY ts, event_id) AS r,
  CASE event_type WHEN 'signup' THEN 'parse' WHEN 'click' THEN 'pages_done' WHEN 'view' THEN 'assembled' WHEN 'error' THEN 'crash' ELSE CASE WHEN event_id % 11 > 0 THEN 'crash' ELSE 'delete' END END AS command FROM events),
walk AS (
  SELECT book_id, 0 AS r, CAST(NULL AS BIGINT) AS event_id, '' AS command, 'pending' AS state_before, 'pending' AS state_after, 0 AS code FROM (SELECT DISTINCT book_id FROM commands)
  UNION ALL
  SELECT c.book_id, c.r, c.event_id, c.command, s,
    CASE WHEN s = 'deleted' THEN s WHEN c.command = 'delete' THEN 'deleted' WHEN c.command = 'parse' AND s NOT IN ('parsing', 'assembling') THEN 'parsing' WHEN c.command = 'pages_done' AND s = 'parsing' THEN 'assembling'
      WHEN c.command = 'assembled' AND s = 'assembling' THEN 'completed' WHEN c.command = 'crash' AND s IN ('parsing', 'assembling') THEN 'failed' ELSE s END,
    CASE c.command WHEN 'parse' THEN CASE s WHEN 'parsing' THEN 409 WHEN 'assembling' THEN 409 WHEN 'deleted' THEN 404 ELSE 200 END WHEN 'pages_done' THEN CASE s WHEN 'parsing' THEN 200 ELSE 409 END
      WHEN 'assembled' THEN CASE s WHEN 'assembling' THEN 200 ELSE 409 END WHEN 'crash' THEN CASE WHEN s IN ('parsing', 'assembling') THEN 200 ELSE 204 END ELSE CASE s WHEN 'deleted' THEN 404 ELSE 200 END END
  FROM (SELECT book_id, r, state_after AS s FROM walk) w JOIN commands c ON c.book_id IS NOT DISTINCT FROM w.book_id AND c.r = w.r + 1)
SELECT book_id, event_id, command, state_before, state_after, code FROM walk WHERE r > 0""",
}
