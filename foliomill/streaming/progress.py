"""Progress of jobs and pages as streaming aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from foliomill.operators.enrich import cache_rows, job_status, translate, with_hash
from foliomill.operators.store import ingest
from foliomill.sources.tables import Table, TableSet

TERMINAL = ("completed", "failed", "partial")


def job_progress(updates: DataFrame, until: str = "1 hour") -> DataFrame:
    """Counts and status of each job, from updates (job_id, status, ts); works on a stream or a table.

    Status is `running` while anything is pending. State is one row for each job.
    """
    stream = updates.withWatermark("ts", until) if updates.isStreaming else updates
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = stream.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"), count("completed"), count("failed"), count("pending"), F.max("ts").alias("updated_at"))
    return counts.withColumn("status", F.when(F.col("pending") > 0, "running").otherwise(job_status()))


def frames(progress: DataFrame) -> DataFrame:
    """Event frames as JSON, one for each progress row."""
    payload = F.to_json(F.struct("job_id", "status", "total", "completed", "failed"))
    return progress.select("job_id", F.concat(F.lit("data: "), payload, F.lit("\n\n")).alias("frame"), F.col("status").isin(*TERMINAL).alias("terminal"))


def page_progress(pages: DataFrame) -> DataFrame:
    """Parsed and failed pages of each book, from page results (book_id, page_number, status)."""
    return pages.groupBy("book_id").agg(F.max("page_number").alias("parsed_pages"), F.count_if(F.col("status") == "failed").alias("failed_pages"))


def windowed_counts(updates: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Updates by status in tumbling event-time windows; later ones than the watermark are dropped on a stream."""
    stream = updates.withWatermark("ts", late) if updates.isStreaming else updates
    return stream.groupBy(F.window("ts", width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")


def drain_complete(stream: DataFrame, folder: str) -> DataFrame:
    """The result of an aggregating stream over what it has so far: each micro-batch writes the whole result to a folder of its
    own, the last one is read back."""
    epochs: list[int] = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/e{epoch:09d}")
        epochs.append(epoch)

    stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    reader = stream.sparkSession.read.schema(stream.schema)
    return reader.parquet(f"{folder}/result/e{max(epochs):09d}")


def upsert_pages(stream: DataFrame, store: TableSet, table: str, checkpoint: str, version: str | None = None) -> StreamingQuery:
    """Keep the latest result of each key of a stream in a table of a set; each micro-batch is one commit and rewrites only the buckets it touches.

    The commit names the stream's epoch, so a batch that is run again after a failure neither loses nor repeats rows.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        with store.transaction(stream=checkpoint, epoch=epoch) as tx:
            tx.upsert(table, batch, version)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What translate_stream keeps between epochs: one row for each text that was translated.
CACHE = Table("cache", StructType([StructField(c, StringType()) for c in ("source_hash", "translated_text", "status")]), ("source_hash",), 64)


def translate_stream(items: DataFrame, path: str, checkpoint: str, provider, cache: DataFrame, prompt: str = "", rows_order: str = "paragraph_order") -> StreamingQuery:
    """Translate items as they arrive, one micro-batch at a time: results in path/results, one folder for each epoch.

    Stopping the query pauses the job, starting it again from its checkpoint resumes it; how much one micro-batch holds is
    the source's setting. Texts that earlier epochs translated come from a table of their own in path/cache: an epoch reads and rewrites only the
    buckets that its texts fall into, however many epochs there were. An epoch that is run again overwrites its folder, or, if its texts are in the
    cache already, changes nothing.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        store = TableSet(batch.sparkSession, f"{path}/cache", [CACHE])
        with store.transaction(stream=checkpoint, epoch=epoch) as tx:
            if tx.done:
                return
            texts = with_hash(batch).select("source_hash")
            buckets = [r[0] for r in texts.select(store.bucket("cache").alias("b")).distinct().collect()]  # at most CACHE.buckets
            known = cache.select("source_hash", "translated_text", "status").unionByName(tx.read("cache", buckets))
            results = translate(batch, known, provider, [rows_order], prompt).withColumn("epoch", F.lit(epoch).cast("long"))
            folder = f"{path}/results/e{epoch:09d}"
            results.write.mode("overwrite").parquet(folder)
            tx.upsert("cache", cache_rows(batch.sparkSession.read.schema(results.schema).parquet(folder)))

    return items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_stream(files: DataFrame, store: TableSet, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Books of files as they arrive (path, modificationTime, content): supported formats only, one book for each content.

    A file that comes again within `late` is dropped in the stream; one that comes later finds its book in the table, since a book's id is its content's MD5. The table
    needs book_id, title, format, file_path, parse_status and uploaded_at.
    """
    known = files.withColumn("book_id", F.md5("content")).withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["book_id"])

    def write(batch: DataFrame, epoch: int) -> None:
        with store.transaction(stream=checkpoint, epoch=epoch) as tx:
            if not tx.done:
                fresh = ingest(batch).drop("book_id").join(batch.select(F.col("path").alias("file_path"), "book_id"), "file_path")
                tx.upsert(table, fresh.join(tx.read(table).select("book_id"), "book_id", "left_anti"))

    return known.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
