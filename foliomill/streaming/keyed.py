"""Live progress with an end: one state for each job or book, a frame on each change, none after the terminal one.

A fold says what one update does to the state of its key and which frame it gives. It is plain Python, so the same fold runs in a
stream, in a test and over a list. The stream keeps the states (`transformWithState`, RocksDB): a micro-batch touches only the keys in it,
an ended key stays marked as ended, and a timer removes a state that no update has reached for so long. Frames go to files through Spark's own sink, which
commits each micro-batch once: a batch that is run again after a failure gives no second frame.

The updates of one key in one micro-batch are put in order before they are folded, so they must fit into a task: eight bytes for each column and
row. The source's setting for a micro-batch (`maxFilesPerTrigger`, `maxBytesPerTrigger`) bounds them. Across micro-batches order is that of arrival.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from datetime import timedelta
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

Frame = tuple[str, bool]


class Fold(Protocol):
    """What updates do to the state of one key."""

    #: The state's fields, as a schema string; the last one is `ended`.
    state: str
    #: Columns of an update, besides its key, that `step` reads.
    columns: tuple[str, ...]

    def step(self, key: Any, state: tuple | None, update: Any) -> tuple[tuple | None, dict | None, bool]:
        """(state afterwards, payload of a frame or None, whether that frame is the last)."""
        ...


class JobFold:
    """Translation jobs: updates have kind (start, completed, failed, pause, resume, poll) and total (for start).

    A job begins with its first start and ends when as many paragraphs completed or failed as it has; `paused` is no end. Polls of an id
    without a job are told so; other updates of such an id, and all that follow the end, change nothing.
    """

    state = "total long, completed long, failed long, paused boolean, ended boolean"
    columns = ("kind", "total")

    def step(self, key, state, update):
        if state is None:
            if update.kind == "poll":
                return None, {"error": "job not found"}, False
            if update.kind != "start":
                return None, None, False
            after = (int(update.total), 0, 0, False, False)
            return after, self.payload(key, after), False
        total, completed, failed, paused, ended = state
        if ended:
            return state, None, False
        completed += update.kind == "completed"
        failed += update.kind == "failed"
        paused = (paused or update.kind == "pause") and update.kind != "resume"
        after = (total, completed, failed, paused, completed + failed >= total)
        return after, None if after == state else self.payload(key, after), after[-1]

    @staticmethod
    def payload(key, state) -> dict:
        total, completed, failed, paused, ended = state
        status = "paused" if paused else "running"
        if ended:
            status = "failed" if failed == total else "partial" if failed else "completed"
        return {"job_id": key, "status": status, "total": total, "completed": completed, "failed": failed}


class PageFold:
    """Books that are parsed: updates have page_number, total_pages and status (completed or failed)."""

    state = "parsed long, failed long, ended boolean"
    columns = ("page_number", "total_pages", "status")

    def step(self, key, state, update):
        parsed, failed, ended = state or (0, 0, False)
        if ended:
            return state, None, False
        total = int(update.total_pages)
        parsed = max(parsed, int(update.page_number))
        failed += update.status == "failed"
        after = (parsed, failed, parsed >= total)
        status = "parsing" if not after[-1] else "failed" if failed == total else "completed"
        payload = {"book_id": key, "status": status, "total_pages": total, "parsed_pages": parsed, "failed_pages": failed, "progress": round(parsed / total * 100, 1) if total else 0.0}
        return after, None if after == state else payload, after[-1]


def sse(payload: dict) -> str:
    return f"data: {json.dumps(payload, ensure_ascii=False, separators=(',', ':'))}\n\n"


def fold_updates(fold: Fold, key: Any, state: tuple | None, updates: Iterable) -> tuple[tuple | None, list[tuple[Any, Frame]]]:
    """Fold updates in their order; the state afterwards and (update, frame) for each frame."""
    out = []
    for update in updates:
        state, payload, last = fold.step(key, state, update)
        if payload is not None:
            out.append((update, (sse(payload), last)))
    return state, out


class _Processor(StatefulProcessor):
    def __init__(self, fold: Fold, order: list[str], time: str | None, timeout_ms: int, names: list[str]) -> None:
        self.fold, self.order, self.time, self.timeout_ms, self.names = fold, order, time, timeout_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", self.fold.state)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        updates = sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        known = self.progress.get() if self.progress.exists() else None
        before = tuple(known) if known is not None else None
        after, frames = fold_updates(self.fold, key[0], before, updates)
        if after is not None and after != before:
            self.progress.update(after)
        if after is not None and self.time:
            for due in self.handle.listTimers():
                self.handle.deleteTimer(due)
            last = max(u[self.time] for u in updates if u[self.time] is not None)
            self.handle.registerTimer(int(last.timestamp() * 1000) + self.timeout_ms)
        for u, f in frames:
            yield Row(**dict(zip(self.names, (key[0], *(u[c] for c in self.order), *f))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.progress.clear()
        return iter(())

    def close(self) -> None:
        pass


def session(spark: SparkSession, stores: int = 16) -> SparkSession:
    """A session of its own for streams with keyed state: the state store and the number of stores are settings of a session.

    A store is opened for each shuffle partition and stays with the checkpoint for good. A state is some thirty bytes, so a store holds millions of
    keys, while an empty one takes megabytes of disk: take as many stores as the keys call for, not as many as shuffles have partitions.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", str(stores))
    return own


def frames(updates: DataFrame, key: str, fold: Fold, order: list[str], time: str | None = None, timeout: timedelta = timedelta(days=1), late: str = "1 hour") -> DataFrame:
    """Frames of a stream of updates: key, the order columns of the update that caused it, frame, terminal.

    With `time`, an event-time column among `order`, a state is forgotten when the watermark (`late` behind the newest update) passes its last update by `timeout`;
    without it, states stay. Updates with a null key are dropped: they belong to nobody.
    """
    columns = list(dict.fromkeys([key, *order, *fold.columns]))
    rows = updates.where(f"`{key}` IS NOT NULL").select(*columns)
    if time:
        rows = rows.withWatermark(time, late)
    out = StructType([*(StructField(c, rows.schema[c].dataType) for c in (key, *order)), StructField("frame", StringType()), StructField("terminal", rows.selectExpr("true AS t").schema["t"].dataType)])
    processor = _Processor(fold, order, time, int(timeout.total_seconds() * 1000), out.names)
    return rows.groupBy(key).transformWithState(processor, out, "Append", "EventTime" if time else "None")


def drain(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Write what the stream has so far to path, exactly once over restarts from the checkpoint, and read it back."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
