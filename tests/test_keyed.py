"""Progress with an end: folds, order, restarts, replays and forgotten states."""

from __future__ import annotations

import json
from collections import namedtuple
from datetime import datetime, timedelta
from pathlib import Path


from foliomill.streaming import keyed as K

Job = namedtuple("Job", "kind total", defaults=[3])
Page = namedtuple("Page", "page_number total_pages status")
SCHEMA = "job_id long, at timestamp, seq long, kind string, total long"
T0 = datetime(2024, 1, 1)


def told(fold, updates, state=None):
    return [(json.loads(text[6:]), last) for _, (text, last) in K.fold_updates(fold, 7, state, updates)[1]]


def test_job_fold():
    kinds = "poll completed start start completed pause pause completed poll resume failed completed poll start".split()
    got = told(K.JobFold(), [Job(k) for k in kinds])
    assert got[0] == ({"error": "job not found"}, False)
    assert [(p["status"], p["completed"], p["failed"], last) for p, last in got[1:]] == [
        ("running", 0, 0, False), ("running", 1, 0, False), ("paused", 1, 0, False), ("paused", 2, 0, False), ("running", 2, 0, False), ("partial", 2, 1, True),
    ]
    ends = [told(K.JobFold(), [Job("start", 1), Job(k)])[-1] for k in ("completed", "failed")]
    assert [(p["status"], last) for p, last in ends] == [("completed", True), ("failed", True)]


def test_page_fold():
    got = told(K.PageFold(), [Page(1, 3, "completed"), Page(1, 3, "completed"), Page(3, 3, "failed"), Page(2, 3, "failed")])
    assert [(p["status"], p["parsed_pages"], p["failed_pages"], p["progress"], last) for p, last in got] == [("parsing", 1, 0, 33.3, False), ("completed", 3, 1, 100.0, True)]


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def stream(spark, folder, **timing):
    updates = K.session(spark, 3).readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(folder))
    return K.frames(updates, "job_id", K.JobFold(), ["at", "seq"], **timing)


def row(job, seq, kind, total=2, hours=0):
    return (job, T0 + timedelta(hours=hours, seconds=seq), seq, kind, total)


def statuses(df):
    return [(r.job_id, r.seq, json.loads(r.frame[6:]).get("status", "unknown"), r.terminal) for r in df.orderBy("job_id", "seq").collect()]


def test_restart_and_replay_give_no_second_end(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    put(spark, source, "a", [row(1, 2, "completed"), row(1, 1, "start"), row(2, 1, "poll"), (None, T0, 9, "start", 1)])
    K.drain(stream(spark, source), out, check)
    put(spark, source, "b", [row(1, 3, "completed"), row(1, 4, "completed"), row(2, 5, "start")])
    first = statuses(K.drain(stream(spark, source), out, check))
    want = [(1, 1, "running", False), (1, 2, "running", False), (1, 3, "completed", True), (2, 1, "unknown", False), (2, 5, "running", False)]
    assert first == want
    # The process dies after the files of the last batch, before it is committed: the batch runs again.
    last = max((p for p in Path(check, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    assert statuses(K.drain(stream(spark, source), out, check)) == want
    put(spark, source, "c", [row(1, 6, "completed"), row(1, 7, "poll"), row(1, 8, "start")])
    assert statuses(K.drain(stream(spark, source), out, check)) == want


def test_a_timer_forgets_what_no_update_reaches(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    timing = {"time": "at", "timeout": timedelta(hours=1), "late": "1 minute"}
    for name, rows in (("a", [row(1, 1, "start")]), ("b", [row(2, 2, "start", hours=5)]), ("c", [row(1, 3, "poll", hours=6), row(2, 4, "completed", hours=6)])):
        put(spark, source, name, rows)
        got = K.drain(stream(spark, source, **timing), out, check)
    # Job 1 was forgotten; job 2 had its last update an hour before and may be either, so only job 1 is judged.
    assert [s for s in statuses(got) if s[0] == 1] == [(1, 1, "running", False), (1, 3, "unknown", False)]


def test_an_empty_stream(spark, tmp_path):
    put(spark, str(tmp_path / "in"), "a", [(None, T0, 1, "start", 1)])
    assert K.drain(stream(spark, str(tmp_path / "in")), str(tmp_path / "o"), str(tmp_path / "c")).count() == 0
