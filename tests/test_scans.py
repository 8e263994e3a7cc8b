"""State machines over logs: the scan equals one command after another, at any size of parts and blocks."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliomill.operators import scans as S
from foliomill.sources.scratch import saved
from foliomill.streaming.control import run_until

COMMANDS = [*S.CHAPTER_JOB.moves, "unheard-of", None]


def plain(rows, machine):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    out = []
    for log in by.values():
        log.sort(key=lambda r: r[1])
        out += [(*r, *told) for r, told in zip(log, machine.run([r[2] for r in log]))]
    return out


@pytest.mark.parametrize("part_rows,block", [(40, 3), (1000, 7), (100000, 512)])
def test_scan_equals_a_loop(spark, part_rows, block):
    random.seed(part_rows)
    keys = [1] * 6 + [2, 3, None]
    rows = [(random.choice(keys), i, random.choice(COMMANDS)) for i in range(600)]
    random.shuffle(rows)
    log = spark.createDataFrame(rows, "chapter_id int, seq int, command string")
    got = S.judged(log, S.CHAPTER_JOB, ["chapter_id"], ["seq"], part_rows=part_rows, block=block).collect()
    key = lambda r: (r[1], str(r[0]))
    assert sorted(((r.chapter_id, r.seq, r.command, r.state_before, r.state_after, r.code) for r in got), key=key) == sorted(plain(rows, S.CHAPTER_JOB), key=key)


def test_at_most_one_job_is_active(spark):
    random.seed(9)
    commands = [random.choice(list(S.CHAPTER_JOB.moves)) for _ in range(5000)]
    active = 0
    for command, (before, after, code) in zip(commands, S.CHAPTER_JOB.run(commands)):
        if code == 200 and command in ("start", "open", "retry"):
            active += 1
        if code == 200 and command.startswith("finish"):
            active -= 1
        assert active == (after in ("running", "paused")) and (code == 200) == (before != after)
    refused = Counter(code for *_, code in S.CHAPTER_JOB.run(commands))
    assert {200, 204, 404, 409} <= set(refused)


def test_one_hot_key_splits_over_tasks(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(S, "saved", lambda df, folder, name: written.setdefault(name, saved(df, folder, name)))
    log = spark.range(200_000).select(F.lit(7).alias("k"), "id", F.element_at(F.array(*map(F.lit, ["start", "pause", "resume", "finish_partial", "retry"])), (F.hash("id") % 5 + 5).cast("int") % 5 + 1).alias("command"))
    scanned = S.scan_states(log, ["k"], ["id"], S.CHAPTER_JOB.step(F.col("command")), 6, part_rows=20_000)
    parts = [r["count"] for r in written["log"].groupBy("__part").count().collect()]
    assert len(parts) >= 8 and max(parts) < 40_000
    assert written["blocks"].count() >= 200_000 // S.BLOCK_STEPS and written["blocks"].agg(F.max(F.size("steps"))).first()[0] <= S.BLOCK_STEPS
    states = [r for r in scanned.orderBy("id").collect()]
    want = S.CHAPTER_JOB.run([r.command for r in states])
    assert [(S.CHAPTER_JOB.states[r.state_before], S.CHAPTER_JOB.states[r.state_after]) for r in states] == [w[:2] for w in want]


def test_odd_logs(spark):
    log = spark.createDataFrame([(1, 5, "start", "x"), (1, None, "open", "y"), (2, 1, None, None)], "key int, `a.b` int, command string, step string")
    got = sorted((r.key, r["a.b"] is not None, r.command, r.step, r.state_after, r.code) for r in S.judged(log.where("command IS NOT NULL"), S.CHAPTER_JOB, ["key"], ["a.b"]).collect())
    assert got == [(1, False, "open", "y", "running", 200), (1, True, "start", "x", "running", 409)]
    assert S.judged(log.where("key = 2"), S.CHAPTER_JOB, ["key"], ["a.b"]).collect()[0].code == 400
    assert S.judged(log.limit(0), S.CHAPTER_JOB, ["key"], ["a.b"]).count() == 0


def test_streams_stop_between_batches_and_go_on(spark, tmp_path):
    for k in range(4):
        spark.createDataFrame([(k, datetime(2024, 1, 1))], "id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    seen = []

    def start(trigger):
        source = spark.readStream.schema("id int, ts timestamp").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return source.writeStream.foreachBatch(lambda b, e: seen.extend(r.id for r in b.collect())).option("checkpointLocation", str(tmp_path / "check")).trigger(**trigger).start()

    assert run_until(start({"processingTime": "300 milliseconds"}), lambda: bool(seen))
    assert 1 <= len(seen) < 5
    assert not run_until(start({"availableNow": True}), lambda: False)
    assert sorted(seen) == [0, 1, 2, 3]
