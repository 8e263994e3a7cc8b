"""What the similarity join holds on disk: in rounds, with the same links, and nothing of it afterwards but what the result reads."""

from __future__ import annotations

import os
import random

from llm import models as m

import corpus_pipeline
from foliomill.llm import jaccard_join


def _near_copies() -> list[tuple[int, str]]:
    rng = random.Random(5)
    rows = []
    for group in range(4):
        words = [f"g{group}w{i}" for i in range(60)]
        for _ in range(40):
            text = list(words)
            for at in rng.sample(range(60), rng.choice([0, 1, 1, 2, 3])):
                text[at] = f"x{rng.randrange(8)}"
            rows.append((len(rows), " ".join(text)))
    return rows


def test_rounds_find_the_same_groups_and_leave_little(spark, tmp_path, monkeypatch):
    rows = _near_copies()
    monkeypatch.setattr(jaccard_join, "PAIRS_PER_ROUND", 0.5)
    monkeypatch.setattr(jaccard_join, "ENTRIES_PER_ROUND", 2)
    folder = str(tmp_path / "scratch")
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, folder=folder, large=16)
    left = set(os.listdir(folder))
    assert "compared-1" not in left and not left & {"index", "texts", "compared-0", "apart"}
    assert "found-1" in left and "met-1" in left
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, m.jaccard_groups(rows, 3, 90)[0]))


def test_near_duplicates_exchange_texts_once(spark, tmp_path):
    rows = [(i, text, "en", "a", 1) for i, text in _near_copies()]
    docs = spark.createDataFrame([*rows, *rows[:5]], "doc_id long, text string, lang string, source string, n_chars long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
        plan = kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in m.jaccard_groups(_near_copies(), 5, 80)[0] if i == c)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("Exchange" in line and "doc_id" in line and "text" in line for line in plan.split("\n")) == 0

def test_members_that_share_too_little_are_not_paired(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):  # each copy shares two of its changes with a few others, which is too little for a link
        text = list(words)
        for at in rng.sample(range(0, 120, 4), 4):
            text[at] = f"own{i}-{at}"
        for at in rng.sample(range(2, 120, 12), 2):
            text[at] = f"shared{at}-{rng.randrange(2)}"
        rows.append((i, " ".join(text)))
    rows.append((60, " ".join(words)))
    folder = str(tmp_path / "scratch")
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, folder=folder, large=16)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, m.jaccard_groups(rows, 3, 85)[0]))
    assert spark.read.parquet(f"{folder}/pairs-2").count() < 100
