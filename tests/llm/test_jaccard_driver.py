"""What the similarity join sends through the driver: lists are small on disk and large once exploded."""

from __future__ import annotations

from llm import models as m
from llm.test_jaccard_disk import _near_copies

from foliomill.llm import common, jaccard_join


def test_exploded_lists_are_never_broadcast(spark, tmp_path, monkeypatch):
    plans = {}

    def spy(df, folder, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.saved(df, folder, name)

    monkeypatch.setattr(jaccard_join, "saved", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    rows = _near_copies()
    try:
        found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, folder=str(tmp_path / "scratch"), large=16)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, m.jaccard_groups(rows, 3, 90)[0]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The joins whose both sides are exploded: entries of the index by signature, prefixes of members by head and shingle.
    of_lists = {name: plan for name, plan in plans.items() if name.startswith(("met-", "found-"))}
    assert "met-0" in of_lists and "found-0" in of_lists
    assert not [name for name, plan in of_lists.items() if "Broadcast" in plan]
