"""What the similarity join exchanges: packed index entries once, and members of heads rather than each entry of their prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from llm import models as m
from llm.test_jaccard_disk import _near_copies

from foliomill.llm import common, jaccard_join


def test_prefixes_are_exploded_where_their_members_are(spark, tmp_path, monkeypatch):
    plans = {}

    def spy(df, folder, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return common.saved(df, folder, name)

    monkeypatch.setattr(jaccard_join, "saved", spy)
    monkeypatch.setattr(jaccard_join, "LOT", 2)  # heads in several lots
    rows = _near_copies()
    found = jaccard_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, folder=str(tmp_path / "scratch"), large=16)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, m.jaccard_groups(rows, 3, 90)[0]))
    assert "index" not in plans and "met-0" in plans and "found-0" in plans
    assert not [name for name, plan in plans.items() if "hashpartitioning(sig" in plan or "hashpartitioning(key" in plan]


def test_packed_entries_meet_as_rows_would():
    rng = np.random.default_rng(1)
    signatures = rng.integers(0, 40, 400).astype(np.uint64) << np.uint64(20)
    codes = rng.integers(0, 12, 400).astype(np.uint64) | (rng.integers(0, 2, 400).astype(np.uint64) * np.uint64(jaccard_join.GONE))
    want = set()
    for s in set(signatures.tolist()):
        own = codes[signatures == s].tolist()
        if min(own) < jaccard_join.GONE:
            want |= {(min(own), c % jaccard_join.GONE) for c in own if c % jaccard_join.GONE != min(own)}
    cuts = np.array_split(np.arange(400), 3)
    batches = [pa.RecordBatch.from_arrays([pa.array([jaccard_join._six(x[c])], pa.binary()) for x in (signatures, codes)], names=["signatures", "codes"]) for c in cuts]
    got = [tuple(r.values()) for out in jaccard_join._met(iter(batches)) for r in out.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want
    assert not list(jaccard_join._met(iter([])))
