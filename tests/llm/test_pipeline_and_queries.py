"""The pipeline against a plain model of its first three stages, and the registered queries against SQL."""

from __future__ import annotations

from collections import Counter

import pytest
from duck import assert_same, connect
from llm import models as m

import corpus_pipeline
from foliomill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, sf_dir):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name])


def test_pipeline(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    docs = source
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == source.columns, name
        after = {r.doc_id for r in docs.collect()}
        rows = sorted(before.items())
        if name == "quality_rules":
            assert not any(m.quality(before[i])[-1] for i in after) and 0 < len(after) < len(before)
        elif name == "near_duplicates":
            assert after == {i for i, _, c in m.jaccard_groups(rows, 5, 80)[0] if i == c}
        else:
            assert after == {i for i, _, n, _ in m.contamination(rows, items) if n == 0}
    final = corpus_pipeline.run(spark, sf_dir).collect()
    sizes = Counter(r.shard for r in final)
    assert {r.doc_id for r in final} <= after and max(sizes.values()) - min(sizes.values()) <= 1


def test_pipeline_with_odd_rows(spark, sf_dir):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good, "en", "a", 1), (1, good, "en", "a", 1), (None, good + " more words here", None, None, None), (2, None, "en", "a", 0), (3, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0), sf_dir).count() == 0, name
        if name == "quality_rules":
            assert docs.count() == 3
        if name == "near_duplicates":
            assert 1 <= docs.count() <= 2
