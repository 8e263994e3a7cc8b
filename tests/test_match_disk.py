"""What re-matching of translations exchanges and leaves: books lie together, pairs below the threshold are never written."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliomill.operators import migrate as M
from foliomill.plans import enrichment


def test_pairs_exchange_nothing_and_few_are_written(spark, sf_dir, monkeypatch):
    plans, rows = {}, {}

    def spy(save):
        def run(df, folder, name, *key):
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
            out = save(df, folder, name, *key)
            rows[name] = out.count()
            return out

        return run

    for name in ("saved", "saved_by"):
        monkeypatch.setattr(M, name, spy(getattr(M, name)))
    new, old = enrichment._old_new(spark, sf_dir)
    got = M.best_matches(new, old)
    assert [plans[x].count("Exchange") for x in ("new", "old")] == [1, 1]
    assert not [x for x in ("pairs", "best", "matches") if "Exchange hash" in plans[x]]
    assert rows["pairs"] == M.prepared_pairs(new, old).where(F.col("bound") >= M.ACCEPT).count()
    slim = M.best_similarities(new, old)
    assert slim.columns == ["book_id", "new_id", "similarity"]
    assert got.select(slim.columns).exceptAll(slim).isEmpty() and got.count() == slim.count() == new.count()


def test_nothing_is_left_but_the_matches(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "shared_folder", lambda spark: str(tmp_path / "m"))
    new, old = (df.where(F.col("book_id") < 30) for df in enrichment._old_new(spark, sf_dir))
    assert M.best_matches(new, old).count() == new.count()
    assert [p.name for p in (tmp_path / "m").iterdir()] == ["matches"]
