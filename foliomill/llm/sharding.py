"""Sharding by proportional stratified interleaving.

Every stratum (source) is put in a seeded random order; its r-th of n rows gets the fraction
(r - 1 + phase) / n, where the phase in [0, 1) is drawn for each stratum from the same seed. All rows,
sorted by that fraction, form one sequence in which each stretch holds the strata in the proportions of
the whole table. Cutting the sequence into equal runs gives shards that all match the mixture and whose
row counts differ by one at most.

Ranks over any number of rows come without a single-task sort: keys alone are dealt by
(stratum, leading hash bits) and later by the leading part of the fraction. Both are uniform by
construction, so a stratum with a third of all rows is spread over `BUCKETS` groups, and small prefix-sum
tables turn ranks within a group into ranks over all. Rows of one stratum and id are neighbours in the stratum's order,
so their places are found for the key first; whole rows are exchanged once, by that key, and take their key's places in turn.

Defined results: a null stratum is a stratum of its own; a null id hashes as empty text; repeated rows are
separate rows (equal rows are interchangeable); an empty table gives no rows; columns already named
`shard` or `slot` are replaced, all others are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.llm.common import unit_hash

#: Groups that one stratum, and the whole sequence, are dealt into for ranking.
BUCKETS = 1024
#: Steps of a stratum's phase.
PHASES = 1024


def interleave_shards(rows: DataFrame, n_shards: int, stratum: str = "source", id_col: str = "doc_id", ties: Sequence[str] = (), seed: str = "shard-1") -> DataFrame:
    """Add `shard` (0 .. n_shards-1, int) and `slot` (place in the shard, gapless from 0, long).

    `ties` are further columns that order rows of one id. The frame may hold whole documents or only keys.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    rows = rows.drop("shard", "slot")
    own = rows.columns
    named = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    keys = {"__stratum": named(stratum), "__key": named(id_col)}
    groups = rows.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.min(id_col).alias("__id"), F.count(F.lit(1)).alias("__rows"))
    keyed = groups.withColumn("__u", unit_hash(seed, F.col("__id"), bits=52)).withColumn("__bucket", F.shiftright("__u", 42).cast("int"))

    # Rank of an id's first row within the stratum: rows of earlier buckets, plus those of earlier ids in the bucket.
    in_stratum = W.partitionBy("__stratum")
    counts = keyed.groupBy("__stratum", "__bucket").agg(F.sum("__rows").alias("__n_bucket"))
    before = counts.select(
        "__stratum",
        "__bucket",
        F.coalesce(F.sum("__n_bucket").over(in_stratum.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("__n_bucket").over(in_stratum).alias("__n"),
    )
    in_bucket = W.partitionBy("__stratum", "__bucket").orderBy("__u", "__id", "__key")
    earlier = F.coalesce(F.sum("__rows").over(in_bucket.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("__earlier", earlier).join(before, ["__stratum", "__bucket"])

    # One line for each row. The fraction as numerator over PHASES * n; its leading part deals rows out for the global rank.
    phase = unit_hash(seed, "phase", F.col("__stratum"), bits=52) % PHASES
    each = ranked.select("__stratum", "__key", "__n", (F.col("__earlier") + F.col("__before")).alias("__first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("__rows") - 1)).alias("__i"))
    placed = each.withColumn("__num", (F.col("__first") + F.col("__i")) * PHASES + phase).withColumn("__part", F.expr(f"(__num * {BUCKETS}) div (__n * {PHASES})").cast("int"))
    part_counts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n_part"))
    everything = W.partitionBy(F.lit(0))  # over at most BUCKETS rows
    part_before = part_counts.select(
        "__part",
        F.coalesce(F.sum("__n_part").over(everything.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__p_before"),
        F.sum("__n_part").over(everything).alias("__all"),
    )
    in_part = W.partitionBy("__part").orderBy(F.col("__num") / F.col("__n"), "__stratum", "__num")
    position = (F.row_number().over(in_part) - 1).cast("long")
    cut = placed.withColumn("__p", position).join(part_before, "__part").withColumn("__p", F.col("__p") + F.col("__p_before"))
    places = cut.groupBy("__stratum", "__key").agg(F.array_sort(F.collect_list("__p")).alias("__places"), F.max("__all").alias("__all"))

    # Whole rows are exchanged here only, by the key that the places have too.
    in_key = W.partitionBy(*keys).orderBy(id_col, *ties)
    taken = rows.withColumns(keys).withColumn("__r", F.row_number().over(in_key)).join(places, list(keys)).withColumn("__p", F.element_at("__places", F.col("__r")))
    return taken.select(
        *[f"`{c}`" for c in own],
        F.expr(f"__p * {n_shards} div __all").cast("int").alias("shard"),
        F.expr(f"__p - ((__p * {n_shards} div __all) * __all + {n_shards - 1}) div {n_shards}").cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder for each shard, rows in slot order within their files."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
