"""Mixing sources to target weights by Poisson replication.

Each source gets the mean repetition rate that lets it meet its share of the wanted rows. Every document
draws its number of copies from a Poisson distribution with that mean, by inverting the distribution at a
uniform number hashed from seed and document id: reruns, retries and other partitionings draw the same.
Documents are exploded by their counts and put in a global random order.

Rates above `PIECE` are split: a Poisson number of mean m is the sum of independent ones with mean
m / pieces, each drawn from its own hash, so no distribution table grows with the rate.

Only DataFrame functions are used. The rate table has one row for each source. It is broadcast while it
has at most `BROADCAST_SOURCES` rows; beyond that, both sides are salted and shuffled, so that a source with
a third of all rows is spread over `SALTS` groups.

Defined results: a null source is a source of its own; a null id hashes as empty text; rows with one id draw
the same number; an empty table gives no rows; columns named `copy`, `copies` or `order_key` are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.llm.common import at_most, unit_hash

PIECE = 16.0
BROADCAST_SOURCES = 5_000
SALTS = 64


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None, rows_out: int | None, temperature: float, source: str) -> DataFrame:
    """One row for each source: `__source`, `rate`, `pieces` and the cumulative distribution of one piece."""
    counts = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, share in weights.items():
            weight = F.when(F.col("__source").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(weight)
    weighted = counts.withColumn("w", weight)
    total = weighted.agg(F.sum("w").alias("w_all"), F.sum("n").alias("n_all"))
    wanted = F.col("n_all").cast("double") if rows_out is None else F.lit(float(rows_out))
    rates = (
        weighted.join(F.broadcast(total))  # one row
        .withColumn("rate", F.when(F.col("w") > 0, F.col("w") / F.col("w_all") * wanted / F.col("n")).otherwise(0.0))
        .withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("long"))
        .withColumn("mean", F.col("rate") / F.col("pieces"))
    )
    last = int(PIECE + 12 * PIECE**0.5 + 30)
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.array(F.exp(-F.col("mean"))).alias("cdf"))
    step = lambda acc, k: F.struct(
        (acc["p"] * F.col("mean") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("mean") / k)).alias("cdf")
    )
    return rates.select("__source", "rate", "pieces", F.aggregate(F.sequence(F.lit(1), F.lit(last)), start, step, lambda acc: acc["cdf"]).alias("cdf"))


def poisson_mix(
    docs: DataFrame, weights: Mapping[str, float] | None = None, rows_out: int | None = None, temperature: float = 0.5, source: str = "source", id_col: str = "doc_id", seed: str = "mix-1", broadcast_sources: int = BROADCAST_SOURCES
) -> DataFrame:
    """Replicate documents so that sources meet `weights` (any positive scale), globally shuffled.

    Without weights the target share of a source is its row count to the power `temperature`. `rows_out`
    is the expected size of the result (the input's size by default). Adds `copy` (1-based int), `copies`
    (int) and `order_key` (long, the place in the shuffled order).
    """
    docs = docs.drop("copy", "copies", "order_key")
    own = docs.columns
    rates = source_rates(docs, weights, rows_out, temperature, source)
    if at_most(rates.select("__source"), broadcast_sources):
        rated = docs.join(F.broadcast(rates), F.col(source).eqNullSafe(F.col("__source")))
    else:
        salted = rates.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rated = docs.withColumn("__doc_salt", (unit_hash(seed, "salt", F.col(id_col)) % SALTS).cast("int")).join(salted, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__doc_salt") == F.col("__salt")))
    two_52 = float(2**52)
    drawn = lambda piece: F.size(F.filter(F.col("cdf"), lambda c: unit_hash(seed, F.col(id_col), piece) / two_52 >= c))
    # The hash of a piece is bound once, then compared with each step of the distribution.
    one = F.aggregate(F.transform(F.array(unit_hash(seed, F.col(id_col), F.lit(1)) / two_52), lambda u: F.size(F.filter(F.col("cdf"), lambda c: u >= c))), F.lit(0), lambda a, x: a + x)
    many = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("pieces")), F.lit(0), lambda acc, piece: acc + drawn(piece))
    counted = rated.withColumn("copies", F.when(F.col("pieces") == 1, one).otherwise(many)).where("copies > 0")
    copied = counted.select(*[f"`{c}`" for c in own], "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = copied.withColumn("order_key", unit_hash(seed, "order", F.col(id_col), F.col("copy")))
    return keyed.select(*[f"`{c}`" for c in own], "copy", "copies", "order_key").orderBy("order_key", id_col, "copy")
