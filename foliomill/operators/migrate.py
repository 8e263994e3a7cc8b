"""Carry translations over to re-parsed paragraphs: a band join on pages, then the most similar text."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.functions.text import normalise_for_match
from foliomill.sources.scratch import dropped, frugal, saved, saved_by, shared_folder

ACCEPT, EXACT = 0.75, 0.99
FEW = 5


#: Fixed for the bound: signs counted one by one; all others are counted together.
SIGNS = " etaoinshrdlucmfwypvbgkqjxz"


def sign_counts(text: Column) -> Column:
    """How often each of SIGNS occurs, and how many other characters there are: an array of fixed width."""
    own = F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in SIGNS])
    return F.concat(own, F.array(F.length(text) - F.aggregate(own, F.lit(0), lambda n, c: n + c)))


def ratio_bound(a: Column, b: Column) -> Column:
    """No matching of texts with these counts has a higher ratio: a character matches only its like, and only once."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, c: n + c)
    total = F.aggregate(F.concat(a, b), F.lit(0), lambda n, c: n + c)
    return F.when(total > 0, 2.0 * common / total).otherwise(1.0)


@F.pandas_udf(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("compared", T.IntegerType())]))
def best_of(texts: pd.Series, others: pd.Series) -> pd.DataFrame:
    """The most similar of each text's candidates, which come by falling bound; of equal ones the one of lowest rank.

    Ratcliff-Obershelp ratio in this argument order. No candidate is compared whose bound is below the best ratio so far or the threshold.
    """
    out = []
    for text, found in zip(texts, others, strict=True):
        place, best, rank, compared = -1, 0.0, -1, 0
        for k, c in enumerate(found):
            if c["bound"] < max(best, ACCEPT):
                break
            ratio = SequenceMatcher(None, text, c["text"]).ratio()
            compared += 1
            if ratio > best or (ratio == best and c["rank"] < rank):
                place, best, rank = k, ratio, c["rank"]
        out.append((place, best, compared))
    return pd.DataFrame(out, columns=["place", "similarity", "compared"])


def candidates(new: DataFrame, old: DataFrame) -> DataFrame:
    """Pairs (book_id, new_id, old_id, tier, ...): old paragraphs at most one page away, and, where those are fewer
    than five, at most three away. Page 0 of the old book never matches.

    The band is an equi-join on book and page: each new row looks at the seven pages around its own.
    """
    around = new.withColumn("__page", F.explode(F.sequence(F.greatest(F.lit(1), F.col("page_number") - 3), F.greatest(F.lit(1), F.col("page_number") + 3)))).where(F.col("__page") <= F.col("page_number") + 3)
    near = old.withColumnRenamed("page_number", "__page")
    pairs = around.join(near, ["book_id", "__page"]).withColumn("tier", F.when(F.abs(F.col("__page") - F.col("page_number")) <= 1, 0).otherwise(1))
    close = F.count_if(F.col("tier") == 0).over(W.partitionBy("book_id", "new_id"))
    return pairs.withColumn("__close", close).where((F.col("tier") == 0) | (F.col("__close") < FEW)).drop("__close").withColumnRenamed("__page", "old_page")


def prepared_pairs(new: DataFrame, old: DataFrame) -> DataFrame:
    """Candidate pairs without their texts: book_id, new_id, old_id, rank (tier, page and order of the old paragraph), equal, bound.

    Texts are normalised, hashed and counted once a paragraph, before the join, so a pair carries numbers only.
    """

    def slim(df: DataFrame, text: str, side: str) -> DataFrame:
        known = df.where(F.col(text) != "").withColumn("__t", normalise_for_match(F.col(text)))
        return known.withColumns({f"{side}_hash": F.md5("__t"), f"{side}_signs": sign_counts(F.col("__t"))}).drop("__t", text)

    pairs = candidates(slim(new, "text", "new").select("book_id", "new_id", "page_number", "new_hash", "new_signs"), slim(old.drop("translation"), "old_text", "old"))
    order = W.partitionBy("book_id", "new_id").orderBy("tier", "old_page", "old_order", "old_id")
    return pairs.select(
        "book_id", "new_id", "old_id", F.row_number().over(order).alias("rank"), (F.col("new_hash") == F.col("old_hash")).alias("equal"), ratio_bound(F.col("new_signs"), F.col("old_signs")).alias("bound")
    )


def equal_matches(pairs: DataFrame) -> DataFrame:
    """Of each new paragraph that has candidates of equal text, the first: no other can be more similar."""
    return pairs.where("equal").groupBy("book_id", "new_id").agg(F.min_by("old_id", "rank").alias("old_id")).withColumn("similarity", F.lit(1.0))


def compared_matches(pairs: DataFrame, new: DataFrame, old: DataFrame) -> DataFrame:
    """The best candidate of each new paragraph that has none of equal text: book_id, new_id, old_id, similarity, compared.

    Only pairs whose bound reaches the threshold fetch their texts, and only these texts are normalised again. A paragraph's candidates, those of seven pages at most, come as one array.
    """
    open_pairs = pairs.withColumn("__solved", F.max("equal").over(W.partitionBy("book_id", "new_id"))).where(~F.col("__solved") & (F.col("bound") >= ACCEPT))
    texts = old.select("book_id", "old_id", "old_text")
    entry = F.struct((-F.col("bound")).alias("below"), "rank", "old_id", "bound", "text")
    found = open_pairs.join(texts, ["book_id", "old_id"]).withColumn("text", normalise_for_match(F.col("old_text"))).groupBy("book_id", "new_id").agg(F.array_sort(F.collect_list(entry)).alias("others"))
    judged = found.join(new.select("book_id", "new_id", "text"), ["book_id", "new_id"]).withColumn("text", normalise_for_match(F.col("text"))).withColumn("best", best_of("text", F.transform("others", lambda c: F.struct(c["bound"].alias("bound"), c["rank"].alias("rank"), c["text"].alias("text")))))
    best = judged.select("book_id", "new_id", F.get("others", F.col("best.place"))["old_id"].alias("old_id"), "best.similarity", "best.compared")
    return best.where(F.col("similarity") >= ACCEPT)


def _found(new: DataFrame, old: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """new and old in buckets of books, and the best pairs: book_id, new_id, old_id, similarity.

    A book's paragraphs lie together from here on, so nothing is exchanged, and a pair is written only if its bound reaches the threshold.
    """
    new, old = saved_by(new, folder, "new", "book_id"), saved_by(old, folder, "old", "book_id")
    pairs = saved_by(prepared_pairs(new, old).where(F.col("bound") >= ACCEPT), folder, "pairs", "book_id")
    return new, old, saved_by(equal_matches(pairs).unionByName(compared_matches(pairs, new, old).drop("compared")), folder, "best", "book_id")


_PARTS = ("new", "old", "pairs", "best")


def best_matches(new: DataFrame, old: DataFrame) -> DataFrame:
    """Each new paragraph with its best old one: book_id, new_id, old_id, similarity, translation, status.

    new: book_id, new_id, page_number, text; old: book_id, old_id, old_order, page_number, old_text, translation; ids must be unique in their book. Of equal
    similarities the first in page and paragraph order counts. Equal texts (after normalising, by MD5) need no comparison; of the others only
    pairs meet the UDF whose upper bound, from counts of characters, reaches the threshold and what was found before. Books are bounded: a task holds whole ones.
    """
    spark = new.sparkSession
    folder, text = shared_folder(spark), F.coalesce("translation", F.lit(""))
    with frugal(spark):
        new, old, best = _found(new, old, folder)
        joined = new.select("book_id", "new_id").join(best, ["book_id", "new_id"], "left").join(old.select("book_id", "old_id", "translation"), ["book_id", "old_id"], "left")
        rows = joined.select("book_id", "new_id", "old_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), text.alias("translation"), F.when(text != "", "completed").otherwise("pending").alias("status"))
        matches = saved(rows, folder, "matches")
    for name in _PARTS:
        dropped(spark, folder, name)
    return matches


def best_similarities(new: DataFrame, old: DataFrame) -> DataFrame:
    """Of `best_matches` book_id, new_id and similarity only; no translation is kept."""
    spark = new.sparkSession
    folder = shared_folder(spark)
    with frugal(spark):
        new, _, best = _found(new, old.withColumn("translation", F.lit("")), folder)
        rows = new.select("book_id", "new_id").join(best, ["book_id", "new_id"], "left").select("book_id", "new_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
        matches = saved(rows, folder, "matches")
    for name in _PARTS:
        dropped(spark, folder, name)
    return matches


def match_statistics(matches: DataFrame) -> DataFrame:
    s = F.col("similarity")
    return matches.groupBy("book_id").agg(F.count_if(s >= EXACT).alias("exact"), F.count_if((s >= ACCEPT) & (s < EXACT)).alias("good"), F.count_if(s < ACCEPT).alias("unmatched"))
