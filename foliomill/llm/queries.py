"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import decontam, html_text, jaccard_join, langid, lm_score, mixing, packing, periodic_runs, quality_knn, quality_rules, sharding, suffix_dedup, whitening
from foliomill.llm.common import id_bucket, table

SHARDS = 24


def op1_shard_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: the counts of the 24 shards differ by one at most."""
    docs = table(spark, sf_dir, "documents")
    body = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", "source", (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    cut = sharding.interleave_shards(keys, SHARDS, ties=("size", "text_crc32"))
    return cut.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square-root temperature over sources, as many rows expected as there are documents."""
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "copy", "copies", "order_key")


OP2_SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT *, pow(n, 0.5) AS w FROM counts),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM weighted),
means AS (SELECT source, CAST(greatest(ceil(rate / 16.0), 1) AS BIGINT) AS pieces, rate / greatest(ceil(rate / 16.0), 1) AS mean FROM rates),
steps AS (SELECT source, k, sum(exp(-mean + k * ln(mean) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
          FROM means, (SELECT unnest(range(0, 95)) AS k)),
pieces AS (SELECT doc_id, d.source, unnest(range(1, pieces + 1)) AS piece FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
draws AS (SELECT doc_id, source, piece, CAST('0x' || substr(md5('mix-1|' || doc_id || '|' || piece), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM pieces),
counted AS (SELECT doc_id, d.source, count(k) AS copies FROM draws d LEFT JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND u >= cdf GROUP BY ALL),
copied AS (SELECT doc_id, source, unnest(range(1, copies + 1)) AS copy, copies FROM counted WHERE copies > 0)
SELECT doc_id, source, CAST(copy AS INT) AS copy, CAST(copies AS INT) AS copies,
       CAST('0x' || substr(md5('mix-1|order|' || doc_id || '|' || copy), 1, 13) AS BIGINT) AS order_key
FROM copied
"""


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    rendered = html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return rendered.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity of 0.9 or more."""
    return jaccard_join.similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=3, percent=90)


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels whose id bucket (of 5) is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_knn.learn(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 5) != 0)
    scored = quality_knn.classify(docs, model)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes; `n_repeat_windows` counts strings of 51 words that other documents have too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = suffix_dedup.remove_repeats(docs, 400)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["length"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeat_windows")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose id bucket (of 4) is not 2."""
    docs = table(spark, sf_dir, "documents")
    parsers = langid.learn(docs.select("doc_id", "lang", "text"), id_bucket(F.col("doc_id"), 4) != 2)
    guessed = langid.predict(docs.select("doc_id", "text"), parsers)
    return guessed.select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, unnest(list(i)) AS i FROM windows GROUP BY doc_id, win HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT d.doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND 10 * n_symbols <= 3 * n_words
  AND (n_dup_lines = 0 OR 100 * n_dup_lines <= 30 * len(string_split(text, chr(10))))
  AND 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) <= word_chars
  AND 5 * (length(text) - length(replace(text, '!!', ''))) <= 2 * n_words
  AND 2 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= word_chars AS kept
FROM b
"""


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose id bucket (of 5) is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(docs, id_bucket(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (id_bucket(F.col("doc_id"), 5) == 1).alias("held_out"), *lm_score.SCORES)


def op10_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.n_hit_words().alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH norm_docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
norm_items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, list_slice(ws, i, i + least(len(ws), 10) - 1) AS win
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM norm_items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT doc_id, n, i, list_slice(ws, i, i + n - 1) AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM norm_docs, sizes)),
hits AS (SELECT doc_id, item_id, i, d.n FROM doc_windows d JOIN item_windows w ON d.n = w.n AND d.win = w.win),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm_docs LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _with_repeated_words(docs: DataFrame) -> DataFrame:
    """Documents whose id has a crc32 divisible by ten: from word a on, the words repeat with a period. Null ids and texts
    without words stay as they are."""
    code = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(code / 10)
    words = F.col("__words")
    n = F.size(words)
    a, rest = F.col("__from"), n - F.col("__from")
    period = (1 + F.floor(rest / (3 + g % 8))).cast("int")
    repeated = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % period)))
    split = F.when(code % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    prepared = docs.withColumn("__words", split).withColumn("__from", F.when(n > 0, (g % n).cast("int")))
    return prepared.withColumn("text", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text"))).drop("__words", "__from")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more, after repeats were put into a tenth of the documents."""
    docs = _with_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs.find_runs(docs, 12)
    longest = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("__best", F.when(F.size("runs") > 0, longest))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("__best.s").alias("start"),
        (-F.col("__best.l")).alias("length"),
        F.col("__best.p").alias("period"),
        F.floor(-1000 * F.col("__best.l") / F.col("__best.p")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 2,048 tokens of the 50k byte-level vocabulary; documents end with id 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, end_id=0)
    return packing.pack(pieces, 2048).select("doc_id", *packing.PIECE, "sequence_id", "offset")


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 32 components of all embeddings, one row for each vector and component."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.learn(vectors, components=32)
    white = whitening.transform(vectors, model)
    error = whitening.identity_error(white, model)
    explained = F.array(*[F.lit(float(v)) for v in model.explained])
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).cast("double").alias("explained"),
        F.lit(error).alias("identity_error"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_interleave": op1_shard_interleave,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_html_text": op3_html_text,
    "op4_jaccard_groups": op4_jaccard_groups,
    "op5_quality_knn": op5_quality_knn,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_lm_score": op9_lm_score,
    "op10_benchmark_hits": op10_benchmark_hits,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pack_sequences": op12_pack_sequences,
    "op13_whiten_embeddings": op13_whiten_embeddings,
}

ORACLES: dict[str, str] = {"op2_poisson_mix": OP2_SQL, "op8_quality_rules": OP8_SQL, "op10_benchmark_hits": OP10_SQL}
