"""Enrichment: content-addressed cache, fixed batches, a pluggable provider, response parsing and status roll-ups."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliomill.functions.text import source_hash, strip
from foliomill.sources.scratch import saved, shared_folder

BATCH = 8
ERROR_LENGTH = 500
MISSING, EMPTY = "missing translation", "empty translation"


class Provider(Protocol):
    """Translates a batch: (prompt, [(id, text)]) to the reply's text; or one text."""

    def batch(self, prompt: str, items: list[tuple[str, str]]) -> str: ...
    def one(self, prompt: str, text: str) -> str: ...


def with_hash(items: DataFrame) -> DataFrame:
    return items.withColumn("source_hash", source_hash(F.col("text")))


def number_batches(items: DataFrame, order: list[str], size: int = BATCH, job: str = "job_id") -> DataFrame:
    """Add `batch_no` (0-based): consecutive items of a job, `size` at a time."""
    nth = F.row_number().over(W.partitionBy(job).orderBy(*order)) - 1
    return items.withColumn("batch_no", F.floor(nth / size).cast("int"))


def lookup(items: DataFrame, cache: DataFrame) -> DataFrame:
    """Add `cached_text`: the completed translation of the same source hash, null if none. Cached once per hash."""
    known = cache.where("status = 'completed'").groupBy("source_hash").agg(F.min("translated_text").alias("cached_text"))
    return items.join(known, "source_hash", "left")


def attribute_hits(items: DataFrame) -> DataFrame:
    """Add `cached`: known before the job, or asked for in an earlier batch of it. Repeats in one batch are misses."""
    first = F.min("batch_no").over(W.partitionBy("job_id", "source_hash"))
    blank = strip(F.col("text")) == ""
    return items.withColumn("cached", ~blank & (F.col("cached_text").isNotNull() | (F.col("batch_no") > first)))


def strip_fence(reply: Column) -> Column:
    """A reply without the Markdown code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(reply), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))


def parse_replies(replies: DataFrame, reply: str = "reply", id_type: str = "string") -> DataFrame:
    """Explode replies, JSON arrays of {id, translation}, to rows; what is no such array gives none.

    Ids keep their type: with string ids the number 1 in a reply is another id than "1", with id_type `long` it is the other way round.
    """
    kind = "array<struct<id:variant,translation:string>>"
    parsed = F.coalesce(F.from_json(strip_fence(F.col(reply)), kind), F.expr(f"cast(array() as {kind})"))
    rows = replies.withColumn("__p", parsed).select(*replies.columns, F.posexplode("__p").alias("pos", "item"))
    typed = rows.where(F.schema_of_variant("item.id") == ("STRING" if id_type == "string" else "BIGINT"))
    return typed.select(*replies.columns, "pos", F.variant_get("item.id", "$", id_type).alias("id"), F.col("item.translation").alias("translation"))


def associate(items: DataFrame, parsed: DataFrame, key: list[str]) -> DataFrame:
    """Items with the translation of their id, of several the last; none, or an empty one, is an error. Other ids are ignored."""
    last = parsed.groupBy(*key).agg(F.max_by("translation", "pos").alias("translation"))
    joined = items.join(last, key, "left")
    bad = F.col("translation").isNull() | (F.col("translation") == "")
    return joined.withColumns({"error": F.when(bad, MISSING), "translation": F.when(bad, "").otherwise(F.col("translation"))})


def build_prompt(base: Column, glossary: Column, context: Column) -> Column:
    """Prompt with glossary lines (an array of strings, may be empty) and at most 500 characters of context."""
    with_terms = F.when(F.size(glossary) > 0, F.concat(base, F.lit("\n\nGlossary:\n"), F.array_join(glossary, "\n"))).otherwise(base)
    return F.when(context != "", F.concat(with_terms, F.lit("\n\nContext:\n"), F.substring(context, 1, 500))).otherwise(with_terms)


def glossary_lines(glossary: DataFrame) -> DataFrame:
    """`term → translation` lines of each book as one array in the order of terms."""
    line = F.concat(F.col("term"), F.lit(" → "), F.col("translation"))
    return glossary.groupBy("book_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("term", line.alias("line")))), lambda x: x["line"]).alias("terms"))


def terms_in(texts: DataFrame, glossary: DataFrame, group: str, key: list[str]) -> DataFrame:
    """Terms that occur in texts as whole words: key, term, translation, once each.

    texts: key, group, text; glossary: group, term, translation. All terms are looked for at once: every word of a text, with the few that follow it,
    meets the terms that begin with it, in a join on group and word. Terms without a word occur nowhere.
    """
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    terms = glossary.select(F.col(group), "term", "translation", words(F.col("term")).alias("__ws")).where(F.size("__ws") > 0).distinct()
    longest = terms.agg(F.max(F.size("__ws"))).first()[0] or 1
    own = texts.select(*key, group, words(F.col("text")).alias("__w")).where(F.size("__w") > 0)
    grams = own.select(*key, group, F.explode(F.array_distinct(F.transform("__w", lambda w, i: F.slice(F.col("__w"), i + 1, longest)))).alias("__gram"))
    met = grams.withColumn("__first", F.get("__gram", F.lit(0))).join(terms.withColumn("__first", F.get("__ws", F.lit(0))), [group, "__first"])
    return met.where(F.slice("__gram", 1, F.size("__ws")) == F.col("__ws")).select(*key, "term", "translation").distinct()


def batch_prompts(items: DataFrame, template: str, glossary: DataFrame, order: list[str], group: str = "job_id") -> DataFrame:
    """One prompt for each batch: job_id, batch_no, prompt; items need job_id, batch_no, text, cached_text and the group that glossaries belong to.

    The glossary holds the terms that occur in the batch, by term and translation; the context is the known translation of the paragraph before the batch.
    """
    key = ["job_id", "batch_no"]
    found = terms_in(items.select(*dict.fromkeys([*key, group, "text"])), glossary, group, key)
    lines = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_set(F.struct("term", "translation"))), lambda t: F.concat(t["term"], F.lit(" → "), t["translation"])).alias("terms"))
    before = F.lag("cached_text").over(W.partitionBy("job_id").orderBy(*order))
    context = items.withColumn("__before", before).groupBy(*key).agg(F.min_by("__before", F.struct(*order)).alias("context"))
    empty = F.expr("cast(array() as array<string>)")
    joined = context.join(lines, key, "left")
    return joined.select(*key, build_prompt(F.lit(template), F.coalesce("terms", empty), F.coalesce("context", F.lit(""))).alias("prompt"))


def ask(misses: DataFrame, provider: Callable[[], Provider], prompt: str = "") -> DataFrame:
    """Call the provider for misses, batch by batch: job_id, batch_no, id, translation, error.

    A batch (of at most BATCH items) is one row, and tasks take rows as they come. A column `prompt`, equal within a batch, replaces the argument. A batch that fails, or whose
    reply is no JSON array, is asked again item by item. The provider is made once for each task. An id in a reply counts only if its type is that of the items' ids.
    """
    told = F.first("prompt") if "prompt" in misses.columns else F.lit(prompt)
    batches = misses.groupBy("job_id", "batch_no").agg(told.alias("prompt"), F.array_sort(F.collect_list(F.struct("id", "text"))).alias("items"))

    def one_batch(own: Provider, told: str, items: list[tuple[Any, str]]) -> list[tuple[Any, str, str | None]]:
        try:
            reply = re.sub(r"^```[a-zA-Z]*\s*|\s*```$", "", own.batch(told, items).strip())
            found = {(type(r["id"]), r["id"]): r.get("translation") for r in json.loads(reply)}
            return [(i, found.get((type(i), i)) or "", None if found.get((type(i), i)) else MISSING) for i, _ in items]
        except Exception:  # whatever the foreign service did wrong, its items get a second call each
            out = []
            for i, text in items:
                try:
                    out.append((i, own.one(told, text).strip(), None))
                except Exception as e:
                    out.append((i, "", str(e)[:ERROR_LENGTH]))
            return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = None
        for frame in frames:
            own = own or provider()
            rows = []
            for b in frame.itertuples(index=False):
                items = [(r["id"] if isinstance(r["id"], str) else int(r["id"]), r["text"]) for r in b.items]
                rows += [(b.job_id, b.batch_no, *o) for o in one_batch(own, b.prompt, items)]
            yield pd.DataFrame(rows, columns=["job_id", "batch_no", "id", "translation", "error"])

    kinds = {c: misses.schema[c].dataType.simpleString() for c in ("job_id", "batch_no", "id")}
    out = ", ".join(f"{c} {k}" for c, k in kinds.items())
    return batches.mapInPandas(run, f"{out}, translation string, error string")


def translate(items: DataFrame, cache: DataFrame, provider: Callable[[], Provider], order: list[str], prompt: str = "", glossary: DataFrame | None = None, group: str = "job_id") -> DataFrame:
    """Results of a job's items: id, job_id, batch_no, source_hash, translation, cached, error, status, message.

    Blank texts go to no provider. A repeat of an earlier batch's text takes that one's translation. With a glossary (group, term, translation) each batch has a
    prompt of its own. Items with their hits, and answers, are written to the shared folder at once: items are made once, and a batch is asked for once however often the results are used.
    """
    folder = shared_folder(items.sparkSession)
    known = saved(attribute_hits(lookup(number_batches(with_hash(items), order), cache)), folder, "known")
    blank = strip(F.col("text")) == ""
    misses = known.where(~blank & ~F.col("cached")).select("job_id", "batch_no", "id", "text")
    if glossary is not None:
        misses = misses.join(batch_prompts(known, prompt, glossary, order, group), ["job_id", "batch_no"])
    asked = saved(ask(misses, provider, prompt), folder, "answers")
    joined = known.join(asked, ["job_id", "batch_no", "id"], "left")
    # One row for each text of a job, by a grouped aggregate: a text that fills a third of a large job is no window.
    earlier = asked.where("error IS NULL").join(known.select("job_id", "batch_no", "id", "source_hash"), ["job_id", "batch_no", "id"])
    first = earlier.groupBy("job_id", "source_hash").agg(F.min("translation").alias("earlier"))
    joined = joined.join(first, ["job_id", "source_hash"], "left")
    text = F.when(blank, "").when(F.col("cached"), F.coalesce("cached_text", "earlier", F.lit(""))).otherwise(F.col("translation"))
    rows = joined.withColumns({"translation": text, "error": F.when(blank | F.col("cached"), None).otherwise(F.col("error"))})
    return with_status(rows).select("job_id", "batch_no", "id", "source_hash", "translation", "cached", "error", "status", "message")


def translate_one(text: str, provider: Provider, prompt: str = "") -> tuple[str, str | None]:
    """(translation, error) of a single text, past all batches and caches."""
    if not text.strip():
        return "", None
    try:
        return provider.one(prompt, text).strip(), None
    except Exception as e:
        return "", str(e)[:ERROR_LENGTH]


def with_status(results: DataFrame) -> DataFrame:
    """Add the paragraph's `status` and error `message` (at most 500 characters)."""
    done = F.col("error").isNull() & (F.col("translation") != "")
    return results.withColumns({"status": F.when(done, "completed").otherwise("failed"), "message": F.when(done, "").otherwise(F.substring(F.coalesce("error", F.lit(EMPTY)), 1, ERROR_LENGTH))})


def cache_rows(results: DataFrame) -> DataFrame:
    """New cache rows of completed results, one for each hash."""
    fresh = results.where("status = 'completed' AND NOT cached").groupBy("source_hash").agg(F.max_by("translation", "id").alias("translated_text"))
    return fresh.select(F.concat("source_hash", F.lit("_zh")).alias("id"), "source_hash", F.lit("zh").alias("target_lang"), "translated_text", F.lit("completed").alias("status"))


def status_counts(rows: DataFrame, key: list[str]) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("total"), count("completed"), count("failed"), count("pending"))


def chapter_status() -> Column:
    return F.when((F.col("failed") > 0) | (F.col("pending") > 0), "partial").when(F.col("completed") > 0, "completed").otherwise("pending")


def job_status() -> Column:
    return F.when(F.col("failed") == F.col("total"), "failed").when((F.col("failed") == 0) & (F.col("completed") == F.col("total")), "completed").otherwise("partial")


def throughput(done: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each job: paragraphs and characters a second, and the share of paragraphs that came from the cache.

    done: job_id, ts, n_chars, cached. A session ends when nothing is done for `gap`; rates of a session without length are null. Works on a stream with a watermark.
    """
    session = F.session_window("ts", gap)
    groups = done.groupBy("job_id", session.alias("s")).agg(
        F.count(F.lit(1)).alias("paragraphs"), F.sum("n_chars").alias("chars"), F.count_if("cached").alias("hits"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at")
    )
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    rate = lambda c: F.when(seconds > 0, F.col(c) / seconds)
    return groups.select(
        "job_id", "started_at", "ended_at", "paragraphs", "chars", rate("paragraphs").alias("paragraphs_per_second"), rate("chars").alias("chars_per_second"), (F.col("hits") / F.col("paragraphs")).alias("hit_ratio")
    )


def observed(results: DataFrame, name: str = "translate") -> tuple[DataFrame, Observation]:
    """The results with an observation that counts them while they are written: total, completed, failed, hits."""
    seen = Observation(name)
    status = F.col("status")
    return results.observe(seen, F.count(F.lit(1)).alias("total"), F.count_if(status == "completed").alias("completed"), F.count_if(status == "failed").alias("failed"), F.count_if("cached").alias("hits")), seen
