r"""Quality rules as a short-circuit cascade.

Word counts, symbols, repeated lines and repeated word windows are computed for every whole text with
DataFrame functions. Whether a document is kept is a conjunction of rules; their order does not change the
verdict, only the work. A bounded sample of documents, drawn before anything is measured, gives each rule's cost (its
running time beyond that of an empty rule, over many evaluations of each row) and the share of documents that it rejects;
the cascade then tries rules by rejection per cost, and a CASE expression stops at the first that rejects.

Defined results: a null text has no words and fails; equal rows give equal results; an empty table gives no
rows; long texts are measured whole; columns whose names clash with the added ones are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the measures: white space, symbols, window length.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
WORD = r"[^\x20\x09-\x0D]+"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A document passes if the SQL condition over text and the measures holds."""

    name: str
    passes: str


#: The rules beyond the base: each rejects only what is far from running text.
DEFAULT_RULES = (
    Rule("mean_word_length", "word_chars BETWEEN 2 * n_words AND 14 * n_words"),
    Rule("symbol_share", "10 * n_symbols <= 3 * n_words"),
    Rule("repeated_lines", "n_dup_lines = 0 OR 100 * n_dup_lines <= 30 * size(split(text, '\n'))"),
    Rule("capitals", "2 * length(regexp_replace(text, '[^A-Z]', '')) <= word_chars"),
    Rule("exclamation", "5 * (length(text) - length(replace(text, '!!', ''))) <= 2 * n_words"),
    Rule("letters", r"2 * length(regexp_replace(text, '[^\\p{L}]', '')) >= word_chars"),
)


def _let(value: Column, body) -> Column:
    """Evaluate value once and use it in body many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more; windows: one hash for each start."""

    def from_sorted(s: Column) -> Column:
        n = F.size(s)
        same = lambda i, j: F.element_at(s, i)["h"] == F.element_at(s, j)["h"]
        twice = F.filter(F.sequence(F.lit(1), n), lambda i: ((i > 1) & same(i, F.greatest(i - 1, F.lit(1)))) | ((i < n) & same(i, F.least(i + 1, n))))
        return _let(F.array_sort(F.transform(twice, lambda i: F.element_at(s, i)["at"])), overlap)

    def overlap(starts: Column) -> Column:
        # A window adds as many words as lie before the next window's start.
        added = F.transform(starts, lambda p, i: F.when(i == F.size(starts) - 1, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)))
        return F.aggregate(added, F.lit(0), lambda a, x: a + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(F.array_sort(pairs), from_sorted))


def _repeat_words(words: Column) -> Column:
    """Words in 8-word windows found twice or more, from the words' hashes."""

    def from_hashes(h: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(h) - WINDOW + 1)
        return _let(F.transform(starts, lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)])), _covered)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five measures (long) to whole documents."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    measured = _let(
        F.regexp_extract_all(body, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words")),
    )
    return (
        docs.drop(*MEASURES, "__m")
        .withColumn("__m", measured)
        .withColumn("__lines", lines)
        .withColumns(
            {
                "n_words": F.col("__m.n_words"),
                "word_chars": F.length(F.translate(body, SPACE, "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.col("__m.n_repeat_words"),
            }
        )
        .drop("__m", "__lines")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = 1000, repeats: int = 5, seed: int = 7) -> list[Rule]:
    """Order rules by rejection per cost, both estimated on about `sample_rows` sampled documents.

    Only the order depends on the estimates, never a verdict. Each rule is evaluated `repeats` times for each row, twice
    over, so that the least of its times shows work rather than scheduling; costs below a twentieth of the dearest
    rule's count as equal.
    """
    fraction = min(1.0, sample_rows / max(docs.count(), 1))
    sample = with_measures(docs.sample(False, fraction, seed)).coalesce(4).cache()
    again = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
    try:
        seen = sample.count()

        def measure(condition: Column) -> tuple[float, float]:
            times = []
            for _ in range(2):
                began = time.perf_counter()
                rejected = again.agg(F.count_if(~condition & (F.col("__again") > 0))).first()[0]
                times.append(time.perf_counter() - began)
            return min(times), rejected / repeats

        idle = measure(F.lit(True))[0]
        rated = [(rule, *measure(F.coalesce(F.expr(rule.passes), F.lit(False)))) for rule in rules]
        least = max([1e-3, *(0.05 * (took - idle) for _, took, _ in rated)])
        return [r for r, _, _ in sorted(rated, key=lambda x: -((x[2] + 1) / (seen + 2) / max(x[1] - idle, least)))]
    finally:
        sample.unpersist()


def apply_rules(docs: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES, sample_rows: int = 1000) -> DataFrame:
    """Add the measures, `base_failed` and `kept` (boolean) to documents with a `text` column."""
    docs = docs.drop("base_failed", "kept")
    measured = with_measures(docs).withColumn("base_failed", base_failed())
    cascade = F.lit(True)
    for rule in reversed(order_rules(docs.select("text"), rules, sample_rows)):
        cascade = F.when(~F.coalesce(F.expr(rule.passes), F.lit(False)), F.lit(False)).otherwise(cascade)
    return measured.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade))
