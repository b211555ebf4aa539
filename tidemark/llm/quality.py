"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes and its histogram of common words are compared with
those of its language by Jensen-Shannon distance. The language's reference is made from the whole
table: the median share of every class or word over the documents of the language, which junk does
not shift while it is the lesser part. Histograms of short texts are noisy, so neither rule speaks
below its minimum length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, text_or_empty

# The most common words of each language, in order of frequency.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich"],
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "for"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une"],
}
WORDS_PER_LANGUAGE = 10
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Character classes: letters without case or in lower case and digits; upper case; blanks; symbols;
#: ASCII punctuation; the rest. Digits go with letters, as dates and numbers are part of good text.
CLASSES = 6


@dataclass(frozen=True)
class Limits:
    """``max_char`` and ``max_word`` are Jensen-Shannon divergences in bits."""

    max_char: float = 0.02
    min_chars: int = 200
    max_word: float = 0.07
    min_words: int = 200
    base_words: int = 50
    base_repeat_percent: int = 50


def _length_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def _count_of(words: Column, word: str) -> Column:
    return F.size(F.filter(words, lambda w: w == word))


def histograms(docs: DataFrame) -> DataFrame:
    """The rows (as ``_row``) with ``words``, ``classes`` (counts), ``common`` (counts, or NULL
    where the language has no list), ``lang`` ('other' for a language without a list)."""
    lang = F.lower(F.col("lang"))
    rows = docs.select(
        F.struct("*").alias("_row"),
        text_or_empty().alias("text"),
        F.when(lang.isin(*COMMON_WORDS), lang).otherwise("other").alias("lang"),
    )
    rows = rows.select(
        "*",
        F.length("text").alias("n_chars"),
        F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"),
        F.regexp_replace("text", "[\\p{Ll}\\p{Lo}\\p{Lm}\\p{M}\\p{Nd}]+", "").alias("rest"),
    )
    rows = rows.select(
        "*", F.regexp_replace("rest", BLANKS, "").alias("marks"), F.size("words").alias("n_words"),
    )
    rows = rows.select(
        "*",
        (F.length("rest") - F.length("marks")).alias("n_blank"),
        (F.length("marks") - _length_without(F.col("marks"), "[\\p{Lu}\\p{Lt}]+")).alias("n_upper"),
        (F.length("marks") - _length_without(F.col("marks"), f"[{SYMBOLS}]+")).alias("n_symbols"),
        (F.length("marks") - _length_without(F.col("marks"), "[!\"'(),./:;?@\\[\\]^_`{}~\\\\+=-]+")).alias("n_punct"),
    )
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    rows = rows.select(
        "_row", "text", "lang", "n_chars", "words", "n_words", "n_blank", "n_symbols",
        F.array(
            F.col("n_chars") - F.length("rest"), "n_upper", "n_blank", "n_symbols", "n_punct",
            F.length("marks") - F.col("n_upper") - F.col("n_symbols") - F.col("n_punct"),
        ).alias("classes"),
        F.filter(F.transform("words", lambda w: F.lower(w)), lambda w: w.isin(*listed)).alias("hits"),
    )
    counted, common = F.col("hits"), None
    for lang, words in sorted(COMMON_WORDS.items()):
        found = F.array(*[_count_of(counted, word) for word in words])
        common = F.when(F.col("lang") == lang, found) if common is None else common.when(F.col("lang") == lang, found)
    rows = rows.withColumn("common", common).drop("hits")
    spare = F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, n: a + n)
    return rows.withColumn("common", F.when(F.col("common").isNotNull(), F.concat("common", F.array(spare))))


def references(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per language (five at most): the median share of every class and common word.

    Shares are rounded to four places first, so the exact median needs at most 10,001 counters.
    Only documents long enough for the rule speak. A language without any keeps NULL references,
    and its documents then pass the rule.
    """
    rows = histograms(docs)

    def medians(counts: str, n: int, total: Column, long_enough: Column) -> Column:
        share = [F.when(long_enough, F.round(F.col(counts)[i] / total, 4)) for i in range(n)]
        return F.array(*[F.percentile(s, 0.5) for s in share])

    return rows.groupBy("lang").agg(
        medians("classes", CLASSES, F.col("n_chars"), F.col("n_chars") >= limits.min_chars).alias("ref_classes"),
        medians("common", WORDS_PER_LANGUAGE + 1, F.col("n_words"), F.col("n_words") >= limits.min_words).alias("ref_common"),
    )


def divergence(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon divergence in bits of two histograms, both scaled to one; NULL if either is empty."""
    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + F.coalesce(x.cast("double"), F.lit(0.0)))

    def term(x, y):
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    # zip_with sees one array of (count, total) per side, so that no total is summed per element
    def pair(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    sums = F.struct(total(counts).alias("p"), total(reference).alias("q"))
    joint = F.zip_with(counts, reference, pair)
    folded = F.aggregate(
        joint,
        F.struct(sums["p"].alias("p"), sums["q"].alias("q"), F.lit(0.0).alias("js")),
        lambda a, e: F.struct(a["p"].alias("p"), a["q"].alias("q"), (
            a["js"] + 0.5 * term(e["x"] / a["p"], e["y"] / a["q"]) + 0.5 * term(e["y"] / a["q"], e["x"] / a["p"])
        ).alias("js")),
        lambda a: F.when((a["p"] > 0) & (a["q"] > 0), a["js"]),
    )
    return folded


def repeated_words(rows: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words inside 3-word windows that the text holds twice or more."""
    n = F.size("words")
    rows = rows.withColumn("windows", F.when(n >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)),
    )).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    ))
    rows = rows.withColumn("at", F.array_sort(F.transform(F.filter("sorted", lambda x, k: (
        (F.get("sorted", k + 1)["h"] == x["h"]) | ((k > 0) & (F.get("sorted", F.greatest(k - 1, F.lit(0)))["h"] == x["h"]))
    )), lambda x: x["i"])))
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-9).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0))).drop("windows", "sorted", "at")


def judge(docs: DataFrame, refs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows (as ``_row``) with the base counts, both divergences, ``base_failed`` and ``kept``.

    NULL text is an empty one and fails the base rules; a NULL or unlisted language is compared as
    'other', by character classes only; repeated rows are judged alike; no rows give no rows; any
    further columns stay inside ``_row``.
    """
    rows = repeated_words(histograms(docs)).join(F.broadcast(refs), "lang", "left")
    lines = F.filter(F.split("text", "\n"), lambda s: F.length(F.regexp_replace(s, BLANKS, "")) > 0)
    rows = rows.withColumn("lines", lines)
    rows = rows.select(
        "_row",
        F.col("n_words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("n_blank")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
        F.when(F.col("n_chars") >= limits.min_chars, divergence(F.col("classes"), F.col("ref_classes"))).alias("char_js"),
        F.when(F.col("n_words") >= limits.min_words, divergence(F.col("common"), F.col("ref_common"))).alias("word_js"),
    )
    rows = rows.withColumn("base_failed", (F.col("n_words") < limits.base_words) | (
        100 * F.col("n_repeat_words") > limits.base_repeat_percent * F.col("n_words")
    ))
    diverges = (F.coalesce(F.col("char_js"), F.lit(0.0)) > limits.max_char) | (
        F.coalesce(F.col("word_js"), F.lit(0.0)) > limits.max_word
    )
    return rows.withColumn("kept", ~F.col("base_failed") & ~diverges)


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per document with the counts and the verdict; ``lang`` may be absent."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    docs = docs.select("doc_id", "text", "lang")
    return judge(docs, references(docs, limits), limits).select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", "base_failed", "kept", "char_js", "word_js",
    )


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    source = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    rows = judge(source, references(source, limits), limits)
    # The row number holds the filter above the verdict; pushed below, it would repeat every step of it.
    rows = rows.withColumn("number", F.monotonically_increasing_id()).filter((F.col("number") >= 0) & F.col("kept"))
    return rows.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
