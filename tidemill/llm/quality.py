"""Line-first quality rules, in DataFrame functions only.

Each line is judged by itself (punctuation, navigation, boilerplate, symbols, shouting); failing lines go; then a
document goes if too much of its text went, or if its words break the base rules (too few, too repetitive).

Everything happens inside a row: no shuffle, so no key can be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words are runs of anything but these characters.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
#: A document stays only if its surviving lines hold more than this percentage of its words.
MIN_KEPT_PERCENT = 50
#: Line rules. A line of fewer words than this needs no end mark (headings, verse, lists).
PUNCTUATION_FROM = 8
#: Separators of menus and breadcrumbs: this many, and at least one for so many words.
NAV_MIN, NAV_WORDS = 3, 4
#: Percent of a line's words that hold a symbol, or end in repeated exclamation marks.
MAX_SYMBOL_PERCENT, MAX_SHOUT_PERCENT = 30, 50

# Marks that end or divide sentences, of Latin and Greek, CJK, Arabic and Urdu, Indic, Ethiopic, Burmese, Khmer,
# Tibetan, Armenian and Mongolian script; Thai and Lao are written without any.
END_MARKS = ".!?\u2026:;" "\u3002\uff01\uff1f\uff1a\uff1b\uff0e\uff61" "\u061f\u06d4\u061b" "\u0964\u0965" "\u1362\u1363\u1364\u1365\u1366\u1367\u1368" "\u104a\u104b" "\u17d4\u17d5" "\u0f0d\u0f0e" "\u0589\u055c\u055e" "\u1803"
NO_MARKS = "\u0e00-\u0eff"

# Phrases of licence, consent and navigation lines, matched in lower case.
BOILERPLATE = [
    "all rights reserved",
    "copyright ©",
    "(c) copyright",
    "licensed under",
    "released under the",
    "this work is licensed",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "sign up for our newsletter",
    "subscribe to our",
    "click here to",
    "lorem ipsum",
]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def repeat_words(w: Column) -> Column:
    """Words inside WINDOW-word windows whose text occurs twice or more, each word once.

    A window's key is a 64-bit hash of its words. Only a row with equal keys is sorted.
    """

    def starts(keys: Column) -> Column:
        order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        twice = _let(order, lambda s: F.filter(s, lambda x, j: x["k"].eqNullSafe(F.get(s, j - 1)["k"]) | x["k"].eqNullSafe(F.get(s, j + 1)["k"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(_let(starts(keys), covered))

    def keys(x: Column) -> Column:
        n = F.greatest(F.size(x) - (WINDOW - 1), F.lit(0))
        windows = F.arrays_zip(*[F.slice(x, 1 + i, n) for i in range(WINDOW)])
        return F.transform(windows, lambda y: F.xxhash64(y))

    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(_let(_let(w, keys), counted)).cast("long")


def unpunctuated(line: Column) -> Column:
    """True for a line that is long enough for a sentence and has no end mark anywhere, in a script that has such marks."""
    return ~line.rlike(f"[{END_MARKS}{NO_MARKS}]") & (F.size(words(line)) >= PUNCTUATION_FROM)


def _has_phrase(low: Column) -> Column:
    out = F.lit(False)
    for phrase in BOILERPLATE:
        out = out | low.contains(phrase)
    return out


def line_fails(line: Column) -> Column:
    """True for a line with words that breaks a line rule; blank lines pass."""

    def marks(n: Column) -> Column:
        bars = F.regexp_count(line, F.lit(r"(?:^|\s)(?:[|»›·•]|>{1,2})(?=\s|$)"))
        navigation = (bars >= NAV_MIN) & (bars * NAV_WORDS >= n)
        symbols = F.regexp_count(line, F.lit(r"[#*$%&|<>]+(?=\s|$)")) * 100 > n * MAX_SYMBOL_PERCENT
        shouts = F.regexp_count(line, F.lit(r"!{2,}(?=\s|$)")) * 100 > n * MAX_SHOUT_PERCENT
        return (n > 0) & (navigation | symbols | shouts)

    return unpunctuated(line) | _let(F.size(words(line)), marks) | _let(F.lower(line), _has_phrase)


def suspicious(text: Column) -> Column:
    """Whether any rule but the one on punctuation can concern a line of the text; false for nearly all texts."""
    return text.rlike("[#*$%&|<>\u00bb\u203a\u00b7\u2022]|!!") | _has_phrase(F.lower(text))


def judge(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, cleaned, n_words_cleaned, kept.

    Null text: none, cleaned null, not kept. Empty text or only white space: all counts 0, not kept. Rows are judged each
    for itself, so repeated rows get the same result; an empty table stays empty. Input columns with the names above are
    replaced; all others pass through.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.split(text, "\n")
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = df.withColumns(
        {
            "__words": words(text),
            "__worded": worded,
            "__passed": F.when(suspicious(text), F.filter(lines, lambda x: ~line_fails(x))).otherwise(F.filter(lines, lambda x: ~unpunctuated(x))),
        }
    )
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size("__worded") - F.size(F.array_distinct("__worded"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("__words")),
            "cleaned": F.when(F.col(f"`{text_col}`").isNotNull(), F.array_join("__passed", "\n")),
        }
    )
    out = out.withColumn("n_words_cleaned", F.when(F.size("__passed") == F.size(lines), F.col("n_words")).otherwise(F.size(words(F.coalesce("cleaned", F.lit("")))).cast("long")))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = out.withColumn("base_failed", base_failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words_cleaned") * 100 > F.col("n_words") * MIN_KEPT_PERCENT)).drop("__words", "__worded", "__passed")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict. Null and blank texts have no words and fail; repeated rows get the same result."""
    docs = common.pick(common.table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
