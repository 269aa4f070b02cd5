"""Line-first quality rules: judge each line, drop the failing ones, reject documents that lose too much.

Only DataFrame functions. Every rule looks at one row, so the plan is a scan and a projection without a shuffle.

Edge cases: null or empty text has no words, fails the base rules and is cleaned to itself; a very long text is one
row's arrays; repeated rows are judged alike; an empty table gives an empty result; other columns pass through, and
the names this module adds replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, fresh, swapped, words_of

SYMBOLS = "#*$%&|<>"
#: Fixed phrases of page furniture (lower case).
FURNITURE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "privacy policy",
    "sign in to continue",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "we use cookies",
)
FURNITURE_RULE = f"(?i){'|'.join(FURNITURE)}"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


def _without(text: Column, chars: str) -> Column:
    return swapped(text, chars, "")


def _line_fails(line: Column, words: Column, nav_share: float, symbol_share: float, shout_share: float) -> Column:
    """Navigation: separators for a large part of the words. Boilerplate: symbols, fixed phrases. Punctuation: '!!'."""
    chars = F.length(_without(line, BLANKS))
    pipes = F.length(line) - F.length(_without(line, "|"))
    symbols = F.length(line) - F.length(_without(line, SYMBOLS))
    shouts = (F.length(line) - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    furniture = line.rlike(FURNITURE_RULE)
    return (chars > 0) & (
        ((pipes > 0) & (pipes >= nav_share * words))
        | (symbols > symbol_share * chars)
        | ((shouts > 0) & (shouts >= shout_share * words))
        | ((words <= 12) & furniture)
    )


def _mask(size: Column) -> Column:
    """Low bits enough for the positions of an array of this size."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(size + 2)).cast("int")) - 1


def _packed(hashes: str, mask: str) -> Column:
    """Sorted longs: the high bits of each hash, then its position. One primitive sort brings equal hashes together."""
    return F.sort_array(
        F.transform(hashes, lambda x, i: F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(F.col(mask))).bitwiseOR(i.cast("long")))
    )


def _same(hashes: str, mask: Column, a: Column, b: Column) -> Column:
    """Whether two packed entries stand for the same whole hash; false beyond the ends."""
    h = F.col(hashes)
    equal = F.get(h, a.bitwiseAND(mask).cast("int")) == F.get(h, b.bitwiseAND(mask).cast("int"))
    return F.coalesce(equal, F.lit(False))


def quality_metrics(
    docs: DataFrame,
    text: str = "text",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    nav_share: float = 0.2,
    symbol_share: float = 0.1,
    shout_share: float = 0.5,
    max_lost_share: float = 0.4,
) -> DataFrame:
    """``docs`` with METRICS and ``clean_text``: the text without failing lines and repeated lines."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = lambda x: _without(x, BLANKS) == ""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in (*METRICS, "clean_text")]
    df = docs.select(*own, words_of(F.col(text)).alias("__w"), F.split(t, "\n").alias("__l"))
    w, lines = F.col("__w"), F.col("__l")
    spoken = F.filter(lines, lambda x: ~blank(x))
    df = df.select(
        *own,
        "__l",
        spoken.alias("__spoken"),
        F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), 1, F.greatest(F.size(w) - 2, F.lit(0))).alias("__h"),
        F.size(w).cast("long").alias("n_words"),
        (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *own, "__l", "__h", "n_words", "n_symbols", (F.size("__spoken") - F.size(F.array_distinct("__spoken"))).cast("long").alias("n_dup_lines")
    )
    # A line can only fail in a text that has symbols, shouts, furniture or equal lines: other texts stay as they are.
    low, dirty = F.col("__low"), F.col("n_symbols") + F.col("n_dup_lines") > 0
    for phrase in ("!!", *FURNITURE):
        dirty |= low.contains(phrase)
    df = df.select("*", F.lower(t).alias("__low"))
    df = df.select(
        *own,
        "__h",
        "n_words",
        "n_symbols",
        "n_dup_lines",
        F.when(dirty, F.col("__l")).alias("__l"),
        _mask(F.size("__h")).alias("__m"),
        _mask(F.size("__l")).alias("__lm"),
    )
    df = df.select(
        *own,
        *("__h", "n_words", "n_symbols", "n_dup_lines", "__l", "__m", "__lm"),
        F.transform(lines, lambda x: F.size(words_of(x))).alias("__line_words"),
        _packed("__h", "__m").alias("__p"),
        F.when(F.col("n_dup_lines") > 0, F.transform(lines, lambda x: F.xxhash64(x))).alias("__lh"),
    )
    p, m, lp, lm = F.col("__p"), F.col("__m"), F.col("__lp"), F.col("__lm")
    df = df.select(
        *own,
        *("__h", "n_words", "n_symbols", "n_dup_lines", "__l", "__m", "__lm", "__line_words", "__lh"),
        F.filter(p, lambda e, k: (e - F.get(p, k - 1) <= m) | (F.get(p, k + 1) - e <= m)).alias("__q"),
        _packed("__lh", "__lm").alias("__lp"),
    )
    q = F.col("__q")
    df = df.select(
        *own,
        *("n_words", "n_symbols", "n_dup_lines", "__l", "__line_words"),
        F.sort_array(
            F.transform(F.filter(q, lambda e, k: _same("__h", m, e, F.get(q, k - 1)) | _same("__h", m, e, F.get(q, k + 1))), lambda e: e.bitwiseAND(m))
        ).alias("__i"),
        F.sort_array(
            F.transform(lp, lambda e, k: 2 * e.bitwiseAND(lm) + F.when(_same("__lh", lm, e, F.get(lp, k - 1)), 1).otherwise(0))
        ).alias("__line_again"),
    )
    at = F.col("__i")
    df = df.select(
        *own,
        *("n_words", "n_symbols", "n_dup_lines"),
        F.length(_without(t, BLANKS)).cast("long").alias("word_chars"),
        F.aggregate(F.transform(at, lambda q, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - q, F.lit(3)))), F.lit(0).cast("long"), lambda x, y: x + y).alias("n_repeat_words"),
        "__l",
        F.filter(
            lines,
            lambda x, i: ~(
                _line_fails(x, F.get(F.col("__line_words"), i), nav_share, symbol_share, shout_share)
                | ((F.coalesce(F.get(F.col("__line_again"), i), F.lit(0)) % 2 == 1) & ~blank(x))
            ),
        ).alias("__kept_lines"),
    )
    df = df.withColumn(
        "clean_text",
        F.when(F.col("__l").isNull() | (F.size("__kept_lines") == F.size("__l")), F.col(text)).otherwise(F.array_join("__kept_lines", "\n")),
    ).drop("__kept_lines", "__l")
    df = df.withColumns(
        {
            "lost_chars": F.col("word_chars") - F.length(_without(F.coalesce("clean_text", F.lit("")), BLANKS)),
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    whole = F.col("lost_chars") <= max_lost_share * F.col("word_chars")
    df = df.withColumn("kept", ~F.col("base_failed") & whole)
    # A generated row holds the results: else a filter on one of them is pushed down into the arrays and worked out anew for every element.
    held = F.explode(F.array(F.struct(*METRICS, "clean_text"))).alias("__held")
    return df.select(*own, held).select(*own, "__held.*")


def clean_documents(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The documents that pass, with their failing lines removed and the columns they came with."""
    others = F.struct(F.lit(0).alias(fresh(docs, "__")[0]), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("__doc")
    judged = quality_metrics(docs.select(F.col(text).alias("__text"), others), "__text", **rules).filter("kept")
    return judged.select(*[F.col("clean_text").alias(text) if c == text else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
