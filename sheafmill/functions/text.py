"""Column functions on text: counts by character class, stripping, units, slices, chunks and cleaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's isspace has it, and digit characters beyond the decimal category.
SPACE = "[\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
NOT_SPACE = "[^\\s\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
RARE_SPACE = "[\\x1C-\\x1F\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"
SPACES = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
OTHER_DIGITS = (
    "\\u00B2\\u00B3\\u00B9\\u1369-\\u1371\\u19DA\\u2070\\u2074-\\u2079\\u2080-\\u2089\\u2460-\\u2468\\u2474-\\u247C"
    "\\u2488-\\u2490\\u24EA\\u24F5-\\u24FD\\u24FF\\u2776-\\u277E\\u2780-\\u2788\\u278A-\\u2792"
)
#: Lines a scanner application leaves, and answers that mean that nothing was read.
WATERMARKS = ("camscanner", "scanned with camscanner", "scan with camscanner")
EMPTY_ANSWERS = (
    "",
    "no readable text",
    "no text found",
    "no text is visible",
    "the image contains no readable text",
    "unable to transcribe",
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_SPACE)


def spaced(text: Column) -> Column:
    """The text with every white-space character as a space: one regular expression for the rare ones, byte searches for the others."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), RARE_SPACE, " ")
    for c in "\t\n\v\f\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def tokens(text: Column) -> Column:
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def without(text: Column, runs: str) -> Column:
    return F.regexp_replace(text, runs, "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def character_counts(df: DataFrame, text: Column) -> DataFrame:
    """``df`` with character_count, word_count, latin_characters, devanagari_characters, _digits and _single (tokens of at most one letter or number).

    Counts are differences of lengths: a class is taken out in runs, and each class only of what those before it left.
    """
    df = df.withColumn("_spaced", spaced(text))
    df = df.withColumns(
        {
            "_ink": F.replace("_spaced", F.lit(" "), F.lit("")),
            "word_count": F.regexp_count("_spaced", F.lit("[^ ]+")),
            "_long": F.regexp_count("_spaced", F.lit("[\\p{L}\\p{N}][^\\p{L}\\p{N} ]*[\\p{L}\\p{N}][^ ]*")),
        }
    )
    df = df.withColumn("_rest", without(F.col("_ink"), "[A-Za-z]+")).withColumn("_other", without(F.col("_rest"), "[\\u0900-\\u0965\\u0970-\\u097F]+"))
    df = df.withColumns(
        {
            "character_count": F.length("_ink"),
            "latin_characters": F.length("_ink") - F.length("_rest"),
            "devanagari_characters": F.length("_rest") - F.length(without(F.col("_other"), "[\\u0966-\\u096F]+")),
            "_digits": F.length("_other") - F.length(without(F.col("_other"), f"[\\p{{Nd}}{OTHER_DIGITS}]+")),
            "_single": F.col("word_count") - F.col("_long"),
        }
    )
    return df.drop("_spaced", "_ink", "_long", "_rest", "_other")


def characters(text: Column) -> Column:
    return F.length(F.replace(spaced(text), F.lit(" "), F.lit("")))


def without_artifact_lines(page: Column) -> Column:
    """A page without watermark lines; other lines stay as they are and the page is stripped."""
    plain = lambda line: F.regexp_replace(F.lower(strip(line)), f"{SPACE}+", " ")
    kept = F.filter(F.split(page, LINE_ENDS), lambda line: ~plain(line).isin(*WATERMARKS))
    return strip(F.array_join(kept, "\n"))


def units(text: Column) -> Column:
    """Paragraphs if there are several, else lines, else sentences, else the text; stripped, without blank ones. Each split is made once."""
    clean = lambda parts: F.filter(F.transform(parts, strip), lambda p: p != "")
    sentences = lambda t: bound(clean(F.split(t, f"(?<=[\\u0964.!?]){SPACE}+")), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(t)))
    lines = lambda t: bound(clean(F.split(t, LINE_ENDS)), lambda u: F.when(F.size(u) > 1, u).otherwise(sentences(t)))
    paragraphs = lambda t: bound(clean(F.split(t, f"\\n{SPACE}*\\n")), lambda p: F.when(F.size(p) > 1, p).otherwise(lines(t)))
    return bound(strip(F.coalesce(text, F.lit(""))), paragraphs)


def slices(words: Column, size: int) -> Column:
    """Runs of ``size`` words, joined by spaces."""
    n = F.ceil(F.size(words) / size).cast("int")
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice(words, i * size + 1, size), " "))
    )


def chunk_spans(sizes: Column, size: int = 220) -> Column:
    """Spans (lo, hi, whole) of units of so many words: up to ``size`` words a span; a longer unit closes the span and is one of its own, not whole."""
    span = lambda lo, hi, whole: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(whole).alias("whole"))
    none = F.array().cast("array<struct<lo:int,hi:int,whole:boolean>>")
    start = F.struct(none.alias("done"), F.lit(0).alias("lo"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def step(a: Column, n: Column) -> Column:
        at = a["at"]
        closed = F.when(a["lo"] < at, F.concat(a["done"], F.array(span(a["lo"], at, True)))).otherwise(a["done"])
        state = lambda done, lo, held: F.struct(done.alias("done"), lo.alias("lo"), (at + 1).alias("at"), held.alias("n"))
        long_ = state(F.concat(closed, F.array(span(at, at + 1, False))), at + 1, F.lit(0))
        return F.when(n > size, long_).when((a["lo"] < at) & (a["n"] + n > size), state(closed, at, n)).otherwise(state(a["done"], a["lo"], a["n"] + n))

    def finish(a: Column) -> Column:
        return F.when(a["lo"] < a["at"], F.concat(a["done"], F.array(span(a["lo"], a["at"], True)))).otherwise(a["done"])

    return F.aggregate(sizes, start, step, finish)


def greedy_chunks(parts: Column, size: int = 220) -> Column:
    """Units joined by blank lines up to ``size`` words a chunk; a longer unit closes the chunk and is sliced. The fold is over counts alone."""

    def chunks(u: Column) -> Column:
        spans = chunk_spans(F.transform(u, lambda x: F.size(tokens(x))), size)
        joined = lambda s: F.array(F.array_join(F.slice(u, s["lo"] + 1, s["hi"] - s["lo"]), "\n\n"))
        cut = lambda s: bound(tokens(F.get(u, s["lo"])), lambda w: slices(w, size))
        return F.flatten(F.transform(spans, lambda s: F.when(s["whole"], joined(s)).otherwise(cut(s))))

    return bound(parts, chunks)


def compact_context(text: Column, n_chunks: Column, most: int = 1800) -> Column:
    """Null for one chunk; else the text with single spaces, whole or its first and last half of ``most`` characters."""
    flat = strip(F.regexp_replace(text, f"{SPACE}+", " "))
    half = most // 2
    return F.when(n_chunks <= 1, F.lit(None).cast("string")).when(F.length(flat) <= most, flat).otherwise(
        F.concat(F.left(flat, F.lit(half)), F.lit(" ... "), F.right(flat, F.lit(half)))
    )


def unfenced(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    inner = strip(F.regexp_replace(F.regexp_replace(t, "^```[^\\n]*\\n?", ""), f"(^|\\n){SPACE}*```$", ""))
    return F.when(t.startswith("```") & t.endswith("```"), inner).otherwise(t)


def clean_transcription(text: Column) -> Column:
    t = unfenced(text)
    plain = F.regexp_replace(F.regexp_replace(F.lower(t), "^[ .\\[\\]]+|[ .\\[\\]]+$", ""), f"{SPACE}+", " ")
    return F.when(plain.isin(*EMPTY_ANSWERS), F.lit("")).otherwise(t)


def has_devanagari(text: Column) -> Column:
    return F.coalesce(text.rlike("[\\u0900-\\u097F]"), F.lit(False))


def shown(many: Column, one: Column) -> Column:
    """A list with blank lines between its items, else the text, else nothing."""
    return F.coalesce(F.array_join(many, "\n\n"), one, F.lit(""))


def joined_blocks(lines: Column) -> Column:
    """The text of ``lines`` (array of structs with block and t, in order): a newline between lines of a block, an empty line between blocks; without lines, empty."""
    before = F.concat(F.array(F.lit(-1).cast("long")), F.transform(lines, lambda x: x["block"]))
    first = lambda x, b: F.when(b == -1, "").when(b == x["block"], "\n").otherwise("\n\n")
    return F.array_join(F.zip_with(lines, before, lambda x, b: F.concat(first(x, b), x["t"])), "")
