"""Page quality, its bands and gates, and the choice among competing extractions of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

HIGH, MEDIUM = 0.80, 0.62
GATE_SCORE, GATE_CHARS = 0.68, 80


def page_quality(pages: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """``pages`` with the quality columns. One pass over the text; null confidence is 0 and null text is empty; an empty table gives an empty one."""
    conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(confidence).cast("double"), F.lit(0.0))))
    df = T.character_counts(pages, F.col(text)).withColumn("_conf", conf)
    letters = F.col("devanagari_characters") + F.col("latin_characters")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    df = df.withColumns(
        {
            "_coherence": ratio(F.greatest("devanagari_characters", "latin_characters"), letters),
            "_valid": ratio(letters + F.col("_digits"), F.col("character_count")),
            "_single_ratio": F.coalesce(F.try_divide("_single", "word_count"), F.lit(1.0)).cast("double"),
        }
    )
    score = (
        0.60 * F.col("_conf")
        + 0.15 * F.col("_coherence")
        + 0.10 * F.col("_valid")
        + 0.10 * (1 - F.col("_single_ratio"))
        + 0.05 * F.least(F.lit(1.0), F.col("character_count") / 300)
    )
    short = F.when(F.col("character_count") < 40, score * F.col("character_count") / 40).otherwise(score)
    return df.withColumns(
        {
            "score": F.round(short, 4),
            "confidence": F.round("_conf", 4),
            "script_coherence": F.round("_coherence", 4),
            "valid_character_ratio": F.round("_valid", 4),
            "single_character_token_ratio": F.round("_single_ratio", 4),
        }
    ).drop("_digits", "_single", "_conf", "_coherence", "_valid", "_single_ratio")


def quality_status(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def _reasons(*found: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in found]), lambda x: x.isNotNull())


def wrong_script_reasons(q: DataFrame) -> Column:
    """Reasons to suspect another script, in order; none for good or short pages."""
    latin, deva = F.col("latin_characters"), F.col("devanagari_characters")
    few = F.greatest(F.lit(12), (0.18 * latin).cast("int"))
    found = _reasons(
        ((latin >= 80) & (deva <= few), "latin_like_wrong_script_ocr"),
        ((F.col("single_character_token_ratio") >= 0.32) & (F.col("confidence") < 0.58), "fragmented_low_confidence_ocr"),
        ((F.col("valid_character_ratio") < 0.72) & (F.col("confidence") < 0.55), "noisy_low_confidence_ocr"),
    )
    skip = (F.col("score") >= GATE_SCORE) | (F.col("character_count") < GATE_CHARS)
    return F.when(skip, F.array().cast("array<string>")).otherwise(found)


def layout_reasons() -> Column:
    """Of the diagnostics columns: why a regional extraction contradicts the global one. Missing values are 0; gaps count only where the global one leads."""
    v = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    ratio = v("layout_text_length") / F.greatest(F.lit(1.0), v("global_text_length"))
    found = _reasons(
        ((v("layout_text_length") >= v("global_text_length") + 250) & (ratio >= 1.60), "major_candidate_length_disagreement"),
        ((ratio >= 1.35) & (v("layout_quality") < MEDIUM), "layout_candidate_gibberish"),
        ((ratio >= 1.35) & (v("global_confidence") - v("layout_confidence") >= 0.25), "large_layout_confidence_gap"),
        ((ratio >= 2.0) & (v("global_quality") - v("layout_quality") >= 0.15), "possible_global_ocr_omission"),
    )
    on = F.coalesce(F.col("complex_layout"), F.lit(False)) & F.coalesce(F.col("layout_attempted"), F.lit(False))
    return F.when(on, found).otherwise(F.array().cast("array<string>"))


#: What a reviewer is told.
AI_MESSAGE = "Conventional OCR was unreliable, so Gemini Vision produced this transcription. Review it before translating."
LOW_MESSAGE = "OCR quality is low. Review the extracted text or retake the image with even lighting and the page filling the frame."
LAYOUT_MESSAGE = "OCR candidates disagreed substantially on this complex layout. Review the extracted text before translating."


def strategy_label(ai_model: Column, variant: Column, strategy: Column) -> Column:
    """The accepted vision model's, or the variant's in front of what its own run says."""
    own = F.concat(F.lit("adaptive_"), variant, F.lit("+"), F.coalesce(strategy, F.lit("unknown")))
    return F.when(ai_model.isNotNull(), F.concat(F.lit("gemini_vision_fallback_"), ai_model)).otherwise(own)


def review_message(ai_accepted: Column, status: Column, suspicious: Column) -> Column:
    return F.when(ai_accepted, AI_MESSAGE).when(status == "low", LOW_MESSAGE).when(suspicious, LAYOUT_MESSAGE).otherwise("")


def signature(settings: Column) -> Column:
    """name=value of a map's entries, sorted, without those that only debug."""
    kept = F.filter(F.array_sort(F.map_entries(settings)), lambda e: ~e["key"].isin("debug", "debug_output_dir"))
    return F.array_join(F.transform(kept, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def best_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def until_first(rows: DataFrame, keys: list[str], ordinal: str, flag: Column) -> DataFrame:
    """Rows up to and with the first one whose flag holds."""
    before = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_stop", F.coalesce(F.max(flag.cast("int")).over(before), F.lit(0))).filter("_stop = 0").drop("_stop")


def first_success(attempts: DataFrame, keys: list[str], order: str, result: str, ok: str = "ok") -> DataFrame:
    """The result of the first successful attempt by ``order``, and whether there is one."""
    return attempts.groupBy(*keys).agg(
        F.min_by(F.when(F.col(ok), F.col(result)), F.when(F.col(ok), F.col(order))).alias(result), F.coalesce(F.bool_or(ok), F.lit(False)).alias("ok")
    )
