"""Variants of a page's extraction worked out only as far as they are needed.

A wave works one variant out for the pages that no earlier wave settled, and hands on what is still open. Each wave is held in the
checkpoint folder: a page is never worked out twice, and a lost executor re-reads it. The driver sees whether a wave leaves anything open.

Edge cases: variants with the settings of an earlier one are passed over; without variants, or without pages, there are no candidates; pages with a null key are never
settled and go through all waves; equal candidates are told apart by the variants' order.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import held
from .quality import HIGH, MEDIUM, best_by


class Variant(NamedTuple):
    """A name, its settings, and the work that gives pages their score, confidence, character_count and strategy."""

    name: str
    settings: dict[str, object]
    work: Callable[[DataFrame], DataFrame]


def signature(settings: dict[str, object]) -> tuple:
    return tuple(sorted((k, str(v)) for k, v in settings.items() if k not in ("debug", "debug_output_dir")))


def settled(first: str) -> Column:
    """A page needs no further variant: a vision model answered, or the first, least processed variant is strong."""
    vision = F.coalesce(F.col("strategy").startswith("gemini_vision_"), F.lit(False))
    return vision | ((F.col("variant") == first) & (F.coalesce("score", F.lit(0.0)) >= HIGH))


def candidates(pages: DataFrame, keys: list[str], variants: list[Variant], done: Column | None = None) -> DataFrame | None:
    """The rows of every variant that was worked out, with variant and ordinal."""
    found, rest, seen = None, pages, set()
    done = done if done is not None else settled(variants[0].name) if variants else None
    for ordinal, v in enumerate(variants):
        if signature(v.settings) in seen:
            continue
        seen.add(signature(v.settings))
        made = held(v.work(rest).withColumns({"variant": F.lit(v.name), "ordinal": F.lit(ordinal)}))
        found = made if found is None else found.unionByName(made)
        rest = held(rest.join(made.filter(done).select(*keys).distinct(), keys, "left_anti"))
        if rest.isEmpty():
            break
    return found


def best(found: DataFrame, keys: list[str]) -> DataFrame:
    """A page's candidate of the greatest score, then confidence, then length; of equals the first."""
    return best_by(found, keys, F.desc("score"), F.desc("confidence"), F.desc("character_count"), F.asc("ordinal"))


def layout_attempted(regions: Column, complex_layout: Column, confidence: Column, threshold: float = 0.85) -> Column:
    """Regions are read one by one where the page has some and is complex, or was read with doubt."""
    return (F.coalesce(regions, F.lit(0)) > 0) & (F.coalesce(complex_layout, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < threshold))


def vision_attempted(score: Column, reasons: Column) -> Column:
    """A vision model is asked at the end for pages of low quality, and for suspicious ones."""
    return (F.coalesce(score, F.lit(0.0)) < MEDIUM) | (F.size(reasons) > 0)
