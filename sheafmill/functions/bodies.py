"""JSON bodies as variants: values are told apart by their type, not by how they print.

Edge cases: null and malformed bodies have no values; a missing value and a JSON null are the same; whatever has an unexpected type is left aside, never a failure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: Why a request is rejected, and what an unreadable answer says.
EMPTY_TEXT = "Text for translation cannot be empty"
EMPTY_LIST = "Text list for translation cannot be empty"
NO_TEXT = "Invalid text format. Expected string or list of strings."
UNREADABLE = "Invalid script detection response"
#: Scripts with a reader of their own, and the least confidence that tells one.
SPECIAL = ("ranjana", "prachalit", "tamyig", "tibetan")
SURE = 0.55


def kind(value: Column) -> Column:
    """The type of a variant: STRING, BOOLEAN, BIGINT, ARRAY<...> and so on; null without a value."""
    return F.schema_of_variant(value)


def value_of(body: Column, path: str) -> Column:
    return F.try_variant_get(body, path, "variant")


def text_of(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def truthy(value: Column) -> Column:
    """Whether a value counts as true: not false, 0, "" or an empty list or object."""
    k, shown = kind(value), text_of(value)
    number = k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    full = F.to_json(value)
    out = F.when(k == "BOOLEAN", shown == "true").when(k == "STRING", shown != "").when(number, shown.try_cast("double") != 0).when(k.rlike("^ARRAY"), full != "[]").when(k.rlike("^OBJECT"), full != "{}")
    return F.coalesce(out, F.lit(False))


def request_texts(raw: Column) -> Column:
    """kind ("string", "list" or "other") and texts, the strings of a translation request."""
    value = value_of(F.try_parse_json(raw), "$.text")
    items = F.try_variant_get(value, "$", "array<variant>")
    of_list = F.transform(F.filter(items, lambda x: F.coalesce(kind(x) == "STRING", F.lit(False))), text_of)
    k = F.when(kind(value) == "STRING", "string").when(kind(value).rlike("^ARRAY"), "list").otherwise("other")
    texts = F.when(k == "string", F.array(text_of(value))).when(k == "list", of_list).otherwise(F.array().cast("array<string>"))
    return F.struct(k.alias("kind"), texts.alias("texts"))


def rejection(kind_: Column, texts: Column) -> Column:
    """Why a request is rejected; null if it is not."""
    filled = F.exists(texts, lambda x: ~T.is_blank(x))
    return F.when(kind_ == "other", NO_TEXT).when(~filled & (kind_ == "list"), EMPTY_LIST).when(~filled, EMPTY_TEXT)


def detected_script(raw: Column) -> Column:
    """script, confidence, is_special and reason of a model's answer, fenced or not; what cannot be read is unknown."""

    def read(body: Column) -> Column:
        script, confidence, reason = (value_of(body, f"$.{f}") for f in ("script", "confidence", "reason"))
        name = F.lower(T.strip(F.when(truthy(script), text_of(script)).otherwise("unknown")))
        number = F.when(kind(confidence) == "BOOLEAN", F.when(text_of(confidence) == "true", 1.0).otherwise(0.0)).otherwise(F.coalesce(text_of(confidence).try_cast("double"), F.lit(0.0)))
        why = F.when(body.isNull(), UNREADABLE).otherwise(T.strip(F.when(truthy(reason), text_of(reason)).otherwise("")))
        return F.struct(name.alias("script"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)).alias("sure"), truthy(value_of(body, "$.is_special_lipi")).alias("flag"), why.alias("why"))

    def judged(d: Column) -> Column:
        special = (d["flag"] | d["script"].isin(*SPECIAL)) & (d["sure"] >= SURE)
        return F.struct(d["script"].alias("script"), F.round(d["sure"], 4).alias("confidence"), special.alias("is_special"), d["why"].alias("reason"))

    return T.bound(T.bound(F.try_parse_json(T.clean_transcription(raw)), read), judged)
