"""Language and provider routing: canonical language keys, pivots, model names, labels and speech codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SPACE, strip

#: Fixed values.
LANGUAGE_ALIASES = {
    "nepali": "nepali",
    "ne": "nepali",
    "tamang": "tamang",
    "tam": "tamang",
    "newari": "newari",
    "newar": "newari",
    "new": "newari",
    "nepal bhasa": "newari",
    "nepal bhasa newari": "newari",
    "newari nepal bhasa": "newari",
    "nepalbhasa": "newari",
}
DISPLAY_NAMES = {"nepali": "Nepali", "tamang": "Tamang", "newari": "Nepal Bhasa (Newari)"}
MODELS = [(1, "groq/whisper-large-v3"), (2, "groq/whisper-large-v3-turbo"), (3, "deepgram/nova-2"), (4, "local/whisper")]
LADDER = [("groq", "whisper-large-v3"), ("groq", "whisper-large-v3-turbo"), ("deepgram", "nova-2"), ("local", "whisper")]
BROWSER_MODEL = "browser-speech-API"
LAYOUT_STRATEGY = "opencv_layout_tesseract"
GUARDED = {"tamang": "Tamang", "newari": "Nepal Bhasa/Newari", "nepali": "Nepali"}
DEFAULT_WHISPER = "tiny"
IMAGE, PDF, WORD_FILE = (".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif"), (".pdf",), (".docx", ".doc")
AUDIO = (".mp3", ".wav", ".m4a", ".ogg", ".webm", ".weba", ".flac")


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language_key(language: Column) -> Column:
    spaced = F.translate(F.lower(F.coalesce(language, F.lit(""))), "()/,+_-", "       ")
    t = strip(F.regexp_replace(spaced, f"{SPACE}+", " "))
    tamang, newari = t.contains("tamang"), t.contains("newari") | t.contains("nepal bhasa")
    known = F.coalesce(lookup(LANGUAGE_ALIASES, t), lookup(LANGUAGE_ALIASES, F.replace(t, F.lit(" "), F.lit(""))), t)
    return F.when(tamang & newari, "auto").when(tamang, "tamang").when(newari, "newari").otherwise(known)


def display_language(language: Column) -> Column:
    own = F.nullif(strip(F.coalesce(language, F.lit(""))), F.lit(""))
    return F.coalesce(lookup(DISPLAY_NAMES, language_key(language)), own, F.lit("Unknown"))


def via_nepali(source: Column, target: Column) -> Column:
    a, b = language_key(source), language_key(target)
    return a.isin("tamang", "newari") & b.isin("tamang", "newari") & (a != b)


def model_trail(names: Column, default: str) -> Column:
    """Distinct names in first-seen order; the default if there is none."""
    kept = F.array_distinct(F.filter(names, lambda n: F.coalesce(n, F.lit("")) != ""))
    return F.when(F.size(kept) > 0, F.array_join(kept, " -> ")).otherwise(F.lit(default))


def provider_label(model: Column) -> Column:
    return (
        F.when(F.coalesce(model, F.lit("")) == "", "Cloud AI")
        .when(model == "browser-speech-API", "Browser-Native Speech API")
        .when(model.contains("groq"), F.concat(F.lit("Groq Whisper ("), F.substring_index(model, "/", -1), F.lit(")")))
        .when(model.contains("deepgram"), "Deepgram Whisper")
        .when(model.contains("local"), "Local Offline Whisper")
        .otherwise(model)
    )


def forced_model(name: Column) -> Column:
    """provider and model of a forced choice: an id, a pair, a provider, a model, or else a provider with the plain model."""
    ids = {str(i): m for i, m in MODELS}
    full = F.when(name.rlike("^[0-9]+$"), F.coalesce(lookup(ids, F.regexp_replace(name, "^0+(?=[0-9])", "")), name)).otherwise(name)
    low = F.lower(full)
    first = {p: m for p, m in reversed(LADDER)}
    owner = {m: p for p, m in reversed(LADDER)}
    provider = F.when(full.contains("/"), F.substring_index(full, "/", 1)).when(lookup(first, low).isNotNull(), low).when(lookup(owner, low).isNotNull(), lookup(owner, low)).otherwise(full)
    model = (
        F.when(full.contains("/"), F.element_at(F.split(full, "/", 2), 2)).when(lookup(first, low).isNotNull(), lookup(first, low)).when(lookup(owner, low).isNotNull(), low).otherwise(F.lit("whisper"))
    )
    return F.struct(provider.alias("provider"), model.alias("model"))


def speech_code(language: Column) -> Column:
    """ne by default; null (detect) only for the pair key."""
    low = F.lower(language)
    return F.when(low == "tamang/newari", F.lit(None).cast("string")).when(low == "hindi", "hi").when(low == "english", "en").otherwise("ne")


def extension(path: Column) -> Column:
    """The lower-cased last suffix of the last path part, as splitext has it (no suffix for a leading dot)."""
    return F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))


def route(ext: Column) -> Column:
    return F.when(ext.isin(*WORD_FILE), "word").when(ext.isin(*PDF), "pdf").when(ext.isin(*IMAGE), "image").when(ext.isin(*AUDIO), "audio").otherwise("rejected")


def psm_strategy(psm: Column, compared: bool = False) -> Column:
    """The name of a run over several segmentation modes, kept after a comparison or at once."""
    name = F.concat(F.lit("tesseract_multi_psm_"), F.replace(psm, F.lit("--"), F.lit("")))
    return F.concat(name, F.lit("_after_doctr_comparison")) if compared else name


def vision_strategy(model: Column, script: Column | None = None) -> Column:
    """The name of a vision answer taken early: for a script that was seen first, or because another script was suspected."""
    if script is None:
        return F.concat(F.lit("gemini_vision_wrong_script_pre_doctr_"), model)
    return F.concat(F.lit("gemini_vision_"), script, F.lit("_preflight_"), model)


def guard_target(language: Column) -> Column:
    """The name of a guarded target language; null for others."""
    return lookup(GUARDED, language_key(language))


def eligible(provider: Column, groq_key: Column, deepgram_key: Column) -> Column:
    return F.when(provider == "groq", groq_key).when(provider == "deepgram", deepgram_key).otherwise(provider == "local")


def source_by_mode(language: Column, mode: Column) -> Column:
    """What is typed in a script is of the language written in it, where the pair is chosen."""
    return F.when((language == "Tamang/Newari") & (mode == "ranjana"), "Newari").when((language == "Tamang/Newari") & (mode == "tamyig"), "Tamang").otherwise(language)


def configured(spark: SparkSession, settings: dict[str, str | None] | None = None) -> DataFrame:
    """provider, enabled and model, from ``settings`` or the session's ``spark.sheafmill.*``: a key switches a hosted provider on."""
    get = settings.get if settings is not None else (lambda k: spark.conf.get(f"spark.sheafmill.{k}", None))
    rows = [("groq", bool(get("groq_api_key")), LADDER[0][1]), ("deepgram", bool(get("deepgram_api_key")), LADDER[2][1]), ("local", True, get("whisper_model") or DEFAULT_WHISPER)]
    return spark.createDataFrame(rows, "provider string, enabled boolean, model string")
