"""Queries on attempts, candidates, routing, request parsing and responses. Attempts and candidates are ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bodies as B
from ..functions import routing as R
from ..functions import text as T
from ..operators import quality as Q
from .registry import query, table

#: Fixed value: what is said where records could not be saved.
SKIPPED = "Database unavailable; processed without saving records"
CANDIDATES = """c AS (SELECT user_id AS page_id, event_id AS ordinal, event_type AS variant, round(value, 0) AS score, (event_id % 7) / 7.0::double AS confidence, (event_id * 31 % 500)::bigint AS character_count FROM events)"""


def candidates(spark, sf):
    e, i = table(spark, sf, "events"), F.col("event_id")
    return e.select(
        F.col("user_id").alias("page_id"),
        i.alias("ordinal"),
        F.col("event_type").alias("variant"),
        F.round("value", 0).alias("score"),
        ((i % 7) / 7.0).alias("confidence"),
        (i * 31 % 500).alias("character_count"),
    )


def attempts(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        (F.col("event_id") % 500).alias("item_id"), F.col("event_id").alias("priority"), F.concat(F.lit("m"), "event_id").alias("model"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_s")
    )


@query(f"WITH {CANDIDATES} SELECT page_id, ordinal, variant, score, character_count FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, character_count DESC, ordinal) = 1")
def psm_top1(spark, sf):
    best = Q.best_by(candidates(spark, sf), ["page_id"], F.desc("score"), F.desc("character_count"), F.asc("ordinal"))
    return best.select("page_id", "ordinal", "variant", "score", "character_count")


@query(f"WITH {CANDIDATES} SELECT page_id, ordinal, variant FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, confidence DESC, character_count DESC, ordinal) = 1")
def variant_top1(spark, sf):
    best = Q.best_by(candidates(spark, sf), ["page_id"], F.desc("score"), F.desc("confidence"), F.desc("character_count"), F.asc("ordinal"))
    return best.select("page_id", "ordinal", "variant")


@query(f"WITH {CANDIDATES}, s AS (SELECT *, coalesce(max((variant = 'purchase')::int) OVER (PARTITION BY page_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stop FROM c) SELECT page_id, ordinal, variant FROM s WHERE stop = 0")
def variant_early_stop(spark, sf):
    return Q.until_first(candidates(spark, sf), ["page_id"], "ordinal", F.col("variant") == "purchase").select("page_id", "ordinal", "variant")


ATTEMPTS = "a AS (SELECT event_id % 500 AS item_id, event_id AS priority, 'm' || event_id AS model, event_type <> 'error' AS ok, value AS latency_s FROM events)"


@query(f"WITH {ATTEMPTS} SELECT item_id, arg_min(model, priority) FILTER (ok) AS model, bool_or(ok) AS ok FROM a GROUP BY item_id")
def provider_fallback(spark, sf):
    return Q.first_success(attempts(spark, sf), ["item_id"], "priority", "model")


@query(f"WITH {ATTEMPTS} SELECT item_id, model, latency_s FROM a WHERE ok QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY latency_s, priority) = 1")
def provider_race(spark, sf):
    a = attempts(spark, sf).filter("ok")
    best = a.groupBy("item_id").agg(F.min_by(F.struct("model", "latency_s"), F.struct("latency_s", "priority")).alias("b"))
    return best.select("item_id", "b.model", "b.latency_s")


@query(f"WITH {CANDIDATES}, k AS (SELECT *, 'max=' || CASE WHEN ordinal % 3 = 0 THEN '1000' ELSE '2500' END || ';resize=' || CASE WHEN ordinal % 2 = 0 THEN 'false' ELSE 'true' END AS signature FROM c) SELECT page_id, signature, min(ordinal) AS ordinal FROM k GROUP BY ALL")
def config_dedupe(spark, sf):
    """The first candidate of each signature: its settings sorted by name, without those for debugging."""
    i = F.col("ordinal")
    settings = F.create_map(F.lit("resize"), F.when(i % 2 == 0, "false").otherwise("true"), F.lit("max"), F.when(i % 3 == 0, "1000").otherwise("2500"), F.lit("debug"), F.col("variant"), F.lit("debug_output_dir"), i.cast("string"))
    c = candidates(spark, sf).withColumn("signature", Q.signature(settings))
    return Q.best_by(c, ["page_id", "signature"], F.asc("ordinal")).select("page_id", "signature", "ordinal")


@query(f"WITH {CANDIDATES}, o AS (SELECT page_id, ordinal, variant, row_number() OVER (PARTITION BY page_id, variant ORDER BY ordinal) AS k FROM c) SELECT page_id, string_agg(variant, ' -> ' ORDER BY ordinal) AS trail FROM o WHERE k = 1 GROUP BY page_id")
def model_trail(spark, sf):
    c = candidates(spark, sf).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "variant"))).alias("s"))
    return c.select("page_id", R.model_trail(F.transform("s", lambda s: s["variant"]), "default-model").alias("trail"))


@query("""WITH a AS (SELECT event_id, (event_id % 97) / 97.0::double AS best, (event_id % 89) / 89.0::double AS layout, event_id * 13 % 700 AS best_len, event_id * 17 % 800 AS layout_len, event_id % 3 = 0 AS suspicious FROM events)
SELECT event_id, layout_len >= 80 AND (event_id % 11 = 0 OR layout >= best + 0.02 OR (layout >= best - 0.01 AND layout_len >= trunc(best_len * 1.15))) AS layout_accepted,
  event_id % 11 > 0 AND best_len > 100 AND best >= 0.62 AS fast_accepted,
  CASE WHEN suspicious THEN layout >= greatest(0.76, best - 0.12) ELSE layout >= greatest(0.66, best + 0.06) END AND layout_len >= greatest(5, trunc(best_len * CASE WHEN suspicious THEN 0.75 ELSE 0.50 END)) AS vision_accepted FROM a""")
def candidate_acceptance(spark, sf):
    i = F.col("event_id")
    a = table(spark, sf, "events").select(
        i, ((i % 97) / 97.0).alias("best"), ((i % 89) / 89.0).alias("layout"), (i * 13 % 700).alias("best_len"), (i * 17 % 800).alias("layout_len"), (i % 3 == 0).alias("suspicious")
    )
    best, layout, n, m = F.col("best"), F.col("layout"), F.col("best_len"), F.col("layout_len")
    least = F.greatest(F.lit(5), (n * F.when(F.col("suspicious"), 0.75).otherwise(0.50)).cast("long"))
    clear = F.when(F.col("suspicious"), layout >= F.greatest(F.lit(0.76), best - 0.12)).otherwise(layout >= F.greatest(F.lit(0.66), best + 0.06))
    return a.select(
        i,
        ((m >= 80) & ((i % 11 == 0) | (layout >= best + 0.02) | ((layout >= best - 0.01) & (m >= (n * 1.15).cast("long"))))).alias("layout_accepted"),
        ((i % 11 > 0) & (n > 100) & (best >= Q.MEDIUM)).alias("fast_accepted"),
        (clear & (m >= least)).alias("vision_accepted"),
    )


@query(f"""WITH a AS (SELECT event_id, round((event_id % 9973) / 9973.0::double, 4) AS score, CASE WHEN event_id % 5 = 0 THEN 'model-' || (event_id % 4) END AS ai, event_id % 3 = 0 AS suspicious, event_type AS variant, CASE WHEN event_id % 4 > 0 THEN 'opencv_layout_tesseract' END AS run FROM events),
s AS (SELECT *, CASE WHEN score >= 0.80 THEN 'high' WHEN score >= 0.62 THEN 'medium' ELSE 'low' END AS status FROM a)
SELECT event_id, status, CASE WHEN ai IS NOT NULL THEN 'gemini_vision_fallback_' || ai ELSE 'adaptive_' || variant || '+' || coalesce(run, 'unknown') END AS strategy, status = 'low' OR ai IS NOT NULL OR suspicious AS review_required,
  CASE WHEN ai IS NOT NULL THEN 'Conventional OCR was unreliable, so Gemini Vision produced this transcription. Review it before translating.'
    WHEN status = 'low' THEN 'OCR quality is low. Review the extracted text or retake the image with even lighting and the page filling the frame.'
    WHEN suspicious THEN 'OCR candidates disagreed substantially on this complex layout. Review the extracted text before translating.' ELSE '' END AS message FROM s""")
def review_label(spark, sf):
    """Strategy label, review flag and message of a page after a vision answer was or was not accepted."""
    i = F.col("event_id")
    a = table(spark, sf, "events").select(
        i,
        Q.quality_status(F.round((i % 9973) / 9973.0, 4)).alias("status"),
        F.when(i % 5 == 0, F.concat(F.lit("model-"), (i % 4).cast("string"))).alias("ai"),
        (i % 3 == 0).alias("suspicious"),
        F.col("event_type").alias("variant"),
        F.when(i % 4 > 0, "opencv_layout_tesseract").alias("run"),
    )
    accepted = F.col("ai").isNotNull()
    return a.select(
        "event_id",
        "status",
        Q.strategy_label(F.col("ai"), F.col("variant"), F.col("run")).alias("strategy"),
        ((F.col("status") == "low") | accepted | F.col("suspicious")).alias("review_required"),
        Q.review_message(accepted, F.col("status"), F.col("suspicious")).alias("message"),
    )


LANGUAGES = ["Nepali", "ne", "Tamang (tam)", "Newari", "Nepal-Bhasa", "Tamang/Newari", "new", "English", "  ", "nepal_bhasa+tamang", "TAM", "Hindi"]
PICK = "CASE " + " ".join(f"WHEN doc_id % 12 = {i} THEN '{v}'" for i, v in enumerate(LANGUAGES)) + " END"
NORMAL = r"trim(regexp_replace(translate(lower({x}), '()/,+_-', '       '), '\s+', ' ', 'g'))"
KEY = """CASE WHEN contains({t}, 'tamang') AND (contains({t}, 'newari') OR contains({t}, 'nepal bhasa')) THEN 'auto' WHEN contains({t}, 'tamang') THEN 'tamang' WHEN contains({t}, 'newari') OR contains({t}, 'nepal bhasa') THEN 'newari'
 WHEN {t} IN ('nepali', 'ne') THEN 'nepali' WHEN {t} = 'tam' THEN 'tamang' WHEN {t} IN ('newar', 'new', 'nepalbhasa') THEN 'newari' ELSE {t} END"""


def languages(spark, sf):
    raw = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("doc_id") % 12 + 1).cast("int"))
    other = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.floor(F.col("doc_id") / 12) % 12 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", raw.alias("raw"), other.alias("other"))


@query(f"WITH r AS (SELECT doc_id, {PICK} AS raw FROM documents), n AS (SELECT *, {NORMAL.format(x='raw')} AS t FROM r), k AS (SELECT *, {KEY.format(t='t')} AS key FROM n) SELECT doc_id, raw, key, CASE key WHEN 'nepali' THEN 'Nepali' WHEN 'tamang' THEN 'Tamang' WHEN 'newari' THEN 'Nepal Bhasa (Newari)' ELSE coalesce(nullif(trim(raw), ''), 'Unknown') END AS display FROM k")
def language_canonical(spark, sf):
    return languages(spark, sf).select("doc_id", "raw", R.language_key(F.col("raw")).alias("key"), R.display_language(F.col("raw")).alias("display"))


@query(f"WITH r AS (SELECT doc_id, {PICK} AS raw, {PICK.replace('doc_id % 12', 'doc_id // 12 % 12')} AS other FROM documents), n AS (SELECT *, {NORMAL.format(x='raw')} AS t, {NORMAL.format(x='other')} AS u FROM r), k AS (SELECT *, {KEY.format(t='t')} AS a, {KEY.format(t='u')} AS b FROM n) SELECT doc_id, raw, other, a IN ('tamang', 'newari') AND b IN ('tamang', 'newari') AND a <> b AS via_nepali FROM k")
def pivot_routing(spark, sf):
    return languages(spark, sf).select("doc_id", "raw", "other", R.via_nepali(F.col("raw"), F.col("other")).alias("via_nepali"))


@query(f"WITH r AS (SELECT doc_id, {PICK} AS raw FROM documents) SELECT doc_id, raw, CASE lower(raw) WHEN 'tamang/newari' THEN NULL WHEN 'hindi' THEN 'hi' WHEN 'english' THEN 'en' ELSE 'ne' END AS code, CASE WHEN lower(raw) = 'tamang/newari' THEN 'detect' WHEN lower(raw) IN ('hindi', 'english') THEN 'nova-2' ELSE 'whisper-large' END AS speech_model, CASE WHEN lower(raw) = 'english' THEN 'en-US' WHEN lower(raw) = 'hindi' THEN 'hi-IN' ELSE 'ne-NP' END AS locale FROM r")
def speech_language(spark, sf):
    low, code = F.lower("raw"), R.speech_code(F.col("raw"))
    return languages(spark, sf).select(
        "doc_id",
        "raw",
        code.alias("code"),
        F.when(code.isNull(), "detect").when(code == "ne", "whisper-large").otherwise("nova-2").alias("speech_model"),
        F.when(low == "english", "en-US").when(low == "hindi", "hi-IN").otherwise("ne-NP").alias("locale"),
    )


FORCED = ["1", "3", "9", "groq/whisper-large-v3", "a/b/c", "Groq", "deepgram", "nova-2", "Whisper", "custom"]


def forced(spark, sf):
    return table(spark, sf, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in FORCED]), (F.col("event_id") % 10 + 1).cast("int")).alias("name"))


FORCED_SQL = "f AS (SELECT event_id, CASE " + " ".join(f"WHEN event_id % 10 = {i} THEN '{v}'" for i, v in enumerate(FORCED)) + " END AS name FROM events)"
DIMENSION = "m(id, model_name) AS (VALUES (1, 'groq/whisper-large-v3'), (2, 'groq/whisper-large-v3-turbo'), (3, 'deepgram/nova-2'), (4, 'local/whisper'))"


@query(f"""WITH {FORCED_SQL}, {DIMENSION}, e AS (SELECT event_id, name, coalesce(model_name, name) AS whole FROM f LEFT JOIN m ON try_cast(name AS int) = id)
SELECT event_id, name, CASE WHEN contains(whole, '/') THEN split_part(whole, '/', 1) WHEN lower(whole) IN ('groq', 'deepgram', 'local') THEN lower(whole) WHEN lower(whole) IN ('whisper-large-v3', 'whisper-large-v3-turbo') THEN 'groq' WHEN lower(whole) = 'nova-2' THEN 'deepgram' WHEN lower(whole) = 'whisper' THEN 'local' ELSE whole END AS provider,
 CASE WHEN contains(whole, '/') THEN substr(whole, strpos(whole, '/') + 1) WHEN lower(whole) = 'groq' THEN 'whisper-large-v3' WHEN lower(whole) = 'deepgram' THEN 'nova-2' WHEN lower(whole) = 'local' THEN 'whisper' WHEN lower(whole) IN ('whisper-large-v3', 'whisper-large-v3-turbo', 'nova-2', 'whisper') THEN lower(whole) ELSE 'whisper' END AS model FROM e""")
def force_model_parse(spark, sf):
    return forced(spark, sf).withColumn("p", R.forced_model(F.col("name"))).select("event_id", "name", "p.provider", "p.model")


@query(f"WITH {DIMENSION} SELECT id, model_name, split_part(model_name, '/', 1) AS provider FROM m")
def model_dimension(spark, sf):
    m = spark.createDataFrame(R.MODELS, "id int, model_name string")
    return m.withColumn("provider", F.substring_index("model_name", "/", 1))


@query(f"WITH {DIMENSION} SELECT event_id, event_id % 7 AS wanted, coalesce(model_name, (event_id % 7)::varchar) AS model FROM events LEFT JOIN m ON id = event_id % 7")
def model_lookup(spark, sf):
    m = spark.createDataFrame(R.MODELS, "id int, model_name string")
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 7).alias("wanted"))
    return e.join(F.broadcast(m), F.col("wanted") == F.col("id"), "left").select("event_id", "wanted", F.coalesce("model_name", F.col("wanted").cast("string")).alias("model"))


@query(f"WITH {FORCED_SQL} SELECT event_id, CASE WHEN contains(name, 'groq') THEN 'Groq Whisper (' || regexp_extract(name, '[^/]*$') || ')' WHEN contains(name, 'deepgram') THEN 'Deepgram Whisper' WHEN contains(name, 'local') THEN 'Local Offline Whisper' ELSE name END AS label FROM f")
def provider_label(spark, sf):
    return forced(spark, sf).select("event_id", R.provider_label(F.col("name")).alias("label"))


@query(r"""WITH u AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN url || '.PDF' WHEN 1 THEN 'scan.' || page_id || '.jpeg' WHEN 2 THEN 'a/b.docx' WHEN 3 THEN '.png' WHEN 4 THEN 'talk.mp3' ELSE url END AS path FROM pages),
e AS (SELECT *, lower(regexp_extract(path, '[^/.](\.[^./]+)$', 1)) AS ext FROM u)
SELECT page_id, ext, CASE WHEN ext IN ('.docx', '.doc') THEN 'word' WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.png', '.jpg', '.jpeg', '.bmp', '.tiff', '.tif') THEN 'image' WHEN ext IN ('.mp3', '.wav', '.m4a', '.ogg', '.webm', '.weba', '.flac') THEN 'audio' ELSE 'rejected' END AS route FROM e""")
def route_by_extension(spark, sf):
    k = F.col("page_id") % 6
    path = (
        F.when(k == 0, F.concat("url", F.lit(".PDF")))
        .when(k == 1, F.concat(F.lit("scan."), F.col("page_id").cast("string"), F.lit(".jpeg")))
        .when(k == 2, "a/b.docx")
        .when(k == 3, ".png")
        .when(k == 4, "talk.mp3")
        .otherwise(F.col("url"))
    )
    p = table(spark, sf, "pages").select("page_id", R.extension(path).alias("ext"))
    return p.withColumn("route", R.route(F.col("ext")))


@query("""WITH w AS (SELECT * FROM (VALUES ('nep'), ('eng'), ('hin'), ('new')) t(lang)), a AS (SELECT DISTINCT user_id, CASE event_type WHEN 'view' THEN 'nep' WHEN 'click' THEN 'eng' WHEN 'purchase' THEN 'hin' ELSE 'osd' END AS lang FROM events),
u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, string_agg(w.lang, ', ' ORDER BY w.lang) AS missing FROM u CROSS JOIN w LEFT JOIN a ON a.user_id = u.user_id AND a.lang = w.lang WHERE a.lang IS NULL GROUP BY u.user_id""")
def missing_language_packs(spark, sf):
    """Requested packs that are not installed, sorted."""
    pack = F.when(F.col("event_type") == "view", "nep").when(F.col("event_type") == "click", "eng").when(F.col("event_type") == "purchase", "hin").otherwise("osd")
    have = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(pack).alias("have"))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in ("nep", "eng", "hin", "new")]), "have")), ", ").alias("missing"))


@query("SELECT event_id, 'resize=' || CASE WHEN event_id % 2 = 0 THEN 'false' ELSE 'true' END || ';max=' || CASE WHEN event_id % 3 = 0 THEN '1000' ELSE '2500' END || ';debug=' || event_type AS config FROM events")
def config_merge(spark, sf):
    """Defaults overridden key by key; the right side wins."""
    base = F.create_map(F.lit("resize"), F.lit("true"), F.lit("max"), F.lit("2500"))
    i = F.col("event_id")
    over = F.create_map(F.lit("resize"), F.when(i % 2 == 0, "false"), F.lit("max"), F.when(i % 3 == 0, "1000"), F.lit("debug"), F.col("event_type"))
    merged = F.map_zip_with(base, over, lambda k, a, b: F.coalesce(b, a))
    pair = lambda k: F.concat(F.lit(f"{k}="), F.try_element_at("m", F.lit(k)))
    return table(spark, sf, "events").select("event_id", merged.alias("m")).select("event_id", F.concat_ws(";", pair("resize"), pair("max"), pair("debug")).alias("config"))


@query("""WITH r AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN '{"script": " Ranjana ", "confidence": 0.' || (event_id % 90 + 10) || ', "is_special_lipi": false, "reason": " seen "}' WHEN 1 THEN '```json' || chr(10) || '{"script": "devanagari", "confidence": "1.7"}' || chr(10) || '```' WHEN 2 THEN 'not json'
  WHEN 3 THEN '{"confidence": "x", "is_special_lipi": true}' WHEN 4 THEN '{"script": "tibetan", "confidence": 0.54}' WHEN 5 THEN '{"script": "", "confidence": 0.9, "is_special_lipi": 1}' WHEN 6 THEN '{"script": "latin", "confidence": 0.8, "is_special_lipi": "no"}' WHEN 7 THEN '{"script": null, "confidence": null, "is_special_lipi": 0}' ELSE '{"script": "latin", "confidence": true, "is_special_lipi": [""]}' END AS raw FROM events),
j AS (SELECT event_id, event_id % 9 = 2 AS bad, CASE WHEN event_id % 9 = 2 THEN NULL ELSE regexp_extract(raw, '((?s)[{].*[}])', 1)::json END AS j FROM r),
f AS (SELECT event_id, bad, lower(trim(coalesce(nullif(j ->> 'script', ''), 'unknown'))) AS script, greatest(0.0, least(1.0, CASE j ->> 'confidence' WHEN 'true' THEN 1.0 ELSE coalesce(try_cast(j ->> 'confidence' AS double), 0.0) END)) AS c,
  CASE json_type(j -> 'is_special_lipi') WHEN 'BOOLEAN' THEN (j ->> 'is_special_lipi') = 'true' WHEN 'UBIGINT' THEN (j ->> 'is_special_lipi') <> '0' WHEN 'VARCHAR' THEN (j ->> 'is_special_lipi') <> '' WHEN 'ARRAY' THEN json_array_length(j -> 'is_special_lipi') > 0 ELSE false END AS flag, trim(coalesce(j ->> 'reason', '')) AS reason FROM j)
SELECT event_id, script, round(c, 4)::double AS confidence, (coalesce(flag, false) OR script IN ('ranjana', 'prachalit', 'tamyig', 'tibetan')) AND c >= 0.55 AS is_special, CASE WHEN bad THEN 'Invalid script detection response' ELSE reason END AS reason FROM f""")
def script_detection_parse(spark, sf):
    i = F.col("event_id") % 9
    raw = (
        F.when(i == 0, F.concat(F.lit('{"script": " Ranjana ", "confidence": 0.'), (F.col("event_id") % 90 + 10).cast("string"), F.lit(', "is_special_lipi": false, "reason": " seen "}')))
        .when(i == 1, F.lit('```json\n{"script": "devanagari", "confidence": "1.7"}\n```'))
        .when(i == 2, "not json")
        .when(i == 3, '{"confidence": "x", "is_special_lipi": true}')
        .when(i == 4, '{"script": "tibetan", "confidence": 0.54}')
        .when(i == 5, '{"script": "", "confidence": 0.9, "is_special_lipi": 1}')
        .when(i == 6, '{"script": "latin", "confidence": 0.8, "is_special_lipi": "no"}')
        .when(i == 7, '{"script": null, "confidence": null, "is_special_lipi": 0}')
        .otherwise('{"script": "latin", "confidence": true, "is_special_lipi": [""]}')
    )
    return table(spark, sf, "events").select("event_id", B.detected_script(raw).alias("d")).select("event_id", "d.*")


@query(r"""WITH b AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '{"text": ' || to_json(coalesce(text, '')) || '}' WHEN 1 THEN '{"text": "  "}' WHEN 2 THEN '{"text": [' || to_json(coalesce(text, '')) || ', "' || lang || '"]}' WHEN 3 THEN '{"text": [" ", 5, null]}' WHEN 4 THEN '{"text": 7}' WHEN 5 THEN '{"source_lang": "ne"}' ELSE '{"text": [1, ' || to_json(coalesce(text, '')) || ', []]}' END AS body FROM documents),
k AS (SELECT doc_id, CASE json_type(body::json -> 'text') WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'list' ELSE 'other' END AS kind, CASE json_type(body::json -> 'text') WHEN 'VARCHAR' THEN [body::json ->> 'text'] WHEN 'ARRAY' THEN list_transform(list_filter((body::json -> 'text')::json[], lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$') ELSE [] END AS texts FROM b),
n AS (SELECT doc_id, kind, len(list_filter(texts, lambda x: regexp_matches(x, '\S'))) AS n_texts, list_sum(list_transform(texts, lambda x: length(x)))::bigint AS characters FROM k)
SELECT doc_id, kind, n_texts, coalesce(characters, 0) AS characters, n_texts > 0 AS valid, CASE WHEN kind = 'other' THEN 'Invalid text format. Expected string or list of strings.' WHEN n_texts > 0 THEN NULL WHEN kind = 'list' THEN 'Text list for translation cannot be empty' ELSE 'Text for translation cannot be empty' END AS reason FROM n""")
def translate_bodies(spark, sf):
    """Bodies of requests whose text is a string, a list that may hold other things, or neither: what is in them and why some are rejected."""
    i, quoted = F.col("doc_id") % 7, F.expr("substring(to_json(array(coalesce(text, ''))), 2, char_length(to_json(array(coalesce(text, '')))) - 2)")
    body = (
        F.when(i == 0, F.concat(F.lit('{"text": '), quoted, F.lit("}")))
        .when(i == 1, '{"text": "  "}')
        .when(i == 2, F.concat(F.lit('{"text": ['), quoted, F.lit(', "'), "lang", F.lit('"]}')))
        .when(i == 3, '{"text": [" ", 5, null]}')
        .when(i == 4, '{"text": 7}')
        .when(i == 5, '{"source_lang": "ne"}')
        .otherwise(F.concat(F.lit('{"text": [1, '), quoted, F.lit(", []]}")))
    )
    found = table(spark, sf, "documents").select("doc_id", B.request_texts(body).alias("q")).select("doc_id", "q.*")
    filled = F.size(F.filter("texts", lambda x: ~T.is_blank(x)))
    characters = F.aggregate("texts", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
    return found.select("doc_id", "kind", filled.cast("long").alias("n_texts"), characters.alias("characters"), (filled > 0).alias("valid"), B.rejection(F.col("kind"), F.col("texts")).alias("reason"))


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{"language": "' || lang || '", "code": "' || left(lang, 2) || '", "confidence": 0.5}' WHEN 1 THEN 'oops' ELSE '   ' END AS raw, CASE WHEN doc_id % 3 = 2 THEN ' ' ELSE text END AS t FROM documents)
SELECT doc_id, CASE WHEN trim(t) = '' THEN 'Unknown' WHEN raw = 'oops' THEN 'Detection Error' ELSE raw::json ->> 'language' END AS language, CASE WHEN trim(t) = '' THEN 'unknown' WHEN raw = 'oops' THEN 'error' ELSE raw::json ->> 'code' END AS code, CASE WHEN trim(t) = '' OR raw = 'oops' THEN 0.0 ELSE 0.5 END::double AS confidence FROM r""")
def language_detection_parse(spark, sf):
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit('{"language": "'), "lang", F.lit('", "code": "'), F.left("lang", F.lit(2)), F.lit('", "confidence": 0.5}'))).when(i % 3 == 1, "oops").otherwise("   ")
    d = table(spark, sf, "documents").select(i, F.from_json(raw, "language string, code string, confidence double").alias("p"), T.is_blank(F.when(i % 3 == 2, " ").otherwise(F.col("text"))).alias("blank"))
    pick = lambda f, blank, error: F.when(F.col("blank"), F.lit(blank)).otherwise(F.coalesce(F.col(f"p.{f}"), F.lit(error)))
    return d.select("doc_id", pick("language", "Unknown", "Detection Error").alias("language"), pick("code", "unknown", "error").alias("code"), pick("confidence", 0.0, 0.0).alias("confidence"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN '' ELSE text END AS transcript, CASE WHEN turn % 3 = 2 THEN '' ELSE coalesce(role, '') END AS speaker FROM conversations""")
def nested_transcript(spark, sf):
    """results.channels[0].alternatives[0].transcript of a response, '' where the path is missing."""
    alt = F.array(F.struct(F.col("text").alias("transcript"), F.col("role").alias("speaker")))
    body = F.to_json(F.struct(F.struct(F.when(F.col("turn") % 3 != 2, F.array(F.struct(alt.alias("alternatives")))).alias("channels")).alias("results")))
    at = "$.results.channels[0].alternatives[0]"
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.coalesce(F.get_json_object(body, f"{at}.transcript"), F.lit("")).alias("transcript"), F.coalesce(F.get_json_object(body, f"{at}.speaker"), F.lit("")).alias("speaker")
    )


@query("SELECT conv_id, string_agg(round(turn * 1.234567, 2)::double || ':' || regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY turn) AS segments, round(max(turn * 1.234567 + 1)::double, 2) AS seconds FROM conversations GROUP BY conv_id")
def segments_projection(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", (F.col("turn") * F.lit(1.234567)).alias("start"), F.coalesce("text", F.lit("")).alias("text")).alias("s"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    shown = F.transform("s", lambda s: F.concat_ws(":", F.round(s["start"], 2).cast("string"), T.strip(s["text"])))
    return g.select("conv_id", F.array_join(shown, " ").alias("segments"), F.round(F.array_max(F.transform("s", lambda s: s["start"])) + 1, 2).alias("seconds"))


@query(r"""WITH r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '   ' WHEN 2 THEN '' ELSE chr(9) || chr(10) END AS t, doc_id % 8 >= 4 AS is_list FROM documents)
SELECT doc_id, is_list, coalesce(regexp_matches(t, '\S'), false) AS valid, CASE WHEN coalesce(regexp_matches(t, '\S'), false) THEN NULL WHEN is_list THEN 'Text list for translation cannot be empty' ELSE 'Text for translation cannot be empty' END AS reason FROM r""")
def translate_request_validation(spark, sf):
    """A request's text is a string or a list; it is rejected if every item is blank."""
    i = F.col("doc_id")
    t = F.when(i % 4 == 0, F.col("text")).when(i % 4 == 1, "   ").when(i % 4 == 2, "").otherwise("\t\n")
    d = table(spark, sf, "documents").select(i, (i % 8 >= 4).alias("is_list"), F.array(t).alias("texts"))
    valid = F.exists("texts", lambda x: ~T.is_blank(x))
    return d.select("doc_id", "is_list", valid.alias("valid"), F.when(~valid & F.col("is_list"), B.EMPTY_LIST).when(~valid, B.EMPTY_TEXT).alias("reason"))


@query(f"""SELECT d.doc_id, nullif(concat_ws(' ', CASE WHEN d.doc_id % 2 = 0 THEN '{SKIPPED}' END,
  CASE WHEN l.toxic = 1 THEN '{Q.AI_MESSAGE}' WHEN l.quality = 0 THEN '{Q.LOW_MESSAGE}' WHEN d.lang = 'fr' THEN '{Q.LAYOUT_MESSAGE}' END), '') AS warning
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def warning_merge(spark, sf):
    """What was not saved and what to review, in one text or null; the labels stand for an accepted vision answer and a low quality."""
    judged = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    review = Q.review_message(F.col("toxic") == 1, F.when(F.col("quality") == 0, "low"), F.col("lang") == "fr")
    both = F.concat_ws(" ", F.when(F.col("doc_id") % 2 == 0, SKIPPED), F.nullif(review, F.lit("")))
    return judged.select("doc_id", F.nullif(both, F.lit("")).alias("warning"))


@query("SELECT l.doc_id, coalesce(r.label, l.lang) AS lang, round(l.n_chars / 100.0::double + coalesce(r.q, 0), 2) AS total_seconds FROM documents l LEFT JOIN (SELECT doc_id, CASE WHEN quality = 1 THEN 'checked' END AS label, quality::double AS q FROM labels) r ON l.doc_id = r.doc_id")
def result_merge(spark, sf):
    """Key by key the later response wins; seconds add up."""
    r = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "checked").alias("label"), F.col("quality").cast("double").alias("q"))
    d = table(spark, sf, "documents").join(r, "doc_id", "left")
    return d.select("doc_id", F.coalesce("label", "lang").alias("lang"), F.round(F.col("n_chars") / 100.0 + F.coalesce("q", F.lit(0.0)), 2).alias("total_seconds"))


@query("SELECT d.doc_id, count(DISTINCT l.quality) AS n_ocr, count(c.conv_id) AS n_turns, max(l.toxic) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id")
def document_star(spark, sf):
    """Documents with their results and turns; none, one or several of each. Children are reduced before they are joined."""
    ocr = table(spark, sf, "labels").groupBy("doc_id").agg(F.countDistinct("quality").alias("n_ocr"), F.max("toxic").alias("toxic"), F.count("*").alias("n"))
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.count("*").alias("n_turns"))
    d = table(spark, sf, "documents").select("doc_id").join(ocr, "doc_id", "left").join(turns, "doc_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return d.select("doc_id", zero("n_ocr").alias("n_ocr"), (zero("n_turns") * F.coalesce("n", F.lit(1))).alias("n_turns"), "toxic")


@query("SELECT user_id, event_type AS stage, round(sum(value), 2) AS seconds, count(*) AS n FROM events GROUP BY ALL")
def stage_timing(spark, sf):
    return table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("stage")).agg(F.round(F.sum("value"), 2).alias("seconds"), F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN n_chars // 60 < 10 THEN '0' ELSE '' END || (n_chars // 60) || ':' || lpad((n_chars % 60)::varchar, 2, '0') AS clock, round(n_chars / 1024.0::double, 2) AS kb FROM documents")
def format_mmss(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.format_string("%02d:%02d", F.floor(n / 60), n % 60).alias("clock"), F.round(n / 1024, 2).alias("kb"))


@query("SELECT conv_id, turn, octet_length(encode(text)) AS bytes FROM conversations WHERE octet_length(encode(text)) >= 100")
def small_chunk_filter(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.octet_length("text").cast("long").alias("bytes"))
    return c.filter("bytes >= 100")


@query("SELECT conv_id, turn, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS transcript FROM conversations WHERE octet_length(encode(text)) >= 100")
def cumulative_transcript(spark, sf):
    """After each kept chunk, all kept chunks of the session so far."""
    c = table(spark, sf, "conversations").filter(F.octet_length("text") >= 100)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return c.select("conv_id", "turn", F.array_join(F.collect_list("text").over(w), "").alias("transcript"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS timed_out, count(*) AS n FROM s GROUP BY user_id, k""")
def session_inactivity(spark, sf):
    """Sessions that a silence of six hours ends (60 s in a live stream; the table's events are hours apart)."""
    e = table(spark, sf, "events")
    s = e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("timed_out"), "n")
