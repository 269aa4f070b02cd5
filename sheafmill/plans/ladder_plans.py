"""Queries on providers' ladders: who is tried, whose answer counts, and what stands where all fail. The attempts of a call are rows of ``events``: the first
events of the user that the call belongs to, in the order of time. A purchase or a signup is an answer, its value the time that it took; any other event is a failure."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import bodies as B
from ..functions import routing as R
from ..functions import text as T
from ..operators import quality as Q
from .registry import query, table

#: What is said where no model answers, before the last model's reason.
NO_VISION = "All Gemini OCR fallback models failed: "
NO_SCRIPT = "All Gemini script preflight models failed: "
NO_SPEECH = "All transcription models failed. Last error: "
ATTEMPTS = """w AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS m, event_type IN ('purchase', 'signup') AS ok, value AS ms, event_type AS reason FROM events),
a AS (SELECT c.*, m, ok, ms, reason FROM c JOIN w ON w.user_id = id % (SELECT max(user_id) + 1 FROM events) WHERE m < {n})"""


def attempts(spark, sf, calls, n):
    """``calls`` (id and more) with up to ``n`` attempts each: m, ok, ms, reason and the model's name."""
    e = table(spark, sf, "events")
    users = (e.agg(F.max("user_id")).first()[0] or 0) + 1
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    made = e.withColumn("m", place).filter(F.col("m") < n)
    made = made.select("user_id", "m", F.col("event_type").isin("purchase", "signup").alias("ok"), F.col("value").alias("ms"), F.col("event_type").alias("reason"))
    named = F.concat(F.lit("model-"), F.col("m").cast("string"))
    return calls.withColumn("user_id", F.col("id") % users).join(made, "user_id").drop("user_id").withColumn("model", named)


def last_reason(rows, *keys):
    """The reason of the last attempt of each call."""
    return rows.groupBy(*keys).agg(F.max_by("reason", "m").alias("reason"))


@query(f"""WITH c AS (SELECT doc_id AS id, coalesce(text, '') AS text FROM documents), {ATTEMPTS.format(n=6)},
r AS (SELECT id, first(m ORDER BY CASE WHEN id % 2 = 0 THEN 0.0 ELSE ms END, m) FILTER (ok) AS m FROM a GROUP BY id)
SELECT c.id AS doc_id, CASE WHEN r.m IS NULL THEN c.text ELSE 'm' || r.m || ': ' || c.text END AS text, 'model-' || coalesce(r.m, 0) AS model, r.m IS NOT NULL AS translated FROM c LEFT JOIN r ON r.id = c.id""")
def translation_attempts(spark, sf):
    """A repaired text goes up a ladder of models, any other is raced; where all fail the input comes back under the first model's name."""
    c = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    a = attempts(spark, sf, c.select("id"), 6)
    order = F.struct(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("ms")), "m")
    won = Q.first_success(a.withColumn("order", order), ["id"], "order", "m").withColumnRenamed("m", "won")
    out, ok = c.join(won, "id", "left"), F.coalesce("ok", F.lit(False))
    answer = F.when(ok, F.concat(F.lit("m"), F.col("won").cast("string"), F.lit(": "), "text")).otherwise(F.col("text"))
    return out.select(F.col("id").alias("doc_id"), answer.alias("text"), F.concat(F.lit("model-"), F.coalesce("won", F.lit(0)).cast("string")).alias("model"), ok.alias("translated"))


@query(f"""WITH c AS (SELECT page_id AS id, coalesce(url, '') AS url FROM pages), {ATTEMPTS.format(n=4)}, w2 AS (SELECT id, m, reason, CASE WHEN reason = 'signup' THEN '  ' ELSE url END AS answer, ok AND reason <> 'signup' AND regexp_matches(url, '\\S') AS good FROM a)
SELECT id AS page_id, arg_min('model-' || m, m) FILTER (good) AS model, arg_min(answer, m) FILTER (good) AS text, CASE WHEN bool_or(good) THEN NULL ELSE '{NO_VISION}' || arg_max(reason, m) END AS error FROM w2 GROUP BY id""")
def vision_attempts(spark, sf):
    """Four vision models in order; a blank transcription is a failure, as those of signups are here."""
    c = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    answer = F.when(F.col("reason") == "signup", "  ").otherwise(F.col("url"))
    a = attempts(spark, sf, c, 4).withColumn("answer", F.struct("model", answer.alias("text")))
    a = a.withColumn("ok", F.col("ok") & ~T.is_blank(F.col("answer.text")))
    found = Q.first_success(a, ["id"], "m", "answer").join(last_reason(a, "id"), "id")
    return found.select(F.col("id").alias("page_id"), "answer.model", "answer.text", F.when(~F.col("ok"), F.concat(F.lit(NO_VISION), "reason")).alias("error"))


@query(f"""WITH c AS (SELECT page_id AS id FROM pages), {ATTEMPTS.format(n=4)}, k AS (SELECT id, m, ok, reason, CASE m WHEN 0 THEN 'ranjana' WHEN 1 THEN 'devanagari' WHEN 2 THEN 'tamyig' ELSE 'latin' END AS script, 0.4 + m / 10.0::double AS conf FROM a),
f AS (SELECT id, arg_min(script, m) FILTER (ok) AS script, arg_min(conf, m) FILTER (ok) AS conf, arg_min('model-' || m, m) FILTER (ok) AS model, arg_max(reason, m) AS reason FROM k GROUP BY id)
SELECT id AS page_id, model, script, round(conf, 4) AS confidence, script IN ('ranjana', 'prachalit', 'tamyig', 'tibetan') AND conf >= 0.55 AS is_special, CASE WHEN model IS NULL THEN '{NO_SCRIPT}' || reason END AS error FROM f""")
def script_preflight(spark, sf):
    """The first of four models that answers names the script; a special one counts from a confidence of 0.55. Where none answers the error ends with the last reason."""
    a = attempts(spark, sf, table(spark, sf, "pages").select(F.col("page_id").alias("id")), 4)
    script = F.element_at(F.array(*map(F.lit, ("ranjana", "devanagari", "tamyig", "latin"))), F.col("m") + 1)
    body = F.to_json(F.struct(script.alias("script"), (0.4 + F.col("m") / 10.0).alias("confidence")))
    found = Q.first_success(a.withColumn("answer", F.struct("model", body.alias("body"))), ["id"], "m", "answer").join(last_reason(a, "id"), "id")
    found = found.withColumn("d", F.when(F.col("ok"), B.detected_script(F.col("answer.body"))))
    return found.select(F.col("id").alias("page_id"), "answer.model", "d.script", "d.confidence", "d.is_special", F.when(~F.col("ok"), F.concat(F.lit(NO_SCRIPT), "reason")).alias("error"))


@query(f"""WITH c AS (SELECT doc_id AS id, lang AS text FROM documents), {ATTEMPTS.format(n=7)}, k AS (SELECT id, text, m, ok AND reason <> 'signup' AS good FROM a)
SELECT id AS doc_id, CASE WHEN bool_or(good) THEN any_value(text) ELSE 'Detection Error' END AS language, CASE WHEN bool_or(good) THEN 'model-' || min(m) FILTER (good) END AS model, CASE WHEN bool_or(good) THEN 0.5 ELSE 0.0 END::double AS confidence FROM k GROUP BY id""")
def detection_attempts(spark, sf):
    """Seven models in order; an answer that is no JSON, as those of signups here, is a failure, and where all fail the language is an error of confidence 0."""
    a = attempts(spark, sf, table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), 7)
    raw = F.when(F.col("reason") == "signup", "no json").otherwise(F.to_json(F.struct(F.col("lang").alias("language"), F.lit(0.5).alias("confidence"))))
    p = F.from_json(raw, "language string, confidence double")
    a = a.withColumns({"answer": F.struct("model", p.alias("p")), "ok": F.col("ok") & p["confidence"].isNotNull()})
    found = Q.first_success(a, ["id"], "m", "answer")
    return found.select(
        F.col("id").alias("doc_id"),
        F.when(F.col("ok"), F.col("answer.p.language")).otherwise("Detection Error").alias("language"),
        "answer.model",
        F.coalesce("answer.p.confidence", F.lit(0.0)).alias("confidence"),
    )


@query(f"""WITH l(place, provider, model) AS (VALUES (0, 'groq', 'whisper-large-v3'), (1, 'groq', 'whisper-large-v3-turbo'), (2, 'deepgram', 'nova-2'), (3, 'local', 'whisper')), c AS (SELECT DISTINCT conv_id AS id FROM conversations), {ATTEMPTS.format(n=4)},
k AS (SELECT id, m, provider || '/' || model AS name, reason, (provider = 'local' OR (provider = 'groq' AND id % 2 = 0) OR (provider = 'deepgram' AND id % 3 = 0)) AS tried, ok FROM a JOIN l ON l.place = m)
SELECT id AS conv_id, arg_min(name, m) FILTER (tried AND ok) AS model_used, count(*) FILTER (tried) AS n_eligible, CASE WHEN bool_or(tried AND ok) THEN NULL ELSE '{NO_SPEECH}' || coalesce(arg_max(reason, m) FILTER (tried), 'None') END AS error FROM k GROUP BY id""")
def speech_attempts(spark, sf):
    """The speech ladder: steps without a key are passed over, the first that succeeds names the model."""
    a = attempts(spark, sf, table(spark, sf, "conversations").select(F.col("conv_id").alias("id")).distinct(), len(R.LADDER))
    step = F.get(F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(m).alias("model")) for p, m in R.LADDER]), F.col("m"))
    a = a.withColumn("step", step).withColumn("model_used", F.concat_ws("/", "step.provider", "step.model"))
    a = a.withColumn("tried", R.eligible(F.col("step.provider"), F.col("id") % 2 == 0, F.col("id") % 3 == 0)).withColumn("ok", F.col("tried") & F.col("ok"))
    won = Q.first_success(a, ["id"], "m", "model_used")
    n = a.groupBy("id").agg(F.count_if("tried").alias("n_eligible"), F.max_by(F.when(F.col("tried"), F.col("reason")), F.when(F.col("tried"), F.col("m"))).alias("reason"))
    error = F.when(~F.col("ok"), F.concat(F.lit(NO_SPEECH), F.coalesce("reason", F.lit("None"))))
    return won.join(n, "id").select(F.col("id").alias("conv_id"), "model_used", "n_eligible", error.alias("error"))
