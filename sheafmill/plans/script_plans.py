"""Queries whose work is done in Python or as a stream: transliteration, live sessions, provider ladders, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import translit
from ..session import own_folder, ship
from ..sources import files, providers
from ..streaming import sessions
from .registry import query, table

SAMPLE = "नमस्ते कति क्षेत्र १२। "


@query()
def transliteration(spark, sf):
    """Each turn behind a Devanagari phrase, to both scripts and back."""
    ship(spark)
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit(SAMPLE), "text").alias("text"))
    both = t.select("conv_id", "turn", translit.column(translit.to_tamyig, F.col("text")).alias("tamyig"), translit.column(translit.to_ranjana, F.col("text")).alias("ranjana"))
    return both.select("*", translit.column(translit.from_tamyig, F.col("tamyig")).alias("from_tamyig"), translit.column(translit.from_ranjana, F.col("ranjana")).alias("from_ranjana"))


@query("""WITH k AS (SELECT conv_id, turn, text FROM conversations WHERE octet_length(encode(text)) >= 100), s AS (SELECT conv_id, count(*) AS n, string_agg(text, '' ORDER BY turn) AS text FROM k GROUP BY conv_id)
SELECT conv_id AS session_id, n AS chunk_index, CASE WHEN regexp_matches(text, '\\S') THEN 'segment' ELSE 'status' END AS kind, CASE WHEN regexp_matches(text, '\\S') THEN text ELSE 'No speech detected in this chunk yet...' END AS text FROM s""")
def stream_sessions(spark, sf):
    """Conversations replayed as a live stream until its input ends; the last row of each session."""
    ship(spark)
    at = own_folder(spark, "sessions")
    c = table(spark, sf, "conversations")
    events = c.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("chunk").alias("kind"), F.col("text").alias("payload"))
    events.write.parquet(f"{at}/in")
    live = sessions.transcribe(sessions.read_events(spark, f"{at}/in", 1000), timeout_ms=None)
    sessions.write_results(live, f"{at}/out", f"{at}/state").awaitTermination()
    out = sessions.read_results(spark, f"{at}/out")
    return out.groupBy("session_id").agg(F.max_by(F.struct("chunk_index", "kind", "text"), F.struct("batch_id", "chunk_index")).alias("r")).select("session_id", "r.chunk_index", "r.kind", "r.text")


@query("""SELECT conv_id, turn, text, CASE WHEN regexp_matches(text, '\\S') AND length(text) % 2 = 0 THEN replace(upper(text), 'ẞ', 'SS') ELSE text END AS output, CASE WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN NULL WHEN length(text) % 2 = 0 THEN 'upper' ELSE 'echo' END AS provider,
 coalesce(regexp_matches(text, '\\S'), false) AS ok FROM conversations""")
def provider_ladder(spark, sf):
    ship(spark)
    return providers.ladder(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "text", ["fails", "upper", "echo"])


@query("SELECT unnest(string_split(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), chr(10))) AS line FROM conversations WHERE text IS NOT NULL AND text <> ''")
def exported_lines(spark, sf):
    """Transcripts written as plain text and read back, a row a line."""
    at = own_folder(spark, "transcripts")
    files.write_transcripts(table(spark, sf, "conversations").filter("text is not null and text <> ''"), at)
    return spark.read.text(at).select(F.col("value").alias("line"))
