"""Live transcript sessions as a stream.

Rows are (session_id, seq, ts, kind, payload). Chunks of fewer than 100 bytes are ignored and do not count. Every kept chunk counts and stays in the session's
audio, whether or not it can be transcribed: the transcriber hears all audio so far, its text makes a segment, no text a status, and a failure an
error row after which the session goes on. "done" makes a final row with the last text and closes the session; so does silence, by a timer. Chunks that a client sends
again are told by ``seq``: what is not above the last one seen is passed over.

State is a session's count, audio, last text and last seq; of a closed session only the last seq is left, and that expires after ``forget_ms``. A chunk after that opens a new session.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from ..functions.text import strip
from ..sources import unit

MIN_BYTES = 100
EVENT = "session_id long, seq long, ts timestamp_ntz, kind string, payload string"
RESULT = "session_id long, chunk_index long, kind string, text string, is_final boolean"
RESULT_NAMES = ["session_id", "chunk_index", "kind", "text", "is_final"]
OPEN = StructType().add("n", LongType()).add("audio", StringType()).add("text", StringType()).add("seq", LongType())
CLOSED = StructType().add("seq", LongType())
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a client is told.
TIMED_OUT = "Connection timed out after 60 seconds of inactivity"
NO_SPEECH = "No speech detected in this chunk yet..."


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class Sessions(StatefulProcessor):
    """One session's state, its timer of silence and the mark that it leaves."""

    def __init__(self, timeout_ms: int | None, forget_ms: int, transcriber: Callable[[str], str] | None) -> None:
        self.timeout_ms, self.forget_ms, self.transcriber = timeout_ms, forget_ms, transcriber

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.closed = handle.getValueState("closed", CLOSED, self.forget_ms if self.timeout_ms else None)

    def _close(self, seq: int) -> None:
        self.open.clear()
        self.closed.update((seq,))
        self._stop_timers()

    def _stop_timers(self) -> None:
        for t in list(self.handle.listTimers()) if self.timeout_ms else ():
            self.handle.deleteTimer(t)

    def _heard(self, key: int, n: int, audio: str) -> tuple:
        try:
            text = self.transcriber(audio) if self.transcriber else audio
        except Exception as e:  # whatever a provider raises is this chunk's alone
            return (key, n, "error", f"Transcription error: {e}", False)
        return (key, n, "segment", text, False) if text.strip() else (key, n, "status", NO_SPEECH, False)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.closed.get()[0] if self.closed.exists() else None
        n, audio, text, seq = self.open.get() if self.open.exists() else (0, "", "", -1)
        out: list[tuple] = []
        events = pd.concat(list(rows)).sort_values("seq") if last is None else pd.DataFrame()
        for r in events.itertuples():
            if r.seq <= seq:
                continue
            seq = int(r.seq)
            if r.kind == "done":
                out.append((key[0], n, "done", text, True))
                self._close(seq)
                break
            if r.kind == "chunk" and r.payload is not None and len(r.payload.encode()) >= MIN_BYTES:
                n, audio = n + 1, audio + r.payload
                out.append(self._heard(key[0], n, audio))
                text = out[-1][3] if out[-1][2] == "segment" else text
        else:
            if last is None:
                self.open.update((n, audio, text, seq))
                self._wait(timerValues)
        yield pd.DataFrame(out, columns=RESULT_NAMES)

    def _wait(self, timers) -> None:
        if self.timeout_ms:
            self._stop_timers()
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, _, _, seq = self.open.get() if self.open.exists() else (0, "", "", -1)
        self._close(seq)
        yield pd.DataFrame([(key[0], n, "error", TIMED_OUT, True)], columns=RESULT_NAMES)


def transcribe(events: DataFrame, timeout_ms: int | None = 60_000, transcriber: Callable[[str], str] | None = None, forget_ms: int = 3_600_000) -> DataFrame:
    """The stream of results; update mode, the last row of a session replaces those before. A finite replay has neither timers nor marks that expire."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the driver's own worker has no shipped package on its path
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return events.groupBy("session_id").transformWithStateInPandas(Sessions(timeout_ms, forget_ms, transcriber), RESULT, "update", "ProcessingTime" if timeout_ms else "None")


def replay(events: DataFrame) -> DataFrame:
    """The batch counterpart: for every kept chunk before "done", the text so far."""
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = events.withColumn("_done", F.max((F.col("kind") == "done").cast("int")).over(w)).filter("_done = 0 and kind = 'chunk'")
    kept = kept.filter(F.octet_length("payload") >= MIN_BYTES)
    return kept.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")).cast("long").alias("chunk_index"), F.array_join(F.collect_list("payload").over(w), "").alias("text"))


def resent(events: DataFrame) -> DataFrame:
    """The chunks of more than MIN_BYTES with their places, as a client sends them again after a reconnection."""
    w = Window.partitionBy("session_id").orderBy("seq")
    return events.filter(F.octet_length("payload") > MIN_BYTES).withColumn("place", F.row_number().over(w))


def isolated(events: DataFrame, failure: Column) -> DataFrame:
    """session_id, place, kind and text of each kept chunk: its text, or an error where ``failure`` names one."""
    kept = events.filter(F.octet_length("payload") >= MIN_BYTES).withColumn("_failure", failure)
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))
    text = F.when(F.col("_failure").isNull(), F.col("payload")).otherwise(F.concat(F.lit("Transcription error: "), "_failure"))
    return kept.select("session_id", place.alias("place"), F.when(F.col("_failure").isNull(), "segment").otherwise("error").alias("kind"), text.alias("text"))


def with_interim(results: DataFrame) -> DataFrame:
    """session_id, event, text from (session_id, event, seq, final, text): the final texts so far and the event's interim ones, stripped."""
    parts = results.groupBy("session_id", "event").agg(F.array_sort(F.collect_list(F.struct("seq", "final", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    done = F.array_join(F.transform(F.filter("p", lambda x: x["final"]), lambda x: F.concat(x["text"], F.lit(" "))), "")
    interim = F.array_join(F.transform(F.filter("p", lambda x: ~x["final"]), lambda x: x["text"]), "")
    w = Window.partitionBy("session_id").orderBy("event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = parts.select("session_id", "event", done.alias("done"), interim.alias("interim"))
    return made.select("session_id", "event", strip(F.concat(F.array_join(F.collect_list("done").over(w), ""), F.col("interim"))).alias("text"))


def write_results(results: DataFrame, path: str, checkpoint: str, **trigger):
    """Publish every micro-batch once: a batch that is run again after it was published writes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        unit.publish(path, f"batch-{batch_id:012d}", {"results": batch.withColumn("batch_id", F.lit(batch_id).cast("long"))})

    return results.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return unit.read(spark, path, "results", RESULT + ", batch_id long")
