"""Best-fit packing planned on a length histogram; documents then take planned slots by their rank within their length.

1. One pass tokenizes whole texts and cuts those longer than a sequence into pieces (the first one may be shorter).
   It numbers pieces by (task, length); the table it writes is the only thing later steps read.
2. The histogram (at most ``capacity`` lengths, whatever the corpus) goes to the driver. Best fit, longest first, runs over
   counts: all bins with the same free space are one group, and a length fills whole groups in one step. The plan holds at
   most a few records a length and group.
3. A piece's rank is its number within (task, length) plus the counts of the tasks before; the plan record that covers the rank gives
   sequence and offset. Nothing is ranked by one task: a length with a third of all rows is as many groups as there were tasks.

Edge cases: null and empty texts are one end id; repeated rows are packed each; an empty table packs to an empty one; only
``keys`` of the other columns are carried, and those named like a result column are replaced by it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import materialise
from .tokens import CACHE_PIECES, default_tokenizer, encoder

#: Up to this many (task, length) counts are broadcast (about 20 bytes each); more are joined by a shuffle.
MAX_BROADCAST_COUNTS = 200_000
PLAN = "length int, first_rank long, n_items long, first_bin long, per_bin int, first_offset int"
PIECE = "piece int, start long, length int, ids_crc32 long, __task int, __rank long"
ADDED = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset", "__task", "__rank")


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """PLAN records for ``counts`` items of each length: best fit, longest first, over groups of bins with equal free space."""
    records: list[tuple[int, int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = {}  # free space -> groups (first bin, bins)
    n_bins = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def fill(first: int, bins: int, space: int) -> int:
            """Put items of this length into a group until it or they run out; returns how many bins were touched."""
            nonlocal left, rank
            per = space // length  # noqa: B023
            full = min(bins, left // per)
            if full:
                records.append((length, rank, full * per, first, per, capacity - space))  # noqa: B023
                free.setdefault(space - per * length, []).append((first, full))  # noqa: B023
                left, rank = left - full * per, rank + full * per
            if left and full < bins:
                records.append((length, rank, left, first + full, left, capacity - space))  # noqa: B023
                free.setdefault(space - left * length, []).append((first + full, 1))  # noqa: B023
                left, rank, full = 0, rank + left, full + 1
            return full

        for space in sorted(s for s in free if s >= length):
            groups = free.pop(space)
            while groups and left:
                first, bins = groups.pop()
                done = fill(first, bins, space)
                if done < bins:
                    groups.append((first + done, bins - done))
            if groups:
                free.setdefault(space, []).extend(groups)
            if not left:
                break
        if left:
            bins = -(-left // (capacity // length))
            fill(n_bins, bins, capacity)
            n_bins += bins
        free.pop(0, None)
    return records


def tokenized_pieces(docs: DataFrame, text: str, keys: list[str], capacity: int, tokenizer: str, end_id: int, with_ids: bool, cache_pieces: int) -> DataFrame:
    """A row a piece: ``keys``, PIECE and, if asked for, ``ids`` (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(tokenizer, cache_pieces), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, piece, start, length, crc, rank, held = [], [], [], [], [], [], []
                for i, coded in enumerate(enc.encode([t or "" for t in part.column(0).to_pylist()])):
                    ids = np.concatenate([np.frombuffer(coded, dtype=enc.dtype).astype("<u4"), end])
                    cut = len(ids) % capacity or min(capacity, len(ids))
                    for k, begin in enumerate([0, *range(cut, len(ids), capacity)]):
                        own = ids[begin : cut if k == 0 else begin + capacity].tobytes()
                        n = len(own) // 4
                        row.append(i)
                        piece.append(k)
                        start.append(begin)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        rank.append(int(ranks[n]))
                        ranks[n] += 1
                        if with_ids:
                            held.append(own)
                took = pa.array(row, pa.int32())
                columns = [part.column(j + 1).take(took) for j in range(len(keys))]
                columns += [
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()),
                    pa.array(crc, pa.int64()),
                    pa.array([task] * len(row), pa.int32()),
                    pa.array(rank, pa.int64()),
                ]
                names = [*keys, "piece", "start", "length", "ids_crc32", "__task", "__rank"]
                if with_ids:
                    columns.append(pa.array(held, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = StructType([docs.schema[k] for k in keys])
    for f in StructType.fromDDL(PIECE + (", ids binary" if with_ids else "")):
        schema.add(f)
    return docs.select(F.col(text), *[F.col(f"`{k}`") for k in keys]).mapInArrow(run, schema)


def pack_documents(
    docs: DataFrame,
    text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
    capacity: int = 2048,
    tokenizer: str | None = None,
    end_id: int = 0,
    with_ids: bool = False,
    cache_pieces: int = CACHE_PIECES,
) -> DataFrame:
    """Per piece: keys, piece, start, length, ids_crc32, (ids,) sequence_id and offset. ``cache_pieces`` bounds a worker's memory, not the result."""
    spark = docs.sparkSession
    keys = [k for k in keys if k not in ADDED]
    pieces = materialise(tokenized_pieces(docs, text, keys, capacity, tokenizer or default_tokenizer(), end_id, with_ids, cache_pieces), "pack-pieces")
    counts = materialise(pieces.groupBy("__task", "length").agg(F.count("*").alias("__n")), "pack-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("__n")).collect()}
    plan = spark.createDataFrame(plan_best_fit(histogram, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialise(counts.select("__task", "length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")), "pack-bases")
    bases = F.broadcast(bases) if bases.count() <= MAX_BROADCAST_COUNTS else bases.hint("merge")
    ranked = pieces.join(bases, ["__task", "length"]).withColumn("__rank", F.col("__base") + F.col("__rank"))
    slots = plan.withColumnRenamed("length", "__length")
    place = (F.col("length") == F.col("__length")) & (F.col("__rank") >= F.col("first_rank")) & (F.col("__rank") < F.col("first_rank") + F.col("n_items"))
    at = F.col("__rank") - F.col("first_rank")
    placed = ranked.join(F.broadcast(slots), place).withColumns(
        {
            "sequence_id": F.col("first_bin") + F.floor(at / F.col("per_bin")),
            "offset": F.col("first_offset") + F.pmod(at, F.col("per_bin")) * F.col("length"),
        }
    )
    return placed.select(*keys, "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *(["ids"] if with_ids else []), "sequence_id", F.col("offset").cast("long").alias("offset"))
