"""Connected components of a link table, and whole groups from sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

#: Up to this many links the minima of a round are broadcast (at most two ends a link, about 40 bytes each); beyond, they are shuffled.
MAX_BROADCAST_LINKS = 100_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every end of a link; the root is the component's least node.

    Large-star and small-star rounds: nodes hand their neighbours on to the least one they know, until nothing changes.
    Each round is a table in the shared folder; the driver sees a count and a checksum. Null ends and loops are left out.
    """
    pairs = links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).filter("x > y").distinct()
    pairs = materialise(pairs, "links")
    state = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return pairs.select(F.col("x").alias("node"), F.col("y").alias("root")).union(pairs.select("y", "y").distinct())
        state = now
        with scratch(pairs.sparkSession) as kept:
            pairs = _star_round(pairs, now[0])
            kept.append(pairs)


def _star_round(pairs: DataFrame, n: int) -> DataFrame:
    small = F.broadcast if n <= MAX_BROADCAST_LINKS else lambda m: materialise(m, "minima")
    both = pairs.select(F.col("x").alias("u"), F.col("y").alias("v")).union(pairs.select("y", "x"))
    least = small(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    # A node that is least among its neighbours keeps itself as their root; others pass their links on.
    large = materialise(large.filter("x > y").distinct(), "large-star")
    own = large.groupBy("x").agg(F.min("y").alias("m"))
    moved = large.join(small(own), "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x > y")
    return materialise(moved.union(own.select("x", "m")).distinct(), "small-star")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups of rows sorted by integer ``keys``, with the groups' first rows and the table's size.

    Every batch is looked at once: those of a group that has not ended wait in a list.
    """
    held: list[pa.RecordBatch] = []
    starts: list[np.ndarray] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[0] = last is None or any(v[0] != x for v, x in zip(values, last, strict=True))
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        first, last = np.flatnonzero(new), [v[-1] for v in values]
        if len(first) and (size or first[-1]):
            cut = int(first[-1])
            done = pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])]).combine_chunks()
            yield done, np.append(np.concatenate([*starts, first[:-1] + size]), done.num_rows).astype(np.int64)
            held, starts, size = [batch.slice(cut)], [np.zeros(1, np.int64)], batch.num_rows - cut
        else:
            held.append(batch)
            starts.append(first + size)
            size += batch.num_rows
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(np.concatenate(starts), t.num_rows).astype(np.int64)


def binary_matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """Rows of equally long binaries as a matrix."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=dtype).reshape(len(rows), -1)
