"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Equal vectors of a label are one class. Every table has one random projection, sorted within the cells of a few more sign
projections; a cell holds about ``cell_rows`` rows whatever the size of the label. Centred on each row, the pairs within
``window`` standard deviations of what a pair at the threshold differs by collide in the table. A pair that collides in
at least ``count`` tables is verified by its cosine in double precision. ``calibrate`` chooses the number of tables from the
collision probability of a pair exactly at the threshold, so that it is missed with at most ``miss``.

A row of a table carries the class and its vector, as the table has it (4 bytes a component for floats); the places in all tables follow from
the vector inside the task, so bytes a vector grow with the number of tables and not with its square. Places are worked out on rounded whole
numbers, whose sums doubles hold exactly, so every task finds the same places, and a pair is counted and verified in the first
table where it collides, and only there. A cell sends on sums and a spanning star of its links a row, never pairs. A cell of more than
``block`` rows is dealt into blocks that meet two at a time.

Edge cases: a null label, and a vector that is null, zero, or has null or non-finite components, links with nothing; vectors of different lengths are never compared;
repeated rows are linked copies; a null id is the least of a component only if all are null; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from .common import materialise, scratch
from .graph import connected_components, whole_groups


def calibrate(least: float, bits: int, window: float, count: int, miss: float) -> int:
    """Tables so that a pair at the threshold collides in fewer than ``count`` with probability of at most ``miss``."""
    angle = math.acos(least)
    p = (1 - angle / math.pi) ** bits * math.erf(window / math.sqrt(2))
    tables = count
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(count)) > miss:
        tables += 1
    return tables


_SEEDS = np.random.default_rng(61).integers(1, 1 << 63, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Units of a component and of a direction's component: whole numbers up to 2^18 and about 2^17, whose products' sums stay below 2^53.
_UNIT, _STEP = float(1 << 18), float(1 << 14)


def directions(dim: int, tables: int, bits: int) -> np.ndarray:
    """Gaussian directions in whole steps: a projection and ``bits`` sign projections a table."""
    return np.round(np.random.default_rng([dim, tables, bits, 6]).standard_normal((dim, tables * (bits + 1))) * _STEP)


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows in double precision and of length 1."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def places_of(x: np.ndarray, planes: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and projections of unit rows in all tables; the same for a row whatever rows are worked out with it."""
    proj = (np.round(x * _UNIT) @ planes).reshape(len(x), tables, bits + 1)
    cells = ((proj[:, :, 1:] > 0) << np.arange(bits)).sum(axis=2).astype("<u4")
    return cells, (proj[:, :, 0] / (_UNIT * _STEP)).astype(np.float32)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _classes(x: np.ndarray, labels: np.ndarray) -> list[bytes]:
    """128-bit hashes of a label's hash and a row of numbers."""
    words = (x.astype(np.float64) + 0.0).view(np.uint64)  # no negative zeros
    at = np.arange(1, x.shape[1] + 1, dtype=np.uint64)
    two = [_mix(_mix(words ^ (at * _SEEDS[k])).sum(axis=1, dtype=np.uint64) ^ _mix(labels.astype(np.uint64) * _SEEDS[k + 2])) for k in (0, 1)]
    return [row.tobytes() for row in np.stack(two, axis=1)]


def _vectors(table: DataFrame, vector: str, key: str, label: str) -> DataFrame:
    """key, class (16 bytes, null if it links with nothing), label_hash, dim, vec (its numbers as binary, floats or doubles)."""
    single = isinstance(table.schema[vector].dataType, ArrayType) and isinstance(table.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lists = batch.num_rows, batch.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            first = lists.offsets.to_numpy()[:-1] - lists.offsets.to_numpy()[0]
            flat = lists.flatten() if not lists.null_count else lists.values.slice(lists.offsets[0].as_py(), int(sizes.sum()))
            values = flat.to_numpy(zero_copy_only=False).astype(kind)  # null components become NaN
            usable = np.array(lists.is_valid()) & np.array(batch.column(1)) & (sizes > 0)
            classes, dims, vecs = np.full(n, None, dtype=object), np.zeros(n, dtype=np.int32), np.full(n, None, dtype=object)
            hashes = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[usable]):
                own = np.flatnonzero(usable & (sizes == dim))
                x = values[first[own][:, None] + np.arange(dim)]
                good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                own, x = own[good], x[good]
                if len(own):
                    classes[own] = _classes(x, hashes[own])
                    dims[own] = dim
                    vecs[own] = [row.tobytes() for row in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(classes.tolist(), pa.binary()), pa.array(dims), pa.array(vecs.tolist(), pa.binary())],
                names=["key", "label_hash", "class", "dim", "vec"],
            )

    schema = StructType().add("key", table.schema[key].dataType)
    for f in StructType.fromDDL("label_hash long, class binary, dim int, vec binary"):
        schema.add(f)
    used = table.select(
        F.col(key).alias("key"), F.col(label).isNotNull().alias("labelled"), F.xxhash64(label).alias("label_hash"), F.col(vector).cast("array<float>" if single else "array<double>")
    )
    return used.mapInArrow(run, schema)


class _Places:
    """Places of rows held as binary, with the directions of each dimension worked out once a task."""

    def __init__(self, tables: int, bits: int, single: bool) -> None:
        self.tables, self.bits, self.kind = tables, bits, np.float32 if single else np.float64
        self.planes: dict[int, np.ndarray] = {}

    def __call__(self, vecs: list[bytes], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if dim not in self.planes:
            self.planes[dim] = directions(dim, self.tables, self.bits)
        x = unit_rows(np.frombuffer(b"".join(vecs), dtype=self.kind).reshape(len(vecs), dim))
        return x, *places_of(x, self.planes[dim], self.tables, self.bits)


def _placed(classes: DataFrame, tables: int, bits: int, single: bool) -> DataFrame:
    """A row a class and table: its cell there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(tables, bits, single)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                dims = part.column(2).to_numpy()
                for dim in np.unique(dims):
                    own = np.flatnonzero(dims == dim)
                    rows = part.take(pa.array(own))
                    _, cells, _ = places(rows.column(3).to_pylist(), int(dim))
                    took = pa.array(np.repeat(np.arange(len(own)), tables))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.tile(np.arange(tables, dtype=np.int32), len(own))),
                            pa.array(cells.reshape(-1).astype(np.int64)),
                            rows.column(1).take(took),
                            rows.column(2).take(took),
                            rows.column(0).take(took),
                        ],
                        names=["table", "cell", "label_hash", "dim", "class"],
                    )

    return classes.select("class", "label_hash", "dim", "vec").mapInArrow(run, "table int, cell long, label_hash long, dim int, class binary")


GROUP = ["label_hash", "dim", "table", "cell", "b1", "b2"]


def _cell_links(rows: DataFrame, tables: int, bits: int, single: bool, least: float, width: float, count: int) -> DataFrame:
    """class, links (weights of other classes linked in this cell), root (a class of the same component in this cell)."""

    def collided(cells: np.ndarray, proj: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (cells[i] == cells[j]) & (np.abs(proj[i] - proj[j]) <= np.float32(width))

    def pairs_in(p: np.ndarray, side: np.ndarray, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of rows within the window of each other, in slices of queries."""
        order = np.argsort(p, kind="stable")
        v = p[order]
        upto = np.searchsorted(v, v + np.float32(width), side="right")
        n = upto - np.arange(len(v)) - 1
        at = 0
        while at < len(v):
            end = max(at + 1, int(np.searchsorted(np.cumsum(n[at:]), 100_000)) + at)
            own = n[at:end]
            i = np.repeat(np.arange(at, min(end, len(v))), own)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
            i, j = order[i], order[j]
            if not one:
                apart = side[i] != side[j]
                i, j = i[apart], j[apart]
            yield i, j
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = _Places(tables, bits, single)
        for t, first in whole_groups(batches, GROUP):
            table, dims, b1, b2 = (t.column(k).to_numpy() for k in ("table", "dim", "b1", "b2"))
            side, weight = t.column("side").to_numpy(), t.column("weight").to_numpy()
            vecs = t.column("vec").to_pylist()
            links, root = np.zeros(t.num_rows, dtype=np.int64), np.arange(t.num_rows)
            for g in np.flatnonzero(np.diff(first) > 1):
                lo, hi = first[g], first[g + 1]
                k = int(table[lo])
                x, cells, proj = places(vecs[lo:hi], int(dims[lo]))
                found_i, found_j = [], []
                for i, j in pairs_in(proj[:, k], side[lo:hi], b1[lo] == b2[lo]):
                    hit = collided(cells, proj, i, j)
                    ok = (hit.argmax(axis=1) == k) & (hit.sum(axis=1) >= count)
                    i, j = i[ok], j[ok]
                    near = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    found_i.append(i[near] + lo)
                    found_j.append(j[near] + lo)
                i, j = np.concatenate(found_i), np.concatenate(found_j)
                if not len(i):
                    continue
                np.add.at(links, i, weight[j])
                np.add.at(links, j, weight[i])
                while True:  # least row of each component
                    old = root[lo:hi].copy()
                    m = np.minimum(root[i], root[j])
                    np.minimum.at(root, i, m)
                    np.minimum.at(root, j, m)
                    root[lo:hi] = root[root[lo:hi]]
                    if (old == root[lo:hi]).all():
                        break
            own = np.flatnonzero(links)
            if len(own):
                classes = t.column("class").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([classes[i] for i in own], pa.binary()), pa.array(links[own]), pa.array([classes[root[i]] for i in own], pa.binary())],
                    names=["class", "links", "root"],
                )

    dealt = rows.select(*GROUP, "side", "class", "weight", "vec").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return dealt.mapInArrow(run, "class binary, links long, root binary")


def near_vectors(
    table: DataFrame,
    least: float = 0.93,
    vector: str = "embedding",
    key: str = "vec_id",
    label: str = "label",
    window: float = 2.0,
    count: int = 2,
    miss: float = 1e-4,
    cell_rows: int = 128,
    block: int = 1000,
) -> DataFrame:
    """Per vector: key, n_links (others linked directly), component_id (least key reachable by links), kept."""
    with scratch(table.sparkSession) as held:
        features, named = _linked_classes(table, least, vector, key, label, window, count, miss, cell_rows, block)
        held += [features, named]
    out = features.filter("class is not null").select("key", "class").join(named, "class").select("key", "n_links", "component_id")
    alone = features.filter("class is null").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key)


def _linked_classes(
    table: DataFrame, least: float, vector: str, key: str, label: str, window: float, count: int, miss: float, cell_rows: int, block: int
) -> tuple[DataFrame, DataFrame]:
    """The vectors' features, and class with n_links and component_id."""
    features = materialise(_vectors(table, vector, key, label), "vectors")
    valid = features.filter("class is not null")
    classes = materialise(
        valid.groupBy("class").agg(
            F.min("key").alias("key"),
            F.count("*").alias("weight"),
            F.any_value("label_hash").alias("label_hash"),
            F.any_value("dim").alias("dim"),
            F.any_value("vec").alias("vec"),
        ),
        "vector-classes",
    )
    largest = classes.groupBy("label_hash", "dim").count().agg(F.max("count")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(largest, 1) / cell_rows)))
    tables = calibrate(least, bits, window, count, miss)
    width = window * math.sqrt(2 - 2 * least)
    single = table.schema[vector].dataType.simpleString() == "array<float>"
    placed = materialise(_placed(classes, tables, bits, single), "placed")
    cell = ["label_hash", "dim", "table", "cell"]
    counts = materialise(placed.groupBy(*cell).agg(F.count("*").alias("n")).filter("n > 1"), "cells")
    rows = placed.join(counts, cell).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"b1": F.least("side", "other"), "b2": F.greatest("side", "other")})
    rows = rows.join(classes.select("class", "weight", "vec"), "class")
    found = materialise(_cell_links(rows, tables, bits, single, least, width, count), "vector-links")
    sums = found.groupBy("class").agg(F.sum("links").alias("links"))
    roots = materialise(connected_components(found.select(F.col("class").alias("a"), F.col("root").alias("b"))), "vector-roots")
    of_class = classes.select("class", "key", "weight").join(roots.withColumnRenamed("node", "class"), "class", "left").join(sums, "class", "left")
    of_class = materialise(
        of_class.select("class", "key", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "class-links"
    )
    leasts = materialise(of_class.groupBy("root").agg(F.min("key").alias("component_id")), "vector-components")
    return features, materialise(of_class.join(leasts, "root").select("class", "n_links", "component_id"), "class-vectors")
