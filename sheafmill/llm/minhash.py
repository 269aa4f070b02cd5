"""Near-duplicate documents by b-bit MinHash: band candidates, bit-count estimates, links confirmed on whole sets.

1. One pass over the texts: word and shingle hashes (64 bits), the set's 128-bit class, K minima; kept of these are their
   low b bits, packed, and one hash a band. Documents with equal sets are one class from here on.
2. Classes meet in band buckets. Buckets of one class go before signatures are attached.
3. In a bucket, packed signatures are compared by counting equal b-bit lanes; with chance agreement 2^-b, the similarity is
   (agreement - 2^-b) / (1 - 2^-b). Only a spanning forest of the most similar pairs leaves a bucket, never all pairs.
   A bucket of more than ``block`` classes is dealt into blocks.
4. The forest's pairs are confirmed on whole shingle sets and joined to components. Classes that the forest holds together are a family.
   Where a family is several components, pairs of different components whose estimate is within the margin are confirmed too, most
   similar first, unless they are joined by then: within the family if it has at most ``family_rows`` classes, else within each of its
   band buckets. The group's largest component is the index, all others are queries; both are dealt into blocks, and a task holds one block
   of each. So no link between components is lost, and only links that join two components leave a task.
``calibrate`` chooses rows, bands and the margin so that a pair exactly at the threshold is missed with a probability of at most ``miss`` by
the bands, and with as much by the estimate.

Edge cases: null text, or one without words, has no shingles and links with nothing; a text with fewer words than a shingle is one shingle;
repeated rows are copies of one class; a null key never is a component's least key unless all are null; an empty table gives an empty result;
other columns stay out of the shuffles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import fresh, materialise, scratch
from .graph import binary_matrix, connected_components, whole_groups

K, BITS = 128, 4
#: Up to this many wanted texts their hashes are broadcast (16 bytes each); beyond, the join is shuffled.
MAX_BROADCAST_TEXTS = 200_000

_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _RNG.integers(1, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RNG.integers(1, 1 << 63, K, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def calibrate(percent: int, miss: float) -> tuple[int, int, float]:
    """Rows of a band, bands, and how far an estimate may fall below the threshold, for pairs exactly at it."""
    s = percent / 100
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - s**rows)) if s < 1 else 1
        if rows * bands <= K:
            break
    agree = s + (1 - s) * 2.0**-BITS
    return rows, min(bands, K // rows), NormalDist().inv_cdf(1 - miss) * math.sqrt(agree * (1 - agree) / K) / (1 - 2.0**-BITS)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and each text's number of words."""
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", dtype=np.uint8) if texts else np.zeros(0, np.uint8)
    blank = _IS_BLANK[raw]
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    end = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    length = end - begin
    first = np.cumsum(length) - length
    place = np.arange(first[-1] + length[-1]) - np.repeat(first, length)
    sums = np.add.reduceat(_BYTE[raw[~blank]] * _powers(int(length.max()), np.uint64(0xD1342543DE82EF95))[place], first)
    return _mix(sums + length.astype(np.uint64) * _STEP), np.diff(np.searchsorted(begin, np.concatenate([[0], np.cumsum(sizes)])))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    n = len(hashes)
    factors = _powers(words + 1, np.uint64(0xA0761D6478BD642F))
    rolled = np.zeros(max(n - words + 1, 0), dtype=np.uint64)
    for k in range(words if len(rolled) else 0):
        rolled += hashes[k : k + len(rolled)] * factors[k + 1]
    rolled = _mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            out.append(np.unique(rolled[at : at + c - words + 1]))
        elif c:
            out.append(_mix((hashes[at : at + c] * factors[1 : c + 1]).sum(dtype=np.uint64, keepdims=True) + np.full(1, c, np.uint64) * _STEP))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray], rows: int = 5, n_bands: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """For non-empty sets: packed low bits of the minima (rows of K * BITS / 8 bytes) and band hashes."""
    sizes = np.array([len(s) for s in sets])
    first = np.cumsum(sizes) - sizes
    all_ = np.concatenate(sets)
    minima = np.empty((len(sets), K), dtype=np.uint64)
    for k in range(K):
        minima[:, k] = np.minimum.reduceat((all_ ^ _XOR[k]) * _MUL[k], first)
    mixed = _mix(minima)
    low = (mixed & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    packed = low[:, 0::2] | low[:, 1::2] << 4
    bands = np.zeros((len(sets), n_bands), dtype=np.uint64)
    for r in range(rows):
        bands = _mix(bands * _STEP + mixed[:, r : rows * n_bands : rows] + np.arange(n_bands, dtype=np.uint64))
    return np.ascontiguousarray(packed), bands


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarity of packed signatures (rows of 64-bit words)."""
    x = one ^ many
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    agree = 1 - np.bitwise_count(x).sum(axis=-1, dtype=np.int64) / K
    return (agree - 2.0**-BITS) / (1 - 2.0**-BITS)


def _text_groups(column, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes), about ``most`` bytes at a time and always whole texts."""
    at, size, held = 0, 0, []
    for i, t in enumerate(t for start in range(0, len(column), 256) for t in column.slice(start, 256).to_pylist()):
        b = (t or "").encode()
        held.append(b)
        size += len(b)
        if size >= most or len(held) >= 1000:
            yield at, held
            at, size, held = i + 1, 0, []
    if held:
        yield at, held


def document_features(docs: DataFrame, text: str, key: str, words: int, rows: int, n_bands: int) -> DataFrame:
    """key, text_hash, n_shingles, class (16 bytes), sig and bands (binaries); no class without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _text_groups(batch.column(2)):
                sets = shingle_sets(texts, words)
                full = [i for i, s in enumerate(sets) if len(s)]
                classes, sigs, bands = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if full:
                    packed, keys = signatures([sets[i] for i in full], rows, n_bands)
                    for j, i in enumerate(full):
                        s = sets[i]
                        classes[i] = np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s)), _mix(s + _STEP).sum(dtype=np.uint64)]).tobytes()
                        sigs[i], bands[i] = packed[j].tobytes(), keys[j].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)),
                        batch.column(1).slice(at, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(classes, pa.binary()),
                        pa.array(sigs, pa.binary()),
                        pa.array(bands, pa.binary()),
                    ],
                    names=["key", "text_hash", "n_shingles", "class", "sig", "bands"],
                )

    schema = StructType().add("key", docs.schema[key].dataType)
    for f in StructType.fromDDL("text_hash long, n_shingles long, class binary, sig binary, bands binary"):
        schema.add(f)
    return docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text)).mapInArrow(run, schema)


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """bucket, class: a row a class and band, without buckets of one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = binary_matrix(batch.column(1), "<i8")
                took = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column(0).take(took)], names=["bucket", "class"])

    rows = classes.select("class", "bands").mapInArrow(run, "bucket long, class binary")
    rows = materialise(rows, "bands")
    counts = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "buckets")
    return rows.join(counts, "bucket")


_PAIRS = "a binary, b binary"


def _pairs(classes: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([classes[i] for i in a], pa.binary()), pa.array([classes[i] for i in b], pa.binary())], names=["a", "b"])


def _forest(sig: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs with an estimate of ``least`` or more, most similar pairs first (Prim)."""
    n = len(sig)
    best, parent, out = np.full(n, -1.0), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    at = 0
    for _ in range(n):
        out[at] = False
        e = estimate(sig[at], sig)
        better = out & (e > best)
        best[better], parent[better] = e[better], at
        if not out.any():
            return
        at = int(np.argmax(np.where(out, best, -2.0)))
        if best[at] >= least:
            yield at, int(parent[at])


def _forest_pairs(rows: DataFrame, least: float) -> DataFrame:
    """rows: bucket, block, class, sig. Pairs of each block's forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, ["bucket", "block"]):
            sig, classes = binary_matrix(t.column("sig"), "<u8"), t.column("class").to_pylist()
            two = np.flatnonzero(np.diff(first) == 2)
            a = first[two]
            near = estimate(sig[a], sig[a + 1]) >= least
            left, right = [a[near]], [a[near] + 1]
            for g in np.flatnonzero(np.diff(first) > 2):
                found = np.array(list(_forest(sig[first[g] : first[g + 1]], least)), dtype=np.int64).reshape(-1, 2) + first[g]
                left.append(found[:, 0])
                right.append(found[:, 1])
            yield _pairs(classes, np.concatenate(left), np.concatenate(right))

    dealt = rows.select("bucket", "block", "class", "sig").repartition("bucket", "block").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, _PAIRS)


def _crossing_links(rows: DataFrame, least: float, percent: int) -> DataFrame:
    """rows: group, bi, bq, class, sig, set, root, outer, query. Links of a query and an index row of its task that join two components there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_groups(batches, ["group", "bi", "bq"]):
            sig, classes = binary_matrix(t.column("sig"), "<u8"), t.column("class").to_pylist()
            sets = [np.frombuffer(x, "<u8") for x in t.column("set").to_pylist()]
            sizes = np.array([len(x) for x in sets])
            part = np.unique(np.array(t.column("root").to_pylist(), dtype=object), return_inverse=True)[1]
            rank = np.unique(np.array(classes, dtype=object), return_inverse=True)[1]
            query, outer = t.column("query").to_numpy(), t.column("outer").to_numpy()
            left, right = [], []
            for g in range(len(first) - 1):
                own = slice(first[g], first[g + 1])
                index = np.flatnonzero(~query[own]) + first[g]
                found = []
                for q in np.flatnonzero(query[own]) + first[g]:
                    alike = 100 * np.minimum(sizes[index], sizes[q]) >= percent * np.maximum(sizes[index], sizes[q])
                    # Two queries meet twice, once in each role: the pair is taken once.
                    near = index[alike & (part[index] != part[q]) & (~outer[index] | (rank[index] < rank[q]))]
                    e = estimate(sig[q], sig[near])
                    found += zip(-e[e >= least], np.full((e >= least).sum(), q), near[e >= least], strict=True)
                joined: dict[int, int] = {}

                def top(x: int) -> int:
                    while x in joined:  # noqa: B023
                        x = joined[x]  # noqa: B023
                    return x

                for _, q, i in sorted(found):  # most similar first: what is joined by then need not be confirmed
                    x, y = top(int(part[q])), top(int(part[i]))
                    if x != y and _linked(sets[q], sets[i], percent):
                        joined[max(x, y)] = min(x, y)
                        left.append(q)
                        right.append(i)
            yield _pairs(classes, np.array(left, dtype=np.int64), np.array(right, dtype=np.int64))

    keys = ["group", "bi", "bq"]
    dealt = rows.select(*keys, "class", "sig", "set", "root", "outer", "query").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, _PAIRS)


def _linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _distinct_pairs(pairs: DataFrame, tag: str) -> DataFrame:
    return materialise(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), tag)


def _class_sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """class, set: whole shingle sets of the wanted classes (class, text_hash), from one text of each."""
    wanted = materialise(wanted, "wanted")
    small = F.broadcast if wanted.count() <= MAX_BROADCAST_TEXTS else lambda x: x
    texts = docs.select(F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).join(small(wanted), "text_hash")
    texts = texts.groupBy("class").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in _text_groups(batch.column(1)):
                sets = [s.tobytes() for s in shingle_sets(held, words)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(sets, pa.binary())], names=["class", "set"])

    return materialise(texts.mapInArrow(run, "class binary, set binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = [_linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in both]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    left = sets.select(F.col("class").alias("a"), F.col("set").alias("__x"))
    right = sets.select(F.col("class").alias("b"), F.col("set").alias("__y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "__x", "__y").mapInArrow(run, _PAIRS)


def _groups(members: DataFrame, group: str) -> DataFrame:
    """Of each group of several components: its key, the largest one, how many classes it has and how many of them are in that one."""
    parts = members.groupBy(group, "root").agg(F.count("*").alias("m")).groupBy(group)
    found = parts.agg(F.count("*").alias("parts"), F.max_by("root", "m").alias("main"), F.sum("m").alias("n"), F.max("m").alias("most"))
    return found.filter("parts > 1").drop("parts")


def _open_members(labelled: DataFrame, rows: DataFrame, family_rows: int) -> DataFrame:
    """group, class, root, main, n, most of the families of several components; of a family of more than ``family_rows`` classes, of its band buckets."""
    families = materialise(_groups(labelled, "family"), "families-apart")
    small = families.filter(F.col("n") <= family_rows)
    members = labelled.join(small, "family").withColumn("group", F.xxhash64("family")).drop("family")
    large = families.filter(F.col("n") > family_rows).select("family")
    if large.limit(1).count():
        within = labelled.join(large, "family").select("class", "root").join(rows.select("bucket", "class"), "class")
        within = materialise(within, "large-families")
        split = within.join(_groups(within, "bucket"), "bucket").withColumn("group", F.xxhash64("bucket", F.lit(1))).drop("bucket")
        members = members.unionByName(split)
    return members


def _second_round(labelled: DataFrame, rows: DataFrame, classes: DataFrame, sets: DataFrame, least: float, percent: int, block: int, family_rows: int) -> DataFrame:
    """Links that join components of one family."""
    blocks = lambda n: F.ceil(n / block).cast("long")
    open_ = _open_members(labelled, rows, family_rows).withColumns({"ni": blocks(F.col("n")), "nq": blocks(F.col("n") - F.col("most")), "outer": F.col("root") != F.col("main")})
    open_ = open_.join(classes.select("class", "sig"), "class").join(sets, "class")
    open_ = materialise(open_.select("group", "class", "root", "ni", "nq", "outer", "sig", "set"), "open")
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    index = open_.withColumn("bi", F.pmod(F.xxhash64("class"), F.col("ni"))).withColumn("bq", all_of("nq")).withColumn("query", F.lit(False))
    query = open_.filter("outer").withColumn("bq", F.pmod(F.xxhash64("class"), F.col("nq"))).withColumn("bi", all_of("ni")).withColumn("query", F.lit(True))
    return materialise(_crossing_links(index.unionByName(query), least, percent), "links-2")


def near_duplicates(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    words: int = 5,
    percent: int = 85,
    miss: float = 1e-5,
    block: int = 500,
    family_rows: int = 20_000,
) -> DataFrame:
    """Per document: key, n_shingles, component_id (the least key reachable by links) and kept (whether that is its own key)."""
    with scratch(docs.sparkSession) as held:
        features, named = _components(docs, text, key, words, percent, miss, block, family_rows)
        held += [features, named]
    spoken = features.filter("class is not null")
    out = spoken.select("key", "n_shingles", "class").join(named, "class").select("key", "n_shingles", "component_id")
    alone = features.filter("class is null").select("key", "n_shingles", F.col("key").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("key").eqNullSafe(F.col("component_id"))).withColumnRenamed("key", key)


def _components(docs: DataFrame, text: str, key: str, words: int, percent: int, miss: float, block: int, family_rows: int) -> tuple[DataFrame, DataFrame]:
    """The documents' features, and class with component_id."""
    band_rows, n_bands, margin = calibrate(percent, miss)
    features = materialise(document_features(docs, text, key, words, band_rows, n_bands), "features")
    spoken = features.filter("class is not null")
    classes = materialise(
        spoken.groupBy("class").agg(
            F.min("key").alias("key"), F.min("text_hash").alias("text_hash"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")
        ),
        "classes",
    )
    least = percent / 100 - margin
    rows = _bucket_rows(classes).join(classes.select("class", "sig"), "class")
    rows = materialise(rows.select("bucket", "class", "sig", "n", F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / block).cast("long")).alias("block")), "bucket-rows")
    first = _distinct_pairs(_forest_pairs(rows, least), "forest")
    ends = rows.select("class").distinct()
    sets = _class_sets(docs, text, words, classes.join(ends, "class", "left_semi").select("class", "text_hash"))
    links = materialise(_confirmed(first, sets, percent), "links-1")
    roots = materialise(connected_components(links), "roots-1")
    bridges = rows.filter(F.col("n") > block).select(F.col("class").alias("a"), F.unhex(F.hex("bucket")).alias("b"))  # a bucket in blocks is a node
    families = materialise(connected_components(first.unionByName(bridges)), "families").select(F.col("node").alias("class"), F.col("root").alias("family"))
    families = families.filter(F.octet_length("class") == 16)  # without the buckets
    labelled = families.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    more = _second_round(materialise(labelled, "labelled"), rows, classes, sets, least, percent, max(1, block // 2), family_rows)
    joined = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = materialise(connected_components(joined), "roots")
    of_class = classes.select("class", "key").join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    of_class = materialise(of_class, "class-roots")
    leasts = materialise(of_class.groupBy("root").agg(F.min("key").alias("component_id")), "components")
    return features, materialise(of_class.join(leasts, "root").select("class", "component_id"), "class-components")


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: of its least (key, text hash), null keys last; rows without shingles all stay.

    Rows are told apart by key and text, not by key alone; of rows equal in both, the one with the least hash of all columns stays.
    """
    names, (k, h, row) = [F.col(f"`{c}`") for c in docs.columns], fresh(docs, "__k", "__h", "__row")
    shown = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]  # maps have no hash
    own = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    seen = materialise(near_duplicates(docs.select(own.alias("__id"), F.col(text)), text, "__id", **options).select("__id.k", "__id.h", "n_shingles", "kept"), "seen")

    def listed(rows: DataFrame, tag: str) -> tuple[DataFrame, int]:
        rows = materialise(rows.select(F.col("k").alias(k), F.col("h").alias(h)), tag)
        n = rows.count()
        return (F.broadcast(rows) if n <= MAX_BROADCAST_TEXTS else rows), n

    same = F.col(key).eqNullSafe(F.col(k)) & (F.xxhash64(text) == F.col(h))
    repeated, n_repeated = listed(seen.filter("kept and n_shingles > 0").groupBy("k", "h").count().filter("count > 1"), "repeated")
    gone = seen.filter("not kept").select("k", "h").distinct()
    if n_repeated:
        gone = gone.unionByName(repeated.select(F.col(k).alias("k"), F.col(h).alias("h")))
    kept = docs.join(listed(gone, "dropped")[0], same, "left_anti").select(*names)
    if n_repeated:
        rows = docs.join(repeated, same).groupBy(k, h).agg(F.min_by(F.struct(*names), F.xxhash64(*shown)).alias(row))
        kept = kept.unionByName(rows.select(f"{row}.*"))
    return kept
