"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until splitters fit, then one exchange.

Rows are ordered by the hash of their text, then by a hash of the row, so equal texts are neighbours. A pass counts,
for the 4,096 sub-intervals of every interval that holds an unsettled splitter, exact bytes and rows; a splitter
settles on a boundary within ``tolerance`` of a shard's size, or else on the nearer side of the group of equal texts that it falls in. Only a group of
more than ``CUT`` of a shard's bytes is cut, by the row's hash. So a shard's size is off by at most CUT of a shard at each end. On the driver: 4,096 sums an open
splitter and pass.

Only DataFrame functions. Edge cases: null text has size 8 and is one group; repeated rows with equal keys stay together and are
numbered apart; an empty table gives an empty result; other columns pass through and the names added replace their namesakes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, scratch

DIGIT, BITS = 12, 60
LEVELS = BITS // DIGIT
#: The part of a shard's bytes above which a group of equal texts is cut.
CUT = 0.25
ADDED = ("size", "shard", "slot")


def text_key(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - BITS)


def row_key(*columns: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(5)), 64 - BITS)


def find_splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``keys``: h, t, size. The shards - 1 boundaries (h, t); a row belongs past a boundary if (h, t) is not below it."""
    settled: dict[int, tuple[int, int]] = {}
    # An open splitter: the prefix of its interval and the bytes below it. Digits of h come first, then those of t.
    open_: dict[int, tuple[int | None, int, int]] = {i: (None, 0, 0) for i in range(1, shards)}
    total = 0
    for level in range(2 * LEVELS):
        if not open_:
            break
        first = level < LEVELS
        shift = BITS - DIGIT * (level % LEVELS + 1)
        digit = F.shiftrightunsigned("h" if first else "t", shift)
        parent = F.shiftrightunsigned("h" if first else "t", shift + DIGIT) if level % LEVELS else F.lit(0).cast("long")
        rows = keys
        if level:
            prefixes = {(h if h is not None else 0, p) for h, p, _ in open_.values()}
            if first:
                rows = rows.filter(parent.isin([p for _, p in prefixes]))
            else:
                wanted = F.lit(False)
                for h, p in prefixes:
                    wanted |= (F.col("h") == h) & (parent == p)
                rows = rows.filter(wanted)
        group = F.lit(0).cast("long") if first else F.col("h")
        found = rows.groupBy(group.alias("g"), digit.alias("d")).agg(F.sum("size").alias("n"), F.count("*").alias("c")).collect()
        sums: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in found:
            sums.setdefault((r["g"], r["d"] >> DIGIT), []).append((r["d"], r["n"], r["c"]))
        if level == 0:
            total = sum(r["n"] for r in found)
        near = tolerance * total / shards
        for i, (h, prefix, below) in list(open_.items()):
            want = total * i / shards
            for d, n, c in sorted(sums.get((h or 0, prefix), [])):
                if below + n < want:
                    below += n
                    continue
                low, high = want - below, below + n - want
                bound = lambda x: (x << shift, 0) if first else (h, x << shift)  # noqa: B023, E731
                whole = level == LEVELS - 1 and n <= CUT * total / shards  # one text's rows
                if min(low, high) <= near or c <= 1 or whole or level == 2 * LEVELS - 1:
                    settled[i] = bound(d if low <= high else d + 1)
                    del open_[i]
                else:
                    open_[i] = (None, d, below) if level < LEVELS - 1 else (d, 0, below) if first else (h, d, below)
                break
            else:  # no rows at all
                settled[i] = (0, 0)
                del open_[i]
    return [settled[i] for i in range(1, shards)]


def shard_of(h: Column, t: Column, splitters: list[tuple[int, int]]) -> Column:
    past = [((h > a) | ((h == a) & (t >= b))).cast("int") for a, b in splitters]
    out = F.lit(0)
    for p in past:
        out = out + p
    return out


def shard_documents(docs: DataFrame, shards: int = 24, text: str = "text", key: str = "doc_id", tolerance: float = 0.002, bucket_rows: int = 20_000) -> DataFrame:
    """``docs`` with size, shard and slot, dealt by one exchange to (shard, bucket) and numbered without gaps within each shard."""
    own = [c for c in docs.columns if c not in ADDED]
    sized = docs.select(*own).withColumns(
        {
            "size": (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long"),
            "__h": text_key(F.col(text)),
            "__t": row_key(F.col(key), F.col(text)),
        }
    )
    with scratch(docs.sparkSession) as kept:
        keys = materialise(sized.select(F.col("__h").alias("h"), F.col("__t").alias("t"), "size"), "shard-keys")
        splitters = find_splitters(keys, shards, tolerance)
        buckets = max(16, keys.count() // (shards * bucket_rows))
        bucket = lambda t: F.pmod(F.xxhash64(t), F.lit(buckets))
        counts = keys.groupBy(shard_of(F.col("h"), F.col("t"), splitters).alias("shard"), bucket(F.col("t")).alias("__bucket")).agg(F.count("*").alias("__n"))
        before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        bases = materialise(counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base")), "shard-bases")
        kept.append(bases)
    dealt = sized.withColumns({"shard": shard_of(F.col("__h"), F.col("__t"), splitters), "__bucket": bucket(F.col("__t"))})
    within = Window.partitionBy("shard", "__bucket").orderBy("__h", "__t")
    numbered = dealt.withColumn("__row", F.row_number().over(within)).join(bases, ["shard", "__bucket"])
    return numbered.select(*own, "size", "shard", (F.col("__base") + F.col("__row") - 1).alias("slot"))
