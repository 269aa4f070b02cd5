"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, then seeded selection.

Every source is dealt by hash into streams. A stream's documents, in seeded hash order, are one run of words cut into
equal blocks. The streams of all sources with the same block get integer quotas by highest quotients; a stream with n blocks and
a quota of q takes each block q // n times and a seeded, evenly spread q % n of them once more. Which blocks those
are is arithmetic on the block number, so no block is ever a row.

A block has ``block_words`` words, but a source whose target is under ``FINE`` such blocks has one of the largest power of two that goes ``FINE`` times into its
target, of one word at least. A stream is entitled to its blocks times its source's target over its size. So a source's taken words differ from its
target by about a block a stream: a FINE-th of the target, or a word where that is more.

Positions come from sums by (source, bucket), then a window within a bucket, so a source with a third of all rows is many tasks. Up to
``driver_sources`` sources are apportioned on the driver: a row a source and one a stream, at most ``MAX_STREAMS`` plus two a source. More
are apportioned as tables: the water level and the multiplier are found by sums, and what ties leave over goes by rank.

Edge cases: null text has size 0 and takes nothing; a null source is a source, the last one; repeated rows are
documents of their own and share a stream; an empty table gives an empty result. ``plan_mixture`` passes other columns through, and the names that it
adds replace their namesakes; ``mix_documents`` returns all columns as they came.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, materialise, n_words, scratch

MAX_STREAMS = 256
FINE = 16
ADDED = ("size", "source_size", "target", "taken", "stream", "start", "repeats", "block", "n_blocks", "extra", "phase")


def water_fill(sizes: list[int], weights: list[float], most: float = 3.0, total: float | None = None) -> list[float]:
    """Targets by weight that sum to ``total`` (all sizes), none above ``most`` times its size; excess is reshared by weight."""
    left = float(sum(sizes)) if total is None else float(total)
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / share > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / share
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            open_.discard(i)
        left -= sum(targets[i] for i in over)
    return targets


def sainte_lague(entitled: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by highest quotients entitled / (2 * held + 1), none above its most; ties go to the first."""
    if not entitled or seats <= 0:
        return [0] * len(entitled)
    factor = seats / max(sum(entitled), 1e-9)
    held = [min(m, math.floor(e * factor + 0.5)) for e, m in zip(entitled, most, strict=True)]
    while sum(held) > seats:  # a smaller multiplier's rounding is a beginning of the same order of quotients
        factor *= 1 - max(1e-9, (sum(held) - seats) / (2 * seats))
        held = [min(m, math.floor(e * factor + 0.5)) for e, m in zip(entitled, most, strict=True)]
    rest = seats - sum(held)
    heap = [(-e / (2 * h + 1), i) for i, (e, h, m) in enumerate(zip(entitled, held, most, strict=True)) if h < m]
    heapq.heapify(heap)
    while rest and heap:
        _, i = heapq.heappop(heap)
        held[i] += 1
        rest -= 1
        if held[i] < most[i]:
            heapq.heappush(heap, (-entitled[i] / (2 * held[i] + 1), i))
    return held


def _chosen_before(k: str) -> str:
    """SQL: how many of the first k blocks of the stream are taken once more."""
    return f"(({k}) * extra + phase) div n_blocks"


def _words_before(p: str) -> str:
    """SQL: how many of the stream's first p words those blocks hold."""
    k = f"(({p}) div block)"
    return f"({_chosen_before(k)}) * block + (({p}) % block) * (({_chosen_before(f'{k} + 1')}) - ({_chosen_before(k)}))"


def block_sizes(block_words: int) -> list[int]:
    """The blocks that sources may have: ``block_words`` and the powers of two below."""
    return [1 << i for i in range(block_words.bit_length()) if 1 << i < block_words] + [block_words]


def block_of(target: float, block_words: int) -> int:
    return max(b for b in block_sizes(block_words) if b == 1 or FINE * b <= target)


def _numbered(rows: DataFrame, *order, tag: str) -> DataFrame:
    """``rows`` with __at: their places from 0 in this order, numbered by the tasks of a range partitioning."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    spread = materialise(spread.withColumn("__part", F.shiftright("__id", 33)), tag)
    sizes = sorted((r[0], r[1]) for r in spread.groupBy("__part").count().collect())  # a row a task
    before, bases = 0, []
    for part, n in sizes:
        bases.append((part, before))
        before += n
    bases = rows.sparkSession.createDataFrame(bases, "__part long, __base long")
    return spread.join(F.broadcast(bases), "__part").withColumn("__at", F.col("__base") + F.col("__id").bitwiseAND((1 << 33) - 1)).drop("__id", "__part", "__base")


def _joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """An inner join on keys that may be null, each kept once."""
    named = right.withColumnsRenamed({k: f"{k}_" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    return left.join(named, on).drop(*[f"{k}_" for k in keys])


STREAMS = "__s long, __t long, source_size long, target double, __n long, stream string, repeats long, block long, n_blocks long, extra long, phase long"


def _streams_on_driver(sums: DataFrame, weights: tuple[float, ...], most: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    spark, source_type = sums.sparkSession, sums.schema["__src"].dataType
    found = sums.groupBy("__src").agg(F.sum("__n")).collect()
    found = sorted(((r[0], r[1] or 0) for r in found), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [n for _, n in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
    stream_words = max(20_000, sum(sizes) // MAX_STREAMS)
    own = f"__src {source_type.simpleString()}"
    streams = [max(1, -(-n // stream_words)) for n in sizes]
    sources = spark.createDataFrame([(s, k) for (s, _), k in zip(found, streams, strict=True)], f"{own}, __streams long")
    rank = {s: i for i, (s, _) in enumerate(found)}
    dealt = _dealt(sums, sources).groupBy("__src", "__t").agg(F.sum("__n").alias("n")).collect()
    dealt = sorted((rank[r["__src"]], r["__t"], r["n"]) for r in dealt)
    rows = []
    for size in block_sizes(block):
        own_streams = [d for d in dealt if block_of(targets[d[0]], block) == size]
        blocks = [-(-n // size) for _, _, n in own_streams]
        entitled = [targets[s] * n / max(1, sizes[s]) for (s, _, _), n in zip(own_streams, blocks, strict=True)]
        quotas = sainte_lague(entitled, round(sum(entitled)), [most * n for n in blocks])
        for (s, t, words), n, q in zip(own_streams, blocks, quotas, strict=True):
            n = max(n, 1)
            rows.append((found[s][0], s, t, sizes[s], targets[s], words, f"{s}-{t}", q // n, size, n, q % n, (s * 7919 + t * 104_729 + seed * 31) % n))
    return sources, spark.createDataFrame(rows, f"{own}, {STREAMS}")


def _dealt(sums: DataFrame, sources: DataFrame) -> DataFrame:
    """``sums`` with __t and __b: the stream of each fine bucket and its place there. Sources of one stream need not be listed."""
    many = F.broadcast(sources.filter("__streams > 1"))  # at most MAX_STREAMS of them
    named = many.withColumnRenamed("__src", "__src_")
    out = sums.join(named, F.col("__src").eqNullSafe(F.col("__src_")), "left").drop("__src_").withColumn("__streams", F.coalesce("__streams", F.lit(1).cast("long")))
    return out.withColumns({"__t": F.pmod("__fine", "__streams"), "__b": F.floor(F.col("__fine") / F.col("__streams"))})


def _streams_as_tables(sums: DataFrame, weights: tuple[float, ...], most: int, block: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The same plan with nothing of the size of the sources on the driver."""
    sizes = sums.groupBy("__src").agg(F.sum("__n").alias("source_size"))
    ranked = _numbered(sizes, F.col("__src").isNull(), F.col("__src"), tag="mix-sources").withColumnRenamed("__at", "__s")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__s") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("__w", weight), "mix-weights")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, F.lit(False)
    while True:  # the level rises until no further source is above its most
        r = ranked.agg(F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("__w")))).first()
        if not r[1] or (total - most * (r[0] or 0)) / r[1] <= level:
            break
        level = (total - most * (r[0] or 0)) / r[1]
        capped = level * F.col("__w") > most * F.col("source_size")
    target = F.least(level * F.col("__w"), (most * F.col("source_size")).cast("double"))
    stream_words = max(20_000, total // MAX_STREAMS)
    ranked = ranked.withColumns({"target": target, "__streams": F.greatest(F.lit(1), F.ceil(F.col("source_size") / stream_words)).cast("long")})
    dealt = _dealt(sums, ranked.select("__src", "__streams")).groupBy("__src", "__t").agg(F.sum("__n").alias("__n"))
    own = _joined(dealt, ranked.drop("__w", "__streams"), "__src")
    fitting = [F.when(F.col("target") >= FINE * b, b) for b in reversed(block_sizes(block)) if b > 1]
    own = own.withColumn("block", F.coalesce(*fitting, F.lit(1)).cast("long"))
    own = own.withColumn("__blocks", F.ceil(F.col("__n") / F.col("block")))
    own = own.withColumn("__e", F.col("target") * F.col("__blocks") / F.greatest(F.lit(1), "source_size"))
    own = materialise(own, "mix-entitled")
    seats = {r["block"]: round(r["e"] or 0.0) for r in own.groupBy("block").agg(F.sum("__e").alias("e")).collect()}  # a row a block size
    held = lambda f: F.least(most * F.col("__blocks"), F.floor(F.col("__e") * f + 0.5))
    of = lambda values: F.coalesce(*[F.when(F.col("block") == b, F.lit(float(v))) for b, v in values.items()], F.lit(0.0))
    low, high = dict.fromkeys(seats, 0.0), dict.fromkeys(seats, 2.0)
    for _ in range(12):  # the largest multiplier whose rounding stays within the seats, narrowed 32 times a pass
        tried = {b: [low[b] + (high[b] - low[b]) * i / 32 for i in range(1, 32)] for b in seats}
        taken = own.groupBy("block").agg(*[F.sum(held(of({b: t[i] for b, t in tried.items()}))).alias(f"n{i}") for i in range(31)]).collect()
        for r in taken:
            b = r["block"]
            fits = sum((r[f"n{i}"] or 0) <= seats[b] for i in range(31))
            low[b], high[b] = [low[b], *tried[b], high[b]][fits : fits + 2]
    own = own.withColumn("__q", held(of(low)))
    rest = {r["block"]: seats[r["block"]] - (r["q"] or 0) for r in own.groupBy("block").agg(F.sum("__q").alias("q")).collect()}
    nexts = F.when(F.col("__q") < most * F.col("__blocks"), F.col("__e") / (2 * F.col("__q") + 1)).otherwise(-1.0)
    own = _numbered(own.withColumn("__next", nexts), F.asc("block"), F.desc("__next"), F.asc("__s"), F.asc("__t"), tag="mix-quotas")
    first = own.groupBy("block").agg(F.min("__at").alias("at")).collect()
    own = own.withColumn("__at", F.col("__at") - of({r["block"]: r["at"] for r in first}).cast("long"))
    rest = of(rest)
    own = own.withColumns({"__q": F.col("__q") + ((F.col("__at") < rest) & (F.col("__next") >= 0)).cast("long"), "n_blocks": F.greatest(F.lit(1), "__blocks")})
    phase = F.pmod(F.col("__s") * 7919 + F.col("__t") * 104_729 + seed * 31, "n_blocks")
    own = own.withColumns({"stream": F.concat_ws("-", "__s", "__t"), "repeats": F.floor(F.col("__q") / F.col("n_blocks")), "extra": F.pmod("__q", "n_blocks"), "phase": phase})
    split = ranked.filter("__streams > 1").select("__src", "__streams")
    split = sums.sparkSession.createDataFrame(split.collect(), split.schema)  # at most MAX_STREAMS
    return split, materialise(own.select("__src", "__s", "__t", "source_size", "target", "__n", "stream", "repeats", "block", "n_blocks", "extra", "phase"), "mix-streams")


def _planned(
    sized: DataFrame, weights: tuple[float, ...], most: int, block_words: int, seed: int, buckets: int, driver_sources: int
) -> tuple[DataFrame, DataFrame]:
    """``sized`` (__src, size, __order and what is passed through) with ADDED, and the table that it reads."""
    sized = sized.withColumn("__fine", F.pmod(F.xxhash64("__order", F.lit(1)), F.lit(buckets).cast("long")))
    sums = materialise(sized.groupBy("__src", "__fine").agg(F.sum("size").alias("__n")), "mix-sums")
    few = sums.select("__src").distinct().limit(driver_sources + 1).count() <= driver_sources
    sources, streams = (_streams_on_driver if few else _streams_as_tables)(sums, weights, most, block_words, seed)
    before = Window.partitionBy("__src", "__t").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bases = _dealt(sums, sources).select("__src", "__t", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # Keys without nulls: the window's partitioning then serves the join too, and texts are exchanged once.
    plain = {"__none": F.col("__src").isNull(), "__name": F.coalesce(F.col("__src").cast("string"), F.lit(""))}
    place = [*plain, "__t", "__b"]
    bases = materialise(_joined(bases, streams.drop("__s", "__n"), "__src", "__t").withColumns(plain).drop("__src"), "mix-bases")
    within = Window.partitionBy(*place).orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
    placed = _dealt(sized, sources).drop("__streams", "__fine").withColumns(plain).withColumn("__before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    ranked = placed.join(bases.hint("merge"), place).withColumn("start", F.col("__base") + F.col("__before"))
    taken = f"repeats * size + ({_words_before('start + size')}) - ({_words_before('start')})"
    return ranked.withColumn("taken", F.expr(taken)), bases


def _sized(docs: DataFrame, text: str, source: str, key: str, seed: int, *passed) -> DataFrame:
    order = F.xxhash64(F.col(key), F.xxhash64(F.col(text)), F.lit(seed))
    return docs.select(*passed, F.col(source).alias("__src"), n_words(F.col(text)).alias("size"), order.alias("__order"))


def _packed(docs: DataFrame, columns: list[str]):
    """Columns passed through, as one whose name clashes with none."""
    return F.struct(F.lit(0).alias(fresh(docs, "__")[0]), *[F.col(f"`{c}`") for c in columns]).alias("__doc")


def plan_mixture(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    block_words: int = 32,
    seed: int = 17,
    buckets: int = 65_536,
    driver_sources: int = 100_000,
) -> DataFrame:
    """``docs`` without the text, with ADDED: each document's size, its source's size and target, and how many of its words are taken.

    Texts are read once: sizes and the columns passed through are a table from then on.
    """
    own = [c for c in docs.columns if c not in (*ADDED, text)]
    with scratch(docs.sparkSession) as held:
        sized = materialise(_sized(docs, text, source, key, seed, _packed(docs, own)), "mix-sizes")
        planned = _planned(sized, weights, most, block_words, seed, buckets, driver_sources)[0]
        planned = materialise(planned.select(*[F.col(f"__doc.`{c}`").alias(c) for c in own], *ADDED), "mix-plan")
        held.append(planned)
    return planned


def mix_documents(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (1, 2, 3),
    most: int = 3,
    block_words: int = 32,
    seed: int = 17,
    buckets: int = 65_536,
    driver_sources: int = 100_000,
) -> DataFrame:
    """The mixture itself: a row for every whole repeat of a document and one for the words taken once more, in the columns of ``docs``."""
    others = _packed(docs, [c for c in docs.columns if c != text])
    with scratch(docs.sparkSession) as held:
        sized = _sized(docs, text, source, key, seed, others, F.col(text).alias("__text"))
        planned, bases = _planned(sized, weights, most, block_words, seed, buckets, driver_sources)
        held.append(bases)
    extra = F.col("taken") - F.col("repeats") * F.col("size")
    cut = F.expr(
        "array_join(filter(regexp_extract_all(__text, '[\\\\x20\\\\x09-\\\\x0D]*[^\\\\x20\\\\x09-\\\\x0D]+', 0), "
        f"(x, i) -> ({_chosen_before('(start + i) div block + 1')}) > ({_chosen_before('(start + i) div block')})), '')"
    )
    whole = F.array_repeat(F.col("__text"), F.col("repeats").cast("int"))
    part = F.when(extra == 0, F.array().cast("array<string>")).when(extra == F.col("size"), F.array("__text")).otherwise(F.array(cut))
    out = planned.withColumn("__new", F.explode(F.concat(whole, part)))
    return out.select(*[F.col("__new").alias(text) if c == text else F.col(f"__doc.`{c}`").alias(c) for c in docs.columns])
