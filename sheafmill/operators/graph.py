"""Connected components of links within keys, by rounds of stars.

Each round is checkpointed in the session's shared folder, so a lost executor re-reads it; the driver sees a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import own_folder


def held(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder: what follows does not work it out again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(own_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def components(links: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node and root (the least node of its component) for every end of a link (keys, a, b); loops and links with a null end are left out.

    A round hands each node's larger neighbours on to the least node that it knows, then its smaller ones, until the links are stars around roots.
    """
    pairs = held(links.select(*keys, F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).filter("x > y").distinct())
    before = None
    while True:
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64(*keys, "x", "y").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return pairs.select(*keys, F.col("x").alias("node"), F.col("y").alias("root")).union(pairs.select(*keys, "y", "y").distinct())
        before = now
        both = pairs.select(*keys, F.col("x").alias("u"), F.col("y").alias("v")).union(pairs.select(*keys, "y", "x"))
        least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, [*keys, "u"]).select(*keys, F.col("v").alias("x"), F.col("m").alias("y")).filter("x > y").distinct()
        large = held(large)
        own = large.groupBy(*keys, "x").agg(F.min("y").alias("m"))
        moved = large.join(own, [*keys, "x"]).select(*keys, F.col("y").alias("x"), F.col("m").alias("y")).filter("x > y")
        pairs = held(moved.union(own.select(*keys, "x", "m")).distinct())
