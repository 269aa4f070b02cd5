"""Shared pieces of the training-data operators: the shared folder, materialised steps and word rules."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, ship

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: White space as the word rule [^\x20\x09-\x0D]+ has it.
BLANKS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local master has one of its own where the session names none."""
    found = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; ``cleanup``, or the end of the application, removes what is written there."""
    app = spark.sparkContext.applicationId
    root = f"{shared_dir(spark)}/sheafmill-{app}"
    if _ROOTS.get(app) != root:
        _ROOTS[app] = root
        path, files = _hadoop(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


_ROOTS: dict[str, str] = {}


class _Scopes(threading.local):
    """The open scratches of a thread, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCOPES = _Scopes()


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of the file system that Spark would use for it."""
    p, files = _hadoop(spark, path)
    return files.makeQualified(p).toString()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p, files = _hadoop(spark, path)
        files.delete(p, True)


def cleanup(spark: SparkSession) -> None:
    """Remove all tables of this application from the shared folder; results that still read them must have been consumed."""
    root = _ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        remove(spark, root)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes the tables written inside when it ends, but for those put in the list that it gives: what the result reads."""
    kept: list[DataFrame] = []
    _SCOPES.open.append([])
    try:
        yield kept
    finally:
        written, stay = _SCOPES.open.pop(), {getattr(d, "_table", None) for d in kept}
        remove(spark, *[w for w in written if w not in stay])
        if _SCOPES.open:
            _SCOPES.open[-1] += [w for w in written if w in stay]


@contextmanager
def _conf(spark: SparkSession, key: str, value: str):
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a table in the shared folder and read it back.

    Cuts the lineage: what follows re-reads the table if an executor goes. The shuffle files that the
    write needed are removed when it ends, so disk holds one copy of the step. The table goes with the ``scratch`` it is written in.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    with _conf(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    if _SCOPES.open:
        _SCOPES.open[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``docs`` has one of them."""
    taken = {c.lower() for c in docs.columns}
    end = next("_" * i for i in range(len(taken) + 1) if not taken & {f"{n}{'_' * i}".lower() for n in names})
    return [n + end for n in names]


def swapped(text: Column, chars: str, by: str) -> Column:
    """Each of ``chars`` replaced; byte searches, many times as fast as translate()."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(by))
    return text


def words_of(text: Column) -> Column:
    """Words by the rule [^\\x20\\x09-\\x0D]+ as an array; null text has none."""
    spaced = swapped(F.coalesce(text, F.lit("")), BLANKS[1:], " ")
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
