"""Revisions of stored tables, applied in order and taken back in order.

The store's state is a numbered ledger: an entry names the revision that the tables are at and the folder of each table. A step up or down writes the tables that it
changes into new folders and then puts the next entry in place by one rename, so readers see the old tables or the new ones; a step that fails leaves no entry,
and two that run at once cannot both enter. Tables that a step leaves alone keep their folders. Old folders stay until ``vacuum``, so a reader can finish.

Edge cases: a store without a ledger is at no revision and has no tables; a table without rows keeps its schema; null ids stay null, repeated rows are carried on as they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import TABLES, canonical_uuid
from .unit import _files

#: What a step is given and what it gives: the tables by name.
Tables = dict[str, DataFrame]


class Revision(NamedTuple):
    name: str
    up: Callable[[SparkSession, Tables], Tables]
    down: Callable[[SparkSession, Tables], Tables]


def ledger(spark: SparkSession, root: str) -> list[dict]:
    """The entries so far, first to last."""
    p, files = _files(spark, f"{root}/_ledger")
    names = sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []
    rows = spark.read.text([f"{root}/_ledger/{n}" for n in names], wholetext=True).collect() if names else []
    return sorted((json.loads(r["value"]) for r in rows), key=lambda e: e["number"])


def current(spark: SparkSession, root: str) -> dict:
    entries = ledger(spark, root)
    return entries[-1] if entries else {"number": 0, "revision": None, "tables": {}}


def tables(spark: SparkSession, root: str) -> Tables:
    return {name: spark.read.parquet(f"{root}/{folder}") for name, folder in current(spark, root)["tables"].items()}


def _enter(spark: SparkSession, root: str, entry: dict) -> None:
    draft, files = _files(spark, f"{root}/_drafts/{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    final, _ = _files(spark, f"{root}/_ledger/{entry['number']:08d}.json")
    files.mkdirs(final.getParent())
    if files.exists(final) or not files.rename(draft, final):
        files.delete(draft, False)
        raise RuntimeError(f"another step has entered number {entry['number']}")


def _step(spark: SparkSession, root: str, change: Callable[[SparkSession, Tables], Tables], revision: str | None) -> None:
    now, had = current(spark, root), tables(spark, root)
    made = change(spark, dict(had))
    folders, attempt = {}, uuid.uuid4().hex
    for name, rows in made.items():
        if rows is had.get(name):
            folders[name] = now["tables"][name]
        else:
            folders[name] = f"{name}/{attempt}"
            rows.write.parquet(f"{root}/{folders[name]}")
    _enter(spark, root, {"number": now["number"] + 1, "revision": revision, "tables": folders})


def migrate(spark: SparkSession, root: str, revisions: list[Revision], to: str | None) -> list[str]:
    """Go to revision ``to`` (None: before the first), one entry a step; the names of the steps."""
    names: list[str | None] = [None, *[r.name for r in revisions]]
    at, want, done = names.index(current(spark, root)["revision"]), names.index(to), []
    while at != want:
        if at < want:
            _step(spark, root, revisions[at].up, names[at + 1])
            at += 1
            done.append(f"up {names[at]}")
        else:
            _step(spark, root, revisions[at - 1].down, names[at - 1])
            done.append(f"down {names[at]}")
            at -= 1
    return done


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove folders of tables that the last entry does not name; the number removed."""
    kept, removed = {f.split("/")[-1] for f in current(spark, root)["tables"].values()}, 0
    for name in {n for e in ledger(spark, root) for n in e["tables"]}:
        p, files = _files(spark, f"{root}/{name}")
        for s in files.listStatus(p) if files.exists(p) else ():
            removed += s.getPath().getName() not in kept and files.delete(s.getPath(), True)
    return removed


def _strict_uuid(text: Column) -> Column:
    """A UUID in its canonical form; anything else stops the step."""
    wrong = F.raise_error(F.concat(F.lit("no UUID: "), text)).cast("string")
    return F.when(text.isNull(), text).otherwise(F.coalesce(canonical_uuid(text), wrong))


IDS = {"documents": ["id"], "ocr_results": ["id", "document_id"], "translations": ["id", "document_id"]}


def _as_uuid(spark: SparkSession, had: Tables) -> Tables:
    return had | {t: had[t].withColumns({c: _strict_uuid(F.col(c)) for c in columns}) for t, columns in IDS.items()}


def _created(spark: SparkSession, had: Tables) -> Tables:
    return had | {t: spark.createDataFrame([], TABLES[t]) for t in IDS}


#: The store's own revisions: nothing yet, the three tables, ids as UUIDs. Text keeps the canonical form when the last is taken back.
REVISIONS = [
    Revision("empty", lambda spark, had: had, lambda spark, had: had),
    Revision("tables", _created, lambda spark, had: {t: rows for t, rows in had.items() if t not in IDS}),
    Revision("uuid ids", _as_uuid, lambda spark, had: had),
]
