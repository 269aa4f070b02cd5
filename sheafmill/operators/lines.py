"""Text lines from page pixels: components over runs of dark pixels, their boxes and ink, and the filter of line-like boxes.

A component is worked out from runs (r, start, end), one for each unbroken stretch of a line of pixels: runs that touch in neighbouring lines are links, and each run
meets those of the next row that it touches. From pages of pixels that happens in a page's own row; tables of runs (img, r, start, end) are a group a page, and their
boxes and runs meet on a grid of tiles.

Edge cases: an image without dark pixels has no components and no boxes; a null value is not dark; equal pixels given twice count once; an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import geometry as G
from . import raster as P

TILE = 64
#: A run's number is its row times this, plus its first column: numbers go by row order.
ROW = 1 << 24


def sizes(px: DataFrame) -> DataFrame:
    if "lines" in px.columns:
        most = lambda f: F.array_max(F.transform("lines", f))
        return px.select("img", (most(lambda x: x["r"]) + 1).alias("h"), most(lambda x: F.size(x["line"])).alias("w"))
    w = F.max(F.size("line")) if "line" in px.columns else F.max("c") + 1
    return px.groupBy("img").agg((F.max("r") + 1).alias("h"), w.alias("w"))


def dark_runs(px: DataFrame, on: Column) -> DataFrame:
    """img, r, start, end (exclusive) of the unbroken stretches where ``on`` holds."""
    return G.mask_runs(px.filter(on).select("img", "r", "c").distinct(), ["img", "r"], "c", F.lit(True)).select("img", "r", "start", "end")


def gaps_of(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """The stretches between the runs, of every row of the pages (img, h, w)."""
    rows = pages.filter("h > 0").select("img", "w", F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))).alias("r"))
    marks = rows.select("img", "r", F.lit(-1).alias("start"), F.lit(0).alias("end")).unionByName(runs.select("img", "r", F.col("start").cast("int"), F.col("end").cast("int")))
    after = marks.withColumn("next", F.lead("start").over(Window.partitionBy("img", "r").orderBy("start"))).join(pages.select("img", "w").hint("merge"), "img")
    return after.select("img", "r", F.col("end").alias("start"), F.coalesce("next", "w").cast("int").alias("end")).filter("end > start")


def runs_of(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end (exclusive) of the unbroken stretches of a page of booleans, in row order."""
    d = np.diff(np.pad(on, ((0, 0), (1, 1))).astype(np.int8))
    (r, start), (_, end) = np.nonzero(d == 1), np.nonzero(d == -1)
    return r, start, end


def first_runs(r: np.ndarray, start: np.ndarray, end: np.ndarray, reach: int) -> np.ndarray:
    """The place of the first run of each run's component, for runs in row order; runs of neighbouring rows within ``reach`` touch."""
    r, start, end = (x.astype(np.int64) for x in (r, start, end))
    low = np.searchsorted((r << 32) + end, ((r + 1) << 32) + start - reach, "right")
    high = np.searchsorted((r << 32) + start, ((r + 1) << 32) + end + reach, "left")
    near = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(r)), near)
    b = np.arange(len(a)) - np.repeat(near.cumsum() - near, near) + np.repeat(low, near)
    root = np.arange(len(r))
    while True:  # the later root of a link goes to the earlier one; a component's least root never does
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((up := root[root]) != root).any():
            root = up


def labelled_runs(runs: DataFrame, corners: bool = True) -> DataFrame:
    """``runs`` with ``root``, the number of their component's first run; with ``corners`` runs that meet at a corner touch. A page's runs are one group."""
    reach = 1 if corners else 0

    def run(key: tuple, table: pa.Table) -> pa.Table:
        r, start, end = (table[c].to_numpy() for c in ("r", "start", "end"))
        order = np.lexsort((start, r))
        r, start, end = r[order], start[order], end[order]
        number = r.astype(np.int64) * ROW + start
        return pa.table({"img": pa.repeat(key[0], len(r)), "r": r, "start": start, "end": end, "root": number[first_runs(r, start, end, reach)]})

    kind = runs.schema["img"].dataType.simpleString()
    return runs.select("img", *[F.col(c).cast("int").alias(c) for c in ("r", "start", "end")]).groupBy("img").applyInArrow(run, f"img {kind}, r int, start int, end int, root long")


def labelled_pixels(px: DataFrame, on: int = 128) -> DataFrame:
    """img, r, c, label: 8-connected pixels of at least ``on`` share the place (in row order) of their first one."""
    runs = labelled_runs(dark_runs(px, F.col("v") >= on)).join(sizes(px).select("img", "w").hint("merge"), "img")
    first = F.floor(F.col("root") / ROW) * F.col("w") + F.col("root") % ROW
    return runs.select("img", "r", F.explode(F.sequence("start", F.col("end") - 1)).alias("c"), first.cast("long").alias("label"))


def component_boxes(runs: DataFrame) -> DataFrame:
    """img, root, x1, y1, x2, y2 and ink (its pixels) of each component of labelled runs."""
    return runs.groupBy("img", "root").agg(
        F.min("start").alias("x1"), F.min("r").alias("y1"), F.max("end").alias("x2"), (F.max("r") + 1).alias("y2"), F.sum(F.col("end") - F.col("start")).alias("ink")
    )


def outermost(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """img, root of the components that lie in no hole of another one: what is above their first pixel belongs to the ground that reaches the page's edge."""
    ground = labelled_runs(gaps_of(runs, pages), corners=False).join(pages.hint("merge"), "img")
    edge = (F.col("r") == 0) | (F.col("r") == F.col("h") - 1) | (F.col("start") == 0) | (F.col("end") == F.col("w"))
    outer = ground.join(ground.filter(edge).select("img", "root").distinct().hint("merge"), ["img", "root"], "left_semi")
    first = runs.select("img", "root").distinct().withColumns({"r": F.floor(F.col("root") / ROW), "c": F.col("root") % ROW})
    tile = F.floor(F.col("c") / TILE)
    over = outer.select("img", (F.col("r") + 1).alias("r"), "start", "end", F.explode(F.sequence(F.floor(F.col("start") / TILE), F.floor((F.col("end") - 1) / TILE))).alias("tile"))
    found = first.withColumn("tile", tile).join(over.hint("merge"), ["img", "r", "tile"]).filter((F.col("c") >= F.col("start")) & (F.col("c") < F.col("end")))
    return found.select("img", "root").unionByName(first.filter("r = 0").select("img", "root"))


def ink_in(boxes: DataFrame, runs: DataFrame) -> DataFrame:
    """``boxes`` (img, ix, x1 .. y2) with the dark pixels inside each, whatever component they are of."""
    rows = lambda a, b: F.explode(F.sequence(F.floor(a / TILE), F.floor(b / TILE))).alias("tile")
    spread = boxes.select("img", "ix", *G.BOX, rows(F.col("y1"), F.col("y2") - 1))
    marked = runs.select("img", "r", "start", "end", F.floor(F.col("r") / TILE).alias("tile"))
    own = (F.col("r") >= F.col("y1")) & (F.col("r") < F.col("y2")) & (F.col("start") < F.col("x2")) & (F.col("end") > F.col("x1"))
    clipped = F.least("end", "x2") - F.greatest("start", "x1")
    counts = spread.join(marked.hint("merge"), ["img", "tile"]).filter(own).groupBy("img", "ix").agg(F.sum(clipped).alias("ink"))
    return boxes.join(counts.hint("merge"), ["img", "ix"], "left").withColumn("ink", F.coalesce("ink", F.lit(0)))


def line_like(boxes: DataFrame) -> DataFrame:
    """Boxes (with the page's h and w, and their ink) of the size and the density of a line of text."""
    w, h, density = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ink") / F.greatest(F.lit(1), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
    wide = w >= F.greatest(F.lit(24), (F.col("w") * 0.018).cast("int"))
    high = h.between(5, F.greatest(F.lit(120), (F.col("h") * 0.12).cast("int")))
    return boxes.filter(wide & high & (w * h <= F.col("w") * F.col("h") * 0.22) & density.between(0.035, 0.72))


def outer_boxes(on: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, ...]:
    """x1, y1, x2, y2 and ink of the components of a page's ``joined`` pixels that lie in no hole of another one, in row order of their first pixels; the ink is
    that of ``on`` in the box. As ``component_boxes``, ``outermost`` and ``ink_in`` of the page's runs."""
    (h, w), (r, start, end) = on.shape, runs_of(joined)
    first, place = np.unique(first_runs(r, start, end, 1), return_inverse=True)
    gr, gs, ge = runs_of(~joined)
    ground = first_runs(gr, gs, ge, 0)
    free = np.zeros(len(gr), bool)
    free[ground[(gr == 0) | (gr == h - 1) | (gs == 0) | (ge == w)]] = True
    above, c = r[first] - 1, start[first]
    at = np.searchsorted((gr << 32) + gs, (above << 32) + c, "right") - 1  # the gap that begins last before what is above the first pixel
    outer = above < 0
    some = np.nonzero(~outer & (at >= 0))[0]
    k = at[some]
    outer[some] = (gr[k] == above[some]) & (c[some] < ge[k]) & free[ground[k]]

    def least(values: np.ndarray) -> np.ndarray:
        out = np.full(len(first), 1 << 40)
        np.minimum.at(out, place, values)
        return out[outer]

    x1, y1, x2, y2 = least(start), least(r), -least(-end), -least(-r) + 1
    sums = np.pad(on.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return x1, y1, x2, y2, sums[y2, x2] - sums[y1, x2] - sums[y2, x1] + sums[y1, x1]


def _masks(v: np.ndarray, width: int, height: int, window: int, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """A page's ink, and the ink joined along the lines by a wide dilation."""
    on = P.ink_mask(v, window, offset)
    return on, P.dilated_mask(on, max(16, width // 90), max(1, height // 700))


def page_boxes(px: DataFrame | P.Drawn, width: int, height: int, window: int = 51, offset: int = 11) -> DataFrame:
    """img, ix, x1 .. y2, ink and the page's h and w, of the outermost components of gray pages' joined ink."""

    def work(v: np.ndarray) -> dict:
        x1, y1, x2, y2, ink = outer_boxes(*_masks(v, width, height, window, offset))
        own = {"ix": np.arange(len(x1)), "x1": x1, "y1": y1, "x2": x2, "y2": y2, "h": np.full(len(x1), v.shape[0]), "w": np.full(len(x1), v.shape[1])}
        return {k: x.astype(np.int32) for k, x in own.items()} | {"ink": ink.astype(np.int64)}

    return P.per_page(px, work, "ix int, x1 int, y1 int, x2 int, y2 int, ink long, h int, w int")


def page_runs(px: DataFrame | P.Drawn, width: int, height: int, window: int = 51, offset: int = 11) -> DataFrame:
    """img, kind, ix, r, start, end, low, ink of gray pages: the runs of their ink ("ink"), the boxes of ``page_boxes`` from r to low ("box"), and a row "page" with
    the height as r and the width as end."""

    def work(v: np.ndarray) -> dict:
        on, joined = _masks(v, width, height, window, offset)
        (r, start, end), (x1, y1, x2, y2, ink) = runs_of(on), outer_boxes(on, joined)
        kinds, none = np.repeat(["ink", "box", "page"], [len(r), len(x1), 1]), np.zeros(len(r), int)
        parts = {"ix": (none, np.arange(len(x1)), [0]), "r": (r, y1, [v.shape[0]]), "start": (start, x1, [0]), "end": (end, x2, [v.shape[1]]), "low": (none, y2, [0])}
        return {"kind": kinds} | {k: np.concatenate(x).astype(np.int32) for k, x in parts.items()} | {"ink": np.concatenate([none, ink, [0]]).astype(np.int64)}

    return P.per_page(px, work, "kind string, ix int, r int, start int, end int, low int, ink long")


def _numbered(boxes: DataFrame) -> DataFrame:
    """page, ix, x1 .. y2, ink: the line-like ones of such boxes, numbered on their page."""
    place = F.row_number().over(Window.partitionBy("img").orderBy("ix"))
    return line_like(boxes).select(F.col("img").alias("page"), place.alias("ix"), *G.BOX, "ink")


def boxes_of(found: DataFrame) -> DataFrame:
    """page, ix, x1 .. y2, ink: the line-like boxes of such runs, in row order of their components' first pixels."""
    pages = found.filter("kind = 'page'").select("img", F.col("r").alias("h"), F.col("end").alias("w"))
    boxes = found.filter("kind = 'box'").select("img", "ix", F.col("start").alias("x1"), F.col("r").alias("y1"), F.col("end").alias("x2"), F.col("low").alias("y2"), "ink")
    return _numbered(boxes.join(pages.hint("merge"), "img"))


def text_line_boxes(px: DataFrame | P.Drawn, width: int, height: int, window: int = 51, offset: int = 11) -> DataFrame:
    """The line-like boxes of gray pages of one size, from the ink that is darker than its surroundings."""
    return _numbered(page_boxes(px, width, height, window, offset))
