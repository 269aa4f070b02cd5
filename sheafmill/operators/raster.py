"""Rasters as pixel relations (img, r, c, v): profiles, smoothing, thresholds, morphology, masks and labels.

Windows run within an image's rows or columns, so the work is spread by image and line. A blur or local mean at an edge reads pixels reflected
about the outermost one (2 1 | 0 1 2), or the outermost one again where ``border`` is "repeat"; least and largest values ignore what lies outside.

Edge cases: a null value counts as 0 in a sum of neighbours and passes through a least or largest value; an image without pixels has no rows; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pixels(images: DataFrame, key: str, values: str, side: int = 8) -> DataFrame:
    """A vector of side * side numbers as a raster of 0 to 255, by its own least and largest."""
    v = images.select(F.col(key).alias("img"), F.posexplode(F.col(values)).alias("i", "e"), F.array_min(values).cast("double").alias("lo"), F.array_max(values).cast("double").alias("hi"))
    span = F.coalesce(F.try_divide(F.col("e").cast("double") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    return v.select("img", F.floor(F.col("i") / side).cast("int").alias("r"), (F.col("i") % side).alias("c"), F.floor(span * 255).cast("int").alias("v"))


def dark(values: str, least: int = 128) -> Column:
    """Which numbers of a vector are at least ``least``, as ``pixels`` scales them."""
    ends = F.array(F.struct(F.array_min(values).cast("double").alias("lo"), F.array_max(values).cast("double").alias("hi")))  # bound once a vector
    span = lambda e, b: F.coalesce(F.try_divide(e.cast("double") - b["lo"], b["hi"] - b["lo"]), F.lit(0.0))
    return F.get(F.transform(ends, lambda b: F.transform(values, lambda e: F.floor(span(e, b) * 255) >= least)), F.lit(0))


#: A page as a row: its lines of pixels, in any order.
PAGE = "lines array<struct<r:int,line:array<int>>>"
#: Bytes of results that are handed on at a time.
CHUNK = 1 << 23
#: Pixels of pages of one size that are worked on at a time.
STACK = 1 << 16


@dataclass(frozen=True)
class Drawn:
    """Pages that are drawn where they are used: ``draw`` makes batches of img and lines of ``rows`` (img and what it is drawn from), in the same pass of Python as
    the work on them, so that no pixel goes through Spark's rows before it."""

    rows: DataFrame
    draw: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

    columns = ("img", "lines")

    def stored(self, schema: str = PAGE) -> DataFrame:
        """The pages as rows."""
        return self.rows.mapInArrow(self.draw, f"img {self.rows.schema['img'].dataType.simpleString()}, {schema}")


def lines(px: DataFrame) -> DataFrame:
    """img, r, line: rasters as a row of values for each line of pixels; such rows stay as they are."""
    if "lines" in px.columns:
        return px.select("img", F.inline("lines"))
    if "line" in px.columns:
        return px
    held = F.array_sort(F.collect_set(F.struct("c", F.col("v").cast("int").alias("v"))))
    return px.groupBy("img", "r").agg(F.transform(held, lambda p: p["v"]).alias("line"))


def whole(px: DataFrame) -> DataFrame:
    """img, lines: rasters as a row a page; such rows stay as they are, with their other columns."""
    if "lines" in px.columns:
        return px
    return lines(px).groupBy("img").agg(F.collect_list(F.struct(F.col("r").cast("int").alias("r"), "line")).alias("lines"))


def points(px: DataFrame) -> DataFrame:
    """img, r, c, v of such rows."""
    return lines(px).select("img", "r", F.posexplode("line").alias("c", "v")) if "v" not in px.columns else px


def like(px: DataFrame | Drawn, found: DataFrame) -> DataFrame:
    """Rows of pages in the form that ``px`` has."""
    return found if "lines" in px.columns else lines(found) if "line" in px.columns else points(found)


def _page(r: np.ndarray, wide: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A page's pixels from its lines' places and lengths, and their values one after another."""
    if not len(r):
        return np.zeros((0, 0))
    v = np.full((int(r.max()) + 1, int(wide.max())), np.nan)
    if (wide == v.shape[1]).all():
        v[r] = values.reshape(len(r), v.shape[1])
    else:
        v[np.repeat(r, wide), np.concatenate([np.arange(n) for n in wide])] = values
    return v


def stacks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """The place of the first page and the pixels (n x h x w) of pages of one size, ``STACK`` pixels at a time; where sizes differ, or a line or a value is
    missing, a page at a time (NaN for null)."""
    held = batch.column("lines")
    r, line = held.flatten().flatten()
    high, wide, flat = (x.to_numpy(zero_copy_only=False) for x in (held.value_lengths().fill_null(0), line.value_lengths().fill_null(0), line.flatten()))
    r, h, w = r.to_numpy(), int(high[0]) if len(high) else 0, int(wide[0]) if len(wide) else 0
    if h and w and flat.dtype.kind == "i" and (high == h).all() and (wide == w).all() and (r.reshape(-1, h) == np.arange(h)).all():
        v, some = flat.reshape(-1, h, w), max(1, STACK // (h * w))
        for at in range(0, len(v), some):
            yield at, v[at : at + some]
        return
    rows, place = (np.concatenate([[0], np.cumsum(x)]).astype(int) for x in (high, wide))
    for i, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)):
        yield i, _page(r[a:b], wide[a:b], flat[place[a] : place[b]])[None]


def per_stack(px: DataFrame | Drawn, work: Callable[..., Iterable[tuple[np.ndarray | list[int], dict]]], schema: str, *more: str) -> DataFrame:
    """img and ``schema``: what ``work`` makes of the pixels of pages of one size (n x h x w) and lists of their values of ``more``: the places of pages in the
    stack, one a value, and the values, as arrays that have a type.

    A page is a row, and rows go to Python in Arrow's batches, which are bounded in bytes: no line of pixels is sorted or spilled, and no page costs a call of Spark's.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def handed(img: pa.Array, pages: list[np.ndarray], found: list[list[pa.Array]]) -> pa.RecordBatch:
        columns = [pa.concat_arrays(parts) for parts in zip(*found, strict=True)]
        return pa.RecordBatch.from_arrays([img.take(pa.array(np.concatenate(pages), pa.int64())), *columns], names=["img", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            img = batch.column("img")
            pages, found, size = [], [], 0
            for at, v in stacks(batch):
                for own, made in work(v, *[batch.column(c).slice(at, len(v)).to_pylist() for c in more]):
                    found.append([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n]) for n in names])
                    pages.append(np.asarray(own, np.int64) + at)
                    size += sum(part.nbytes for part in found[-1])
                    if size > CHUNK:
                        yield handed(img, pages, found)
                        pages, found, size = [], [], 0
            if pages:
                yield handed(img, pages, found)

    draw = px.draw if isinstance(px, Drawn) else iter
    rows, start = px.rows if isinstance(px, Drawn) else whole(px).select("img", "lines", *more), lambda batches: run(draw(batches))
    return rows.mapInArrow(start, f"img {rows.schema['img'].dataType.simpleString()}, {schema}")


def per_page(px: DataFrame | Drawn, work: Callable[..., dict], schema: str, *more: str) -> DataFrame:
    """img and ``schema``: what ``work`` makes of a page's pixels (h x w numbers, NaN for null) and its values of ``more``, as arrays that have a type."""
    first = schema.split()[0]

    def each(v: np.ndarray, *values: list) -> Iterator[tuple[np.ndarray, dict]]:
        for i, own in enumerate(v.astype(float)):
            made = work(own, *[x[i] for x in values])
            yield np.full(len(made[first]), i), made

    return per_stack(px, each, schema, *more)


def as_page(v: np.ndarray) -> dict:
    """A page's pixels as the one value of the column ``lines``; NaN becomes null."""
    h, w = v.shape
    gone = np.isnan(v)
    flat = pa.array(np.where(gone, 0, v).astype(np.int32).ravel(), mask=gone.ravel())
    held = pa.ListArray.from_arrays(pa.array(np.arange(h + 1, dtype=np.int32) * w), flat)
    rows = pa.StructArray.from_arrays([pa.array(np.arange(h, dtype=np.int32)), held], names=["r", "line"])
    return {"lines": pa.ListArray.from_arrays(pa.array([0, h], pa.int32()), rows)}


def profile(px: DataFrame, axis: str, on: Column) -> DataFrame:
    return px.groupBy("img", axis).agg(F.count_if(on).alias("ink"))


def _frame(line: str, along: str, lo: int, hi: int):
    return Window.partitionBy("img", line).orderBy(along).rowsBetween(lo, hi)


def _source(p: Column, n: Column) -> Column:
    """The position that an outer position ``p`` of a line of ``n`` pixels reads by reflection."""
    m = F.pmod(p, F.greatest(F.lit(1), 2 * n - 2))
    return F.when(m < n, m).otherwise(2 * n - 2 - m)


def padded(px: DataFrame, line: str, along: str, k: int, border: str = "reflect") -> DataFrame:
    """``px`` and the k outer pixels at both ends of each line, copies of those that they read."""
    n = F.max(along).over(Window.partitionBy("img", line)) + 1
    place, last, none = F.col(along).cast("int"), F.col("_n") - 1, F.array().cast("array<int>")
    if border == "repeat":
        copies = F.concat(F.when(place == 0, F.sequence(F.lit(-k), F.lit(-1))).otherwise(none), F.when(place == last, F.sequence(F.col("_n"), last + k)).otherwise(none))
    else:
        once = F.array_compact(F.array(F.when(place.between(1, k), -place), F.when(place.between(last - k, last - 1), 2 * last - place)))
        outer = F.concat(F.sequence(F.lit(-k), F.lit(-1)), F.sequence(F.col("_n"), last + k))
        copies = F.when(F.col("_n") > k, once).otherwise(F.filter(outer, lambda p: _source(p, F.col("_n")) == place))  # a line shorter than k is reflected again and again
    near = (place <= k) | (place >= last - k)
    at = F.explode(F.concat(F.array(place), F.when(near, copies).otherwise(none)))
    own = [c for c in px.columns if c != along]
    return px.withColumn("_n", n.cast("int")).select(*own, "_n", at.alias(along))


def smoothed(px: DataFrame, values: dict[str, str], weights: list[float], border: str = "reflect") -> DataFrame:
    """img, r, c, v and ``values`` (column: what it smooths): weighted sums over the neighbours within len(weights) // 2 rows and columns.

    Equal weights take differences of running sums; they are applied at the end, so sums of whole numbers stay exact.
    """
    k, held = len(weights) // 2, px.select("img", "r", "c", "v", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(name) for name, v in values.items()])
    if not k:
        return held
    even = len(set(weights)) == 1
    for line, along in (("r", "c"), ("c", "r")):
        wide, order = padded(held, line, along, k, border), Window.partitionBy("img", line).orderBy(along)
        if even:
            wide = wide.withColumns({name: F.sum(name).over(order.rowsBetween(Window.unboundedPreceding, 0)) for name in values})
            sums = {name: F.lead(name, k).over(order) - F.coalesce(F.lag(name, k + 1).over(order), F.lit(0.0)) for name in values}
        else:
            sums = {name: reduce(add, [F.lag(name, k - i).over(order) * float(x) for i, x in enumerate(weights)]) for name in values}
        held = wide.withColumns(sums).filter((F.col(along) >= 0) & (F.col(along) < F.col("_n"))).drop("_n")
    return held.withColumns({name: F.col(name) * (weights[0] * weights[0]) for name in values}) if even else held


def box(k: int) -> list[float]:
    return [1.0 / (2 * k + 1)] * (2 * k + 1)


def gaussian(size: int, sigma: float) -> list[float]:
    raw = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(raw) for x in raw]


def sauvola(px: DataFrame, k: int = 12, weight: float = 0.2, spread: float = 128.0) -> DataFrame:
    """255 where a pixel is over mean * (1 + weight * (std / spread - 1)) of the square around it, else 0."""
    d = smoothed(px.withColumn("q", F.col("v") * F.col("v")), {"mean": "v", "square": "q"}, box(k))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean")))
    return d.select("img", "r", "c", F.when(F.col("v") > F.col("mean") * (1 + weight * (std / spread - 1)), 255).otherwise(0).alias("v"))


def adaptive_ink(px: DataFrame, window: int = 51, offset: int = 11) -> DataFrame:
    """255 where a lightly blurred pixel is at least ``offset`` below the Gaussian mean around it, else 0."""
    soft = smoothed(px, {"soft": "v"}, [0.25, 0.5, 0.25]).select("img", "r", "c", F.round("soft").cast("int").alias("v"))
    sigma = 0.3 * ((window - 1) * 0.5 - 1) + 0.8
    d = smoothed(soft, {"mean": "v"}, gaussian(window, sigma), "repeat")
    return d.select("img", "r", "c", F.when(F.col("v") - F.round("mean") <= -offset, 255).otherwise(0).alias("v"))


def ink_mask(v: np.ndarray, window: int = 51, offset: int = 11) -> np.ndarray:
    """Where ``adaptive_ink`` is 255 on a page of pixels; the taps are added in the same order."""
    half_up = lambda x: np.floor(x + 0.5)

    def blurred(a: np.ndarray, weights: list[float], mode: str) -> np.ndarray:
        k = len(weights) // 2
        for _ in range(2):  # along the lines, then along the columns
            wide, n = np.pad(a, ((0, 0), (k, k)), mode=mode if a.shape[1] > 1 else "edge"), a.shape[1]
            total = wide[:, :n] * weights[0]
            part = np.empty_like(total)
            for i, x in enumerate(weights[1:], 1):
                total += np.multiply(wide[:, i : i + n], x, out=part)
            a = total.T
        return a

    soft = half_up(blurred(np.nan_to_num(v), [0.25, 0.5, 0.25], "reflect"))
    return soft - half_up(blurred(soft, gaussian(window, 0.3 * ((window - 1) * 0.5 - 1) + 0.8), "edge")) <= -offset


def dilated_mask(on: np.ndarray, wide: int, high: int) -> np.ndarray:
    """``dilated`` on a page of booleans."""
    for size in (wide, high):
        lo, hi = _reach(max(1, size), 1)
        n = on.shape[1]
        padded = np.pad(on, ((0, 0), (-lo, hi)))
        on = reduce(np.logical_or, (padded[:, i : i + n] for i in range(hi - lo + 1))).T
    return on


def equalized(px: DataFrame, across: int = 8, down: int = 8, clip: float = 3.0) -> DataFrame:
    """Histogram equalization by tiles with a limit on a bin, between the tiles' tables in proportion, then stretched to 0..255.

    An image's sides are multiples of the tiles' numbers. What is over the limit is shared out evenly over the 256 bins.
    """
    w = Window.partitionBy("img")
    sized = px.withColumns({"_w": F.floor((F.max("c").over(w) + 1) / across).cast("int"), "_h": F.floor((F.max("r").over(w) + 1) / down).cast("int")})
    tiled = sized.withColumns({"_tx": F.floor(F.col("c") / F.col("_w")).cast("int"), "_ty": F.floor(F.col("r") / F.col("_h")).cast("int")})
    bins = tiled.filter("v is not null").groupBy("img", "_ty", "_tx", "_w", "_h", "v").agg(F.count("*").alias("n"))
    bins = bins.groupBy("img", "_ty", "_tx", "_w", "_h").agg(F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("_n"))
    area = F.col("_w") * F.col("_h")
    limit = F.greatest(F.lit(1), (clip * area / 256).cast("int"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.try_element_at("_n", i), F.lit(0)))
    bins = bins.withColumns({"_raw": raw, "_limit": limit}).withColumn("_over", F.aggregate("_raw", F.lit(0).cast("long"), lambda a, n: a + F.greatest(F.lit(0), n - F.col("_limit"))))
    rest = F.col("_over") % 256
    step = F.greatest(F.lit(1), F.floor(256 / F.greatest(F.lit(1), rest)))
    shared = F.transform(
        "_raw", lambda n, i: F.least(n, F.col("_limit")) + F.floor(F.col("_over") / 256) + F.when((rest > 0) & (i % step == 0) & (F.floor(i / step) < rest), 1).otherwise(0)
    )
    none = F.struct(F.array().cast("array<long>").alias("sums"), F.lit(0).cast("long").alias("s"))
    summed = F.aggregate(shared, none, lambda a, n: F.struct(F.array_append(a["sums"], a["s"] + n).alias("sums"), (a["s"] + n).alias("s")), lambda a: a["sums"])
    tables = bins.select("img", F.col("_ty").alias("_y"), F.col("_tx").alias("_x"), F.transform(summed, lambda s: F.bround(s * 255 / area)).alias("_table"))
    at = lambda p, n: F.col(p) / F.col(n) - 0.5
    place = sized.withColumns({"_fx": at("c", "_w"), "_fy": at("r", "_h")}).withColumns({"_x1": F.floor("_fx").cast("int"), "_y1": F.floor("_fy").cast("int")})
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("_o")
    part = lambda f, one, o: F.when(o == 1, F.col(f) - F.col(one)).otherwise(1 - (F.col(f) - F.col(one)))
    four = place.select("img", "r", "c", "v", "_fx", "_fy", "_x1", "_y1", near)
    four = four.withColumns(
        {
            "_x": F.least(F.lit(across - 1), F.greatest(F.lit(0), F.col("_x1") + F.col("_o.j"))),
            "_y": F.least(F.lit(down - 1), F.greatest(F.lit(0), F.col("_y1") + F.col("_o.i"))),
            "_weight": part("_fx", "_x1", F.col("_o.j")) * part("_fy", "_y1", F.col("_o.i")),
        }
    )
    mixed = four.join(tables, ["img", "_y", "_x"], "left").groupBy("img", "r", "c").agg(F.bround(F.sum(F.get("_table", F.col("v")) * F.col("_weight"))).alias("v"))
    low, high = F.min("v").over(w), F.max("v").over(w)
    return mixed.withColumn("v", F.when(high > low, F.bround((F.col("v") - low) * 255 / (high - low))).otherwise(F.col("v") * 0).cast("int"))


def grayscale(bgr: DataFrame) -> DataFrame:
    """Pixels with b, g and r channels (``red`` to tell it from the row) as one value."""
    v = F.round(0.114 * F.col("b") + 0.587 * F.col("g") + 0.299 * F.col("red")).cast("int")
    return bgr.select("img", "r", "c", v.alias("v"))


def without_blue(bgr: DataFrame) -> DataFrame:
    """Pixels of a hue of 100 to 140 (of 180) with saturation and value of 50 or more, and their neighbours, turn white."""
    b, g, red = (F.col(x).cast("double") for x in ("b", "g", "red"))
    top, low = F.greatest(b, g, red), F.least(b, g, red)
    span = top - low
    hue = F.when(span == 0, 0.0).when(top == red, 60 * (g - b) / span).when(top == g, 120 + 60 * (b - red) / span).otherwise(240 + 60 * (red - g) / span)
    half = F.round(F.when(hue < 0, hue + 360).otherwise(hue) / 2)
    saturation = F.when(top == 0, 0.0).otherwise(F.round(255 * span / top))
    blue = half.between(100, 140) & (saturation >= 50) & (top >= 50)
    marked = dilate(bgr.select("img", "r", "c", blue.cast("int").alias("v"), "b", "g", "red"), -1, 1, keep=("b", "g", "red"))
    white = lambda c: F.when(F.col("v") > 0, 255).otherwise(F.col(c)).cast("int").alias(c)
    return marked.select("img", "r", "c", white("b"), white("g"), white("red"))


def _reach(k: int, times: int) -> tuple[int, int]:
    """Offsets that a kernel of k pixels covers when it is used several times (its anchor is pixel k // 2)."""
    return -(k // 2) * times, (k - 1 - k // 2) * times


def dilated(px: DataFrame, wide: int, high: int, times: int = 1) -> DataFrame:
    """Greatest value over ``wide`` columns and ``high`` rows; the kernel's pixel ``size // 2`` is the one that is set, as in an erosion."""
    (cl, ch), (rl, rh) = _reach(max(1, wide), times), _reach(max(1, high), times)
    return px.withColumn("v", F.max("v").over(_frame("r", "c", cl, ch))).withColumn("v", F.max("v").over(_frame("c", "r", rl, rh)))


def eroded(px: DataFrame, wide: int, high: int, times: int = 1) -> DataFrame:
    (cl, ch), (rl, rh) = _reach(max(1, wide), times), _reach(max(1, high), times)
    return px.withColumn("v", F.min("v").over(_frame("r", "c", cl, ch))).withColumn("v", F.min("v").over(_frame("c", "r", rl, rh)))


def opened(px: DataFrame, wide: int, high: int, times: int = 1) -> DataFrame:
    """Erosion, then dilation, by ``wide`` columns and ``high`` rows."""
    return dilated(eroded(px, wide, high, times), wide, high, times)


def _inverted(px: DataFrame) -> DataFrame:
    return px.select("img", "r", "c", (255 - F.col("v")).alias("v"), F.col("v").alias("_own"))


def _whitened(marked: DataFrame) -> DataFrame:
    return marked.select("img", "r", "c", F.when(F.col("v") > 0, 255).otherwise(F.col("_own")).alias("v"))


def without_lines(px: DataFrame, wide: int, high: int) -> DataFrame:
    """Dark runs that two openings by ``wide`` columns or ``high`` rows leave, and their neighbours, turn white (a page takes a 15th of its sides)."""
    inverted = _inverted(px)
    across = opened(inverted, wide, 1, 2).withColumnRenamed("v", "_h")
    down = opened(across.withColumn("v", 255 - F.col("_own")), 1, high, 2)
    both = down.withColumn("v", F.least(F.lit(255), F.col("_h") + F.col("v"))).drop("_h")
    return _whitened(dilate(both, -1, 1, keep=("_own",)))


def without_vertical_noise(px: DataFrame, high: int = 50) -> DataFrame:
    """Dark runs of ``high`` rows and more turn white."""
    return _whitened(opened(_inverted(px), 1, high, 2))


def without_sidebar_noise(px: DataFrame, share: float = 0.01, high: int = 80) -> DataFrame:
    """In the last ``share`` of the columns, dark runs of ``high`` rows and more turn white."""
    w = (F.max("c").over(Window.partitionBy("img")) + 1).cast("int")
    marked = px.withColumn("_side", F.col("c") >= w - (w * share).cast("int"))
    side = _whitened(opened(_inverted(marked.filter("_side")), 1, high, 3))
    return side.unionByName(marked.filter("not _side").select("img", "r", "c", "v"))


def thinned(px: DataFrame) -> DataFrame:
    """Dark strokes eroded by 2 x 2 pixels."""
    return erode(_inverted(px).drop("_own")).select("img", "r", "c", (255 - F.col("v")).alias("v"))


def erode(px: DataFrame, lo: int = -1, hi: int = 0) -> DataFrame:
    """Least value over offsets lo to hi in both directions (2 x 2 with the anchor at its lower right by default)."""
    rows = px.withColumn("_m", F.min("v").over(_frame("r", "c", lo, hi)))
    return rows.select("img", "r", "c", F.min("_m").over(_frame("c", "r", lo, hi)).alias("v"))


def dilate(px: DataFrame, lo: int = -1, hi: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Greatest value over the same offsets."""
    rows = px.withColumn("_m", F.max("v").over(_frame("r", "c", lo, hi)))
    return rows.select("img", "r", "c", F.max("_m").over(_frame("c", "r", lo, hi)).alias("v"), *keep)


def open_close(px: DataFrame) -> DataFrame:
    return erode(dilate(dilate(erode(px))))


def sharpen(px: DataFrame, amount: float = 1.5, rest: float = -0.5, sigma: float = 3.0) -> DataFrame:
    """Unsharp mask: a Gaussian blur of ``sigma`` (kernel of 6 sigma, odd) taken off, clipped to 0..255."""
    size = round(6 * sigma + 1) | 1
    d = smoothed(px, {"blur": "v"}, gaussian(size, sigma))
    return d.select("img", "r", "c", F.least(F.lit(255), F.greatest(F.lit(0), F.round(amount * F.col("v") + rest * F.col("blur")))).cast("int").alias("v"))


#: Cubic weights (a = -0.75) of the pixels two before to two after, for the first and the second half of a pixel.
CUBIC = ((-0.03515625, 0.26171875, 0.87890625, -0.10546875, 0.0), (0.0, -0.10546875, 0.87890625, 0.26171875, -0.03515625))


def doubled(px: DataFrame) -> DataFrame:
    """Twice as many rows and columns by cubic interpolation, clipped to 0..255; the outermost pixel goes on beyond an edge."""
    held = px.select("img", "r", "c", F.col("v").cast("double").alias("v"))
    for line, along in (("r", "c"), ("c", "r")):
        near = F.collect_list("v").over(_frame(line, along, -2, 2))
        taps = padded(held, line, along, 2, "repeat").withColumn("_t", near).filter((F.col(along) >= 0) & (F.col(along) < F.col("_n")))
        half = lambda w: F.aggregate(F.zip_with("_t", F.array(*map(F.lit, w)), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
        both = taps.select("img", line, F.col(along).alias("_at"), F.posexplode(F.array(*[half(w) for w in CUBIC])).alias("_half", "v"))
        held = both.select("img", line, (2 * F.col("_at") + F.col("_half")).alias(along), "v")
    return held.select("img", "r", "c", F.least(F.lit(255), F.greatest(F.lit(0), F.round("v"))).cast("int").alias("v"))


def shrunk(px: DataFrame | Drawn, most: int = 2500) -> DataFrame:
    """Images whose longer side is over ``most`` brought down to it; a pixel is the mean of what it covers, parts of pixels by their share.

    A page is a row; each direction adds up the few source places that a target place covers.
    """

    def along(a: np.ndarray, target: int) -> np.ndarray:
        n, at = a.shape[1], np.arange(target)
        step, total, weights = n / target, np.zeros((a.shape[0], target)), np.zeros((a.shape[0], target))
        for k in range(math.ceil(step) + 2):
            place = np.floor(at * step - 1e-9).astype(int) + k
            part = np.minimum(place + 1, (at + 1) * step) - np.maximum(place, at * step)
            part = np.where((part > 1e-9) & (place >= 0) & (place < n), part, 0.0)
            v = a[:, np.clip(place, 0, n - 1)]
            total += np.nan_to_num(v) * part
            weights += ~np.isnan(v) * part
        return np.divide(total, weights, out=np.full_like(total, np.nan), where=weights > 0)

    def work(v: np.ndarray) -> dict:
        h, w = v.shape
        if max(h, w) <= most:
            return as_page(v)
        scale = most / max(h, w)
        mean = along(along(v, max(1, int(w * scale))).T, max(1, int(h * scale))).T
        return as_page(np.clip(np.floor(np.round(mean, 6) + 0.5), 0, 255))

    return like(px, per_page(px, work, PAGE))


def denoised(px: DataFrame, strength: float = 10.0, patch: int = 7, search: int = 21) -> DataFrame:
    """Each pixel as a mean of those up to search // 2 away, weighed by how alike the patches around the two are (exp(-mean square / strength^2)).

    An image is one group: its neighbourhoods overlap everywhere. Beyond the edges it is reflected; a null value counts as 0.
    """
    k, reach = patch // 2, search // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.r.max()) + 1, int(pdf.c.max()) + 1
        image = np.zeros((h, w))
        image[pdf.r, pdf.c] = pdf.v.fillna(0)
        wide = np.pad(image, k + reach, mode="reflect" if min(h, w) > 1 else "edge")
        inner = wide[reach : reach + h + 2 * k, reach : reach + w + 2 * k]
        total, weights = np.zeros((h, w)), np.zeros((h, w))
        for i in range(2 * reach + 1):
            for j in range(2 * reach + 1):
                other = wide[i : i + h + 2 * k, j : j + w + 2 * k]
                sums = np.pad(((inner - other) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
                square = (sums[patch:, patch:] - sums[:-patch, patch:] - sums[patch:, :-patch] + sums[:-patch, :-patch]) / (patch * patch)
                weight = np.exp(-square / (strength * strength))
                total += weight * other[k : k + h, k : k + w]
                weights += weight
        v = np.floor(total / weights + 0.5)
        return pd.DataFrame({"img": pdf.img, "r": pdf.r, "c": pdf.c, "v": v[pdf.r, pdf.c].astype(int)})

    return px.select("img", "r", "c", "v").groupBy("img").applyInPandas(run, "img long, r int, c int, v int")
