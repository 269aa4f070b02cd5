"""Deskewing of gray pages: edges, lines voted from them, the pages' angle, and rotation.

Edges are local peaks of the gradient, kept where strong or reached from a strong one. Each edge pixel votes for the lines (angle, offset) that pass through it; a
line with enough votes that leads its neighbours is cut into segments at gaps, and a page's angle is the median of its long segments' slopes.
A page is a row from its pixels to its segments, its angle or its turned pixels, so the work spreads by page and nothing is exchanged; edges are traced over runs of
pixels, and votes are sums, never rows.

Edge cases: a page without a line, or with a median below the least angle, stays as it is; beyond its sides a page repeats its outermost pixels; a null value counts
as 0; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lines as L
from . import raster as P

#: Fixed value: tangent of 22.5 degrees, between the directions of a gradient.
TAN = 0.4142135623730951
#: Fixed value: the sharpness of the cubic weights.
SHARP = -0.75
#: Fixed value: gradients of whole numbers below it fit in 16 bits.
LARGE = 2048
#: Votes of a page that are worked out at a time.
VOTES = 1 << 18
#: Rows of a page that are turned at a time.
BLOCK = 256


def _around(v: np.ndarray, **how) -> np.ndarray:
    """Pages with one pixel more on each side."""
    return np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1)] * 2, **how)


def gradients(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differences of the neighbours across, weighed 1 2 1 along; edge pixels are repeated outwards."""
    wide = _around(v, mode="edge")
    d, s = wide[..., 2:] - wide[..., :-2], wide[..., :-2] + 2 * wide[..., 1:-1] + wide[..., 2:]
    return d[..., :-2, :] + 2 * d[..., 1:-1, :] + d[..., 2:, :], s[..., 2:, :] - s[..., :-2, :]


def edge_candidates(v: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels over ``low`` whose gradient (|gx| + |gy|) leads its two neighbours in its direction, and the strong ones, over ``high``."""
    gx, gy = gradients(v)
    x, y = np.abs(gx), np.abs(gy)
    m = x + y
    wide, (h, w) = _around(m), m.shape[-2:]
    at = lambda i, j: wide[..., 1 + i : 1 + i + h, 1 + j : 1 + j + w]
    falling = np.sign(gx) * np.sign(gy) >= 0  # the gradient points down to the right or up to the left
    diagonal = np.where(falling, (m > at(-1, -1)) & (m > at(1, 1)), (m > at(-1, 1)) & (m > at(1, -1)))
    flat, upright = (m > at(0, -1)) & (m >= at(0, 1)), (m > at(-1, 0)) & (m >= at(1, 0))
    peak = np.where(y < x * TAN, flat, np.where(x < y * TAN, upright, diagonal))
    found = (m > low) & peak
    return found, found & (m > high)


def _small(v: np.ndarray) -> np.ndarray:
    """Pixels in 16 bits where they are whole numbers whose gradients fit, else as they are; 0 for NaN."""
    v = np.nan_to_num(v)
    if not v.size or not -LARGE < v.min() <= v.max() < LARGE:
        return v.astype(float)
    small = v.astype(np.int16)
    return small if (small == v).all() else v


def stack_edges(v: np.ndarray, low: int = 50, high: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Page, row and column of candidates of pages of one size (n x h x w) that are strong or joined to a strong one by candidates, in row order."""
    if not v.size:
        return np.nonzero(v)
    found, strong = edge_candidates(_small(v), low, high)
    h, w = found.shape[1:]
    place = np.flatnonzero(found)  # in row order
    row, c = np.divmod(place, w)
    first = np.flatnonzero((np.diff(place, prepend=-2) != 1) | (c == 0))  # of a run
    wide, page = np.diff(first, append=len(place)), row // h
    root = L.first_runs(row[first] + page[first], c[first], c[first] + wide, 1)  # a row between two pages keeps them apart
    held = np.zeros(len(root), bool)
    held[np.repeat(root, wide)[strong.ravel()[place]]] = True
    kept = np.repeat(held[root], wide)
    return page[kept], (row - page * h)[kept], c[kept]


def page_edges(v: np.ndarray, low: int = 50, high: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of such candidates of a page."""
    return stack_edges(v[None], low, high)[1:]


def edges(px: DataFrame | P.Drawn, low: int = 50, high: int = 150) -> DataFrame:
    """img, r, c of ``page_edges``."""

    def work(v: np.ndarray) -> list[tuple[np.ndarray, dict]]:
        page, r, c = stack_edges(v, low, high)
        return [(page, {"r": r.astype(np.int32), "c": c.astype(np.int32)})]

    return P.per_stack(px, work, "r int, c int")


def directions(most: int = 30, step: float = 1.0) -> list[tuple[int, float, float]]:
    """Numbers, cosines and sines of the normals of lines within ``most`` degrees of level."""
    n = round(most / step)
    return [(i, math.cos(math.radians(90 + i * step)), math.sin(math.radians(90 + i * step))) for i in range(-n, n + 1)]


def voted_lines(r: np.ndarray, c: np.ndarray, votes: int, turns: list[tuple[int, float, float]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Place of the angle, offset rho, and the pixels with their places t along it, of lines with at least ``votes`` pixels that lead the eight lines next to them;
    of equals, the first by angle and offset. Memory: a page's edge pixels and the sums."""
    cos, sin = (np.array([turn[i] for turn in turns])[:, None] for i in (1, 2))
    rho = lambda k: np.floor(c * cos[k] + r * sin[k] + 0.5).astype(np.int64)
    far = int(r.max() + c.max()) + 2
    wide, some = 2 * far + 1, max(1, VOTES // len(r))  # some angles at a time, so that votes of a large page stay few
    parts = [np.arange(at, min(len(turns), at + some)) for at in range(0, len(turns), some)]
    n = np.concatenate([np.bincount((rho(k) + (far + np.arange(len(k))[:, None] * wide)).ravel(), minlength=len(k) * wide).reshape(len(k), wide) for k in parts])
    wide, leads = np.pad(n, 1), n >= votes
    for i, j in ((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j):
        other = wide[1 + i : 1 + i + n.shape[0], 1 + j : 1 + j + n.shape[1]]
        leads &= ~(other >= n if (i, j) < (0, 0) else other > n)
    for k in np.nonzero(leads.any(axis=1))[0].tolist():
        offsets, t = rho(k), r * turns[k][1] - c * turns[k][2]
        for p in (np.nonzero(leads[k])[0] - far).tolist():
            own = np.nonzero(offsets == p)[0]
            yield k, p, own, t[own]


SEGMENT = {"angle": pa.int32(), "rho": pa.int32(), "piece": pa.int64(), "n": pa.int64(), "length": pa.float64(), "slope": pa.float64()}
COLUMNS = "angle int, rho int, piece long, n long, length double, slope double"


def page_segments(r: np.ndarray, c: np.ndarray, votes: int, gap: int, turns: list[tuple[int, float, float]], least: int = 0) -> list[tuple]:
    """Rows of ``SEGMENT``: the lines voted by a page's edge pixels, cut at gaps, with a length of ``least``; the slope is fitted to the pixels."""
    rows = []
    for k, p, own, t in voted_lines(r, c, votes, turns) if len(r) else ():
        order = np.lexsort((c[own], r[own], t))
        t, x, y = t[order], c[own][order].astype(float), r[own][order].astype(float)
        for piece, part in enumerate(np.split(np.arange(len(t)), np.nonzero(np.diff(t) > gap)[0] + 1), 1):
            if t[part[-1]] - t[part[0]] < least:
                continue
            dx, dy = x[part] - x[part].mean(), y[part] - y[part].mean()
            square = float((dx * dx).sum())
            rows.append((turns[k][0], p, piece, len(part), float(t[part[-1]] - t[part[0]]), float((dx * dy).sum()) / square if square else None))
    return rows


def _table(rows: list[tuple]) -> dict[str, pa.Array]:
    return {name: pa.array([row[i] for row in rows], kind) for i, (name, kind) in enumerate(SEGMENT.items())}


def segments(marks: DataFrame, pages: DataFrame, votes: int = 100, share: int = 4, gap: int = 20, most: int = 30, step: float = 1.0) -> DataFrame:
    """img, angle, rho, piece, n, length, slope of the segments as long as a page's width // ``share``, from tables of edge pixels and of pages' sizes.

    A page's edge pixels are one group, and their votes are sums in it, never rows. ``level_lines`` gives the same from pixels.
    """
    turns = directions(most, step)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        own = _table(page_segments(table["r"].to_numpy().astype(np.int64), table["c"].to_numpy().astype(np.int64), votes, gap, turns))
        return pa.table({"img": pa.repeat(key[0], len(own["n"])), **own})

    kind = marks.schema["img"].dataType.simpleString()
    found = marks.select("img", "r", "c").groupBy("img").applyInArrow(run, f"img {kind}, {COLUMNS}")
    return found.join(pages.select("img", "w").hint("merge"), "img").filter(F.col("length") >= F.floor(F.col("w") / share)).drop("w")


def _long_segments(v: np.ndarray, votes: int, share: int, gap: int, turns: list[tuple[int, float, float]]) -> list[tuple]:
    return page_segments(*page_edges(v), votes, gap, turns, v.shape[1] // share)


def level_lines(px: DataFrame | P.Drawn, votes: int = 100, share: int = 4, gap: int = 20, most: int = 30, step: float = 1.0) -> DataFrame:
    """The ``segments`` of pages' ``edges``, in a page's own row: neither its pixels nor its edges are exchanged."""
    turns = directions(most, step)
    return P.per_page(px, lambda v: _table(_long_segments(v, votes, share, gap, turns)), COLUMNS)


def _degrees(rows: list[tuple], least: float, most: int) -> float | None:
    """The median of such segments' angles under ``most``; None without one, or under ``least``."""
    found = [d for row in rows if row[5] is not None and abs(d := math.degrees(math.atan(row[5]))) < most]
    middle = median(found) if found else 0.0
    return middle if found and abs(middle) >= least else None


def angles(px: DataFrame | P.Drawn, least: float = 0.3, most: int = 30, votes: int = 100, share: int = 4, gap: int = 20, step: float = 1.0) -> DataFrame:
    """img, degrees: the median slope of a page's lines; pages without one, or with one under ``least``, have no row."""
    turns = directions(most, step)

    def work(v: np.ndarray) -> dict:
        found = _degrees(_long_segments(v, votes, share, gap, turns), least, most)
        return {"degrees": pa.array([] if found is None else [found], pa.float64())}

    return P.per_page(px, work, "degrees double")


def cubic_weight(d: np.ndarray) -> np.ndarray:
    """The cubic weight of a pixel ``d`` away."""
    x = np.abs(d)
    inner = (SHARP + 2) * x * x * x - (SHARP + 3) * x * x + 1
    outer = SHARP * x * x * x - 5 * SHARP * x * x + 8 * SHARP * x - 4 * SHARP
    return np.where(x <= 1, inner, np.where(x < 2, outer, 0.0))


def turned(v: np.ndarray, degrees: float | None) -> np.ndarray:
    """A page turned about its centre (w // 2, h // 2), ``BLOCK`` rows at a time.

    A pixel takes the cubic mean of the 4 x 4 pixels around the place that it comes from, which is rounded to 1/32 of a pixel.
    """
    v = np.nan_to_num(v)
    if degrees is None:
        return v
    grid = lambda x: np.floor(x * 32 + 0.5) / 32
    (h, w), out = v.shape, np.empty_like(v)
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    for top in range(0, h, BLOCK):
        dy, dx = np.arange(top, min(h, top + BLOCK))[:, None] - h // 2, np.arange(w)[None, :] - w // 2
        x, y = grid(cos * dx - sin * dy + w // 2), grid(sin * dx + cos * dy + h // 2)
        fx, fy, total = np.floor(x).astype(int), np.floor(y).astype(int), 0.0
        across = [(np.clip(fx + j, 0, w - 1), cubic_weight(x - fx - j)) for j in (-1, 0, 1, 2)]
        for i in (-1, 0, 1, 2):
            row = np.clip(fy + i, 0, h - 1)
            total = total + reduce(add, (v[row, column] * weight for column, weight in across), 0.0) * cubic_weight(y - fy - i)
        out[top : top + BLOCK] = np.clip(np.floor(np.round(total, 6) + 0.5), 0, 255)
    return out


def rotated(px: DataFrame, turns: DataFrame) -> DataFrame:
    """Pages turned by ``degrees`` (img, degrees), counter-clockwise for a positive angle; others stay."""
    met = P.whole(px).join(turns.select("img", "degrees").hint("merge"), "img", "left")
    return P.like(px, P.per_page(met, lambda v, degrees: P.as_page(turned(v, degrees)), P.PAGE, "degrees"))


def deskewed(px: DataFrame | P.Drawn, least: float = 0.3, most: int = 30, votes: int = 100, share: int = 4, gap: int = 20, step: float = 1.0) -> DataFrame:
    """Pages turned by their ``angles``: a page's angle is found and used in its own row."""
    turns = directions(most, step)
    work = lambda v: P.as_page(turned(v, _degrees(_long_segments(v, votes, share, gap, turns), least, most)))
    return P.like(px, P.per_page(px, work, P.PAGE))
