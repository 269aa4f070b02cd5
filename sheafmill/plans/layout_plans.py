"""Queries on boxes and rasters. Boxes come from ``lineitem`` (an order is a page), rasters from ``embeddings`` (8 x 8 pixels)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import geometry as G
from ..operators import lines as L
from ..operators import raster as P
from .registry import query, table

W, H = 1000, 1400
BOXES = """b AS (SELECT l_orderkey AS page, l_linenumber AS ix, l_partkey % 900 AS x1, l_suppkey * 7 % 1200 AS y1, l_partkey % 900 + l_quantity::int * 12 + 10 AS x2, l_suppkey * 7 % 1200 + 5 + l_linenumber * 6 AS y2, l_linenumber % 6 AS lines FROM lineitem)"""
PIXELS = """e AS (SELECT vec_id AS img, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS i, list_min(embedding)::double AS lo, list_max(embedding)::double AS hi FROM embeddings),
px AS (SELECT img, (i // 8)::int AS r, (i % 8)::int AS c, floor((e - lo) / (hi - lo) * 255)::int AS v FROM e)"""


def boxes(spark, sf):
    x, y, n = F.col("l_partkey") % 900, F.col("l_suppkey") * 7 % 1200, F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("page"), n.alias("ix"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity").cast("int") * 12 + 10).alias("x2"), (y + 5 + n * 6).alias("y2"), (n % 6).alias("lines")
    )


def pixels(spark, sf):
    return P.pixels(table(spark, sf, "embeddings"), "vec_id", "embedding")


INTER = "greatest(0, least(a.x2, o.x2) - greatest(a.x1, o.x1)) * greatest(0, least(a.y2, o.y2) - greatest(a.y1, o.y1))"


@query(f"WITH {BOXES} SELECT a.page, a.ix AS a_ix, o.ix AS b_ix, {INTER} AS shared, round(({INTER}) / greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1))::double, 6) AS fraction, round(greatest(0, least(a.x2, o.x2) - greatest(a.x1, o.x1)) / least(a.x2 - a.x1, o.x2 - o.x1)::double, 6) AS horizontal FROM b a JOIN b o ON a.page = o.page AND a.ix < o.ix")
def bbox_overlap(spark, sf):
    b = boxes(spark, sf)
    pair = G.named(b, "a_").join(G.named(b, "b_"), "page").filter("a_ix < b_ix")
    least = F.least(F.col("a_x2") - F.col("a_x1"), F.col("b_x2") - F.col("b_x1"))
    shared = G.intersection("a_", "b_")
    return pair.select(
        "page", "a_ix", "b_ix", shared.alias("shared"), F.round(shared / F.greatest(F.lit(1), G.area("a_")), 6).alias("fraction"), F.round(G.overlap_x("a_", "b_") / least, 6).alias("horizontal")
    )


@query(f"WITH {BOXES} SELECT page, ix, x1, y1, x2, y2 FROM b a WHERE ix <= 4 AND NOT EXISTS (SELECT 1 FROM b o WHERE o.page = a.page AND o.ix > 4 AND ({INTER}) / greatest(1, (a.x2 - a.x1) * (a.y2 - a.y1))::double > 0.35) UNION ALL SELECT page, ix, x1, y1, x2, y2 FROM b WHERE ix > 4")
def region_replace_anti_join(spark, sf):
    b = boxes(spark, sf)
    return G.replace_overlapped(b.filter("ix <= 4"), b.filter("ix > 4")).select("page", "ix", *G.BOX)


@query(f"""WITH {BOXES}, s AS (SELECT a.page, a.ix, count(*) FILTER (o.lines > 3 AND greatest(0, least(a.x2, o.x2) - greatest(a.x1, o.x1)) >= 0.20 * least(a.x2 - a.x1, o.x2 - o.x1) AND o.y1 - a.y2 BETWEEN -20 AND 80) AS under,
  coalesce(sum({INTER}) FILTER (o.lines > 1 AND (o.x2 - o.x1) * (o.y2 - o.y1) > (a.x2 - a.x1) * (a.y2 - a.y1)), 0) AS covered FROM b a JOIN b o ON o.page = a.page AND o.ix <> a.ix GROUP BY ALL)
SELECT b.page, b.ix FROM b LEFT JOIN s ON s.page = b.page AND s.ix = b.ix WHERE s.ix IS NULL OR (NOT (lines <= 1 AND ((x2 - x1 >= 600 AND y2 - y1 <= 30) OR (x2 - x1 >= 550 AND under >= 2))) AND (lines > 1 OR covered / greatest(1, (x2 - x1) * (y2 - y1))::double < 0.55))""")
def region_redundancy(spark, sf):
    return G.without_redundant(boxes(spark, sf), W, H).select("page", "ix")


@query(f"""WITH {BOXES}, n AS (SELECT *, count(*) OVER (PARTITION BY page) AS k FROM b WHERE x2 - x1 < 680),
p AS (SELECT a.page, bool_or(abs((a.x1 + a.x2) / 2.0 - (o.x1 + o.x2) / 2.0) >= 180 AND (greatest(0, least(a.y2, o.y2) - greatest(a.y1, o.y1)) / greatest(1, least(a.y2 - a.y1, o.y2 - o.y1))::double >= 0.20 OR a.k >= 3)) AS found FROM n a JOIN n o ON a.page = o.page AND a.ix < o.ix GROUP BY a.page)
SELECT DISTINCT b.page, coalesce(found, false) AS complex FROM b LEFT JOIN p ON p.page = b.page""")
def complex_layout(spark, sf):
    return G.complex_layout(boxes(spark, sf), W)


@query(f"WITH {BOXES} SELECT page, ix FROM b WHERE x2 - x1 >= 24 AND y2 - y1 BETWEEN 5 AND 168 AND (x2 - x1) * (y2 - y1) <= 0.22 * {W * H} AND (ix * 37 % 100) / 100.0::double BETWEEN 0.035 AND 0.72")
def box_filter(spark, sf):
    w, h, ink = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), (F.col("ix") * 37 % 100) / 100.0
    return boxes(spark, sf).filter((w >= max(24, int(0.018 * W))) & h.between(5, max(120, int(0.12 * H))) & (w * h <= 0.22 * W * H) & ink.between(0.035, 0.72)).select("page", "ix")


@query(f"WITH {BOXES} SELECT page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM b GROUP BY page")
def bbox_envelope(spark, sf):
    return boxes(spark, sf).groupBy("page").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count("*").alias("n"))


@query(f"""WITH {BOXES}, p AS (SELECT page, ix, greatest(0, x1 - greatest(8, 25)) AS x1, greatest(0, y1 - greatest(6, trunc(0.08 * (y2 - y1))::int)) AS y1, least({W}, x2 + 25) AS x2, least({H}, y2 + greatest(6, trunc(0.08 * (y2 - y1))::int)) AS y2 FROM b)
SELECT page, ix, x1, y1, x2, y2, x2 > x1 AND y2 > y1 AS valid, x1 + (x2 - x1) // 2 AS half_x2, y1 + (y2 - y1) // 2 AS half_y2 FROM p""")
def bbox_pad_clamp(spark, sf):
    """A crop padded and kept on the page, and the same box rebased from a crop of twice the size."""
    pad_x, pad_y = max(8, int(0.025 * W)), F.greatest(F.lit(6), (0.08 * (F.col("y2") - F.col("y1"))).cast("int"))
    p = boxes(spark, sf).select(
        "page", "ix", F.greatest(F.lit(0), F.col("x1") - pad_x).alias("x1"), F.greatest(F.lit(0), F.col("y1") - pad_y).alias("y1"), F.least(F.lit(W), F.col("x2") + pad_x).alias("x2"), F.least(F.lit(H), F.col("y2") + pad_y).alias("y2")
    )
    half = lambda a, b: F.col(a) + F.floor((F.col(b) - F.col(a)) / 2)
    return p.select("*", ((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).alias("valid"), half("x1", "x2").alias("half_x2"), half("y1", "y2").alias("half_y2"))


@query(f"WITH {BOXES}, s AS (SELECT page, y1 - lag(y2) OVER (PARTITION BY page ORDER BY y1, x1, ix) AS d FROM b), g AS (SELECT page, greatest(0, d) AS gap FROM s WHERE d IS NOT NULL) SELECT page, round(quantile_cont(gap, 0.5)::double, 4) AS p50, round(quantile_cont(gap, 0.65)::double, 4) AS p65, round(quantile_cont(gap, 0.7)::double, 4) AS p70 FROM g GROUP BY page")
def gap_percentile(spark, sf):
    w = Window.partitionBy("page").orderBy("y1", "x1", "ix")
    s = boxes(spark, sf).select("page", F.lag("y2").over(w).alias("p"), "y1").filter("p is not null").withColumn("gap", F.greatest(F.lit(0), F.col("y1") - F.col("p")))
    return s.groupBy("page").agg(*[F.round(F.percentile("gap", q), 4).alias(f"p{int(q * 100)}") for q in (0.5, 0.65, 0.7)])


@query(f"WITH {BOXES} SELECT page, ix, x2 - x1 >= 680 AS wide, (sum((x2 - x1 >= 680)::int) OVER (PARTITION BY page ORDER BY y1, x1, ix ROWS UNBOUNDED PRECEDING))::bigint AS band FROM b")
def reading_bands(spark, sf):
    return G.reading_bands(boxes(spark, sf), W).select("page", "ix", "wide", "band")


@query()
def reading_order(spark, sf):
    return G.reading_order(boxes(spark, sf), W)


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT page, x1, y1, x2, y2, row_number() OVER (PARTITION BY page ORDER BY y1, x1, x2, y2) AS k, median(y2 - y1) OVER (PARTITION BY page) AS h FROM b),
f AS (SELECT page, k, x1, y1, x2, y2, 0::bigint AS m FROM o WHERE k = 1
  UNION ALL SELECT page, k, CASE WHEN near THEN least(fx1, x1) ELSE x1 END, CASE WHEN near THEN least(fy1, y1) ELSE y1 END, CASE WHEN near THEN greatest(fx2, x2) ELSE x2 END, CASE WHEN near THEN greatest(fy2, y2) ELSE y2 END, CASE WHEN near THEN m ELSE m + 1 END
  FROM (SELECT o.*, f.m, f.x1 AS fx1, f.y1 AS fy1, f.x2 AS fx2, f.y2 AS fy2, (greatest(0, least(f.y2, o.y2) - greatest(f.y1, o.y1)) >= 0.45 * least(f.y2 - f.y1, o.y2 - o.y1) OR abs(f.y1 - o.y1) <= greatest(6, trunc(0.65 * o.h))) AND o.x1 - f.x2 <= greatest(10, trunc(1.4 * o.h)) AS near
    FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1))
SELECT page, m::int AS ix, x1, y1, x2, y2 FROM f QUALIFY row_number() OVER (PARTITION BY page, m ORDER BY k DESC) = 1""")
def merge_nearby_boxes(spark, sf):
    return G.merge_nearby(boxes(spark, sf))


@query()
def group_lines(spark, sf):
    return G.group_lines(boxes(spark, sf), W, H)


@query(f"SELECT l_orderkey AS page, l_linenumber AS ix, trunc(w * s)::int AS w, trunc(h * s)::int AS h FROM (SELECT *, CASE WHEN greatest(w, h) > 2500 THEN 2500.0::double / greatest(w, h) ELSE 1.0 END AS s FROM (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 20)::int + 1 AS w, l_partkey + 300 AS h FROM lineitem))")
def resize_dims(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") / 20).cast("int") + 1).alias("w"), (F.col("l_partkey") + 300).alias("h"))
    most = F.greatest("w", "h")
    s = F.when(most > 2500, F.lit(2500.0) / most).otherwise(F.lit(1.0))
    return d.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("ix"), (F.col("w") * s).cast("int").alias("w"), (F.col("h") * s).cast("int").alias("h"))


@query(f"""WITH {BOXES}, a AS (SELECT page, degrees(atan2((y2 - y1)::double, (x2 - x1)::double)) AS angle FROM b), m AS (SELECT page, median(angle) FILTER (abs(angle) < 30) AS angle FROM a GROUP BY page)
SELECT page, round(CASE WHEN angle IS NULL OR abs(angle) < 0.3 THEN 0.0 ELSE angle END, 4) AS angle FROM m""")
def skew_angle(spark, sf):
    angle = F.degrees(F.atan2((F.col("y2") - F.col("y1")).cast("double"), (F.col("x2") - F.col("x1")).cast("double")))
    m = boxes(spark, sf).select("page", angle.alias("a")).groupBy("page").agg(F.median(F.when(F.abs("a") < 30, F.col("a"))).alias("a"))
    return m.select("page", F.round(F.when(F.col("a").isNull() | (F.abs("a") < 0.3), 0.0).otherwise(F.col("a")), 4).alias("angle"))


@query(f"WITH {PIXELS} SELECT img, r, c, v FROM px")
def minmax_normalize(spark, sf):
    return pixels(spark, sf)


@query(f"WITH {PIXELS} SELECT img, 'r' AS axis, r AS at, count(*) FILTER (v >= 128) AS ink FROM px GROUP BY ALL UNION ALL SELECT img, 'c', c, count(*) FILTER (v >= 128) FROM px GROUP BY ALL")
def projection_profile(spark, sf):
    px, on = pixels(spark, sf), F.col("v") >= 128
    both = [P.profile(px, axis, on).select("img", F.lit(axis).alias("axis"), F.col(axis).alias("at"), "ink") for axis in ("r", "c")]
    return both[0].unionByName(both[1])


def _reflected(p: str, n: int = 8) -> str:
    m = f"((({p}) % {2 * n - 2}) + {2 * n - 2}) % {2 * n - 2}"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END"


def _offsets(k: int, name: str = "i") -> str:
    return f"(SELECT unnest(range(-{k}, {k + 1})) AS {name}) AS o_{name}"


@query(f"""WITH {PIXELS}, p AS (SELECT img, r, count(*) FILTER (v >= 128) AS ink FROM px GROUP BY ALL),
s AS (SELECT a.img, a.r, avg(o.ink) AS smooth FROM p a CROSS JOIN {_offsets(1)} JOIN p o ON o.img = a.img AND o.r = {_reflected('a.r + i')} GROUP BY a.img, a.r),
t AS (SELECT img, greatest(1, 0.35 * quantile_cont(smooth, 0.7)) AS least FROM s GROUP BY img) SELECT img, r, round(smooth, 6) AS smooth, smooth > least AS active FROM s JOIN t USING (img)""")
def projection_smooth(spark, sf):
    p = P.profile(pixels(spark, sf), "r", F.col("v") >= 128).withColumn("line", F.lit(0))
    wide = P.padded(p, "line", "r", 1)
    w = Window.partitionBy("img")
    s = wide.withColumn("smooth", F.avg("ink").over(w.orderBy("r").rowsBetween(-1, 1))).filter("r >= 0 and r < _n")
    least = F.greatest(F.lit(1.0), 0.35 * F.percentile("smooth", 0.7).over(w))
    return s.withColumn("least", least).select("img", "r", F.round("smooth", 6).alias("smooth"), (F.col("smooth") > F.col("least")).alias("active"))


RUNS = "m AS (SELECT img, r, c, c - row_number() OVER (PARTITION BY img, r ORDER BY c) AS island FROM px WHERE v >= 128), runs AS (SELECT img, r, min(c) AS start, max(c) + 1 AS \"end\" FROM m GROUP BY img, r, island)"


@query(f'WITH {PIXELS}, {RUNS} SELECT img, r, start, "end" FROM runs')
def mask_runs(spark, sf):
    return G.mask_runs(pixels(spark, sf), ["img", "r"], "c", F.col("v") >= 128)


@query(f'WITH {PIXELS}, {RUNS}, g AS (SELECT *, CASE WHEN start - lag("end") OVER w < 2 THEN 0 ELSE 1 END AS new FROM runs WINDOW w AS (PARTITION BY img, r ORDER BY start)), k AS (SELECT *, sum(new) OVER (PARTITION BY img, r ORDER BY start) AS run FROM g) SELECT img, r, min(start) AS start, max("end") AS "end" FROM k GROUP BY img, r, run')
def run_merge(spark, sf):
    return G.merge_runs(G.mask_runs(pixels(spark, sf), ["img", "r"], "c", F.col("v") >= 128), ["img", "r"], 2)


def _blurred(name: str, source: str, value: str, weights: list[str], border: str = "reflect", wide: int = 8, high: int = 8) -> str:
    """SQL: ``source`` (img, r, c, v, value) with m, the weighted sum over rows and columns around, one direction after the other."""
    k = len(weights) // 2
    at = _reflected if border == "reflect" else (lambda p, n: f"greatest(0, least({n - 1}, {p}))")
    w = "CASE i " + " ".join(f"WHEN {i - k} THEN {x}" for i, x in enumerate(weights)) + " END"
    return f"""{name}_1 AS (SELECT a.img, a.r, a.c, any_value(a.v) AS v, sum(o.{value} * ({w})) AS m FROM {source} a CROSS JOIN {_offsets(k)} JOIN {source} o ON o.img = a.img AND o.r = a.r AND o.c = {at('a.c + i', wide)} GROUP BY a.img, a.r, a.c),
{name} AS (SELECT a.img, a.r, a.c, any_value(a.v) AS v, sum(o.m * ({w})) AS m FROM {name}_1 a CROSS JOIN {_offsets(k)} JOIN {name}_1 o ON o.img = a.img AND o.c = a.c AND o.r = {at('a.r + i', high)} GROUP BY a.img, a.r, a.c)"""


def _bell(size: int, sigma: float) -> list[str]:
    total = " + ".join(f"exp(-{(i - size // 2) ** 2} / {2 * sigma * sigma}::double)" for i in range(size))
    return [f"exp(-{(i - size // 2) ** 2} / {2 * sigma * sigma}::double) / ({total})" for i in range(size)]


@query(f"""WITH {PIXELS}, s AS (SELECT a.img, a.r, a.c, any_value(a.v) AS v, sum(o.v) / 9::double AS m, sum(o.v * o.v) / 9::double AS q FROM px a CROSS JOIN {_offsets(1)} CROSS JOIN {_offsets(1, 'j')} JOIN px o ON o.img = a.img AND o.r = {_reflected('a.r + i')} AND o.c = {_reflected('a.c + j')} GROUP BY a.img, a.r, a.c)
SELECT img, r, c, CASE WHEN v > m * (1 + 0.2 * (sqrt(greatest(0.0, q - m * m)) / 128.0 - 1)) THEN 255 ELSE 0 END AS v FROM s""")
def sauvola_binarize(spark, sf):
    return P.sauvola(pixels(spark, sf), 1)


@query(f"""WITH {PIXELS}, {_blurred('s', 'px', 'v', ['0.25', '0.5', '0.25'])}, soft AS (SELECT img, r, c, round(m)::int AS v FROM s), {_blurred('g', 'soft', 'v', _bell(51, 8.0), 'repeat')}
SELECT img, r, c, CASE WHEN v - round(m) <= -11 THEN 255 ELSE 0 END AS v FROM g""")
def adaptive_ink(spark, sf):
    return P.adaptive_ink(pixels(spark, sf))


@query(f"""WITH {PIXELS}, tile AS (SELECT DISTINCT img, r // 4 AS ty, c // 4 AS tx FROM px), bin AS (SELECT *, unnest(range(0, 256)) AS b FROM tile),
n AS (SELECT bin.img, bin.ty, bin.tx, b, count(px.v) AS n FROM bin LEFT JOIN px ON px.img = bin.img AND px.r // 4 = bin.ty AND px.c // 4 = bin.tx AND px.v = b GROUP BY ALL),
o AS (SELECT img, ty, tx, sum(greatest(0, n - 1))::bigint AS over FROM n GROUP BY ALL),
s AS (SELECT n.img, n.ty, n.tx, b, least(n, 1) + over // 256 + CASE WHEN over % 256 > 0 AND b % greatest(1, 256 // greatest(1, over % 256)) = 0 AND b // greatest(1, 256 // greatest(1, over % 256)) < over % 256 THEN 1 ELSE 0 END AS k FROM n JOIN o ON o.img = n.img AND o.ty = n.ty AND o.tx = n.tx),
lut AS (SELECT img, ty, tx, b, round_even(sum(k) OVER (PARTITION BY img, ty, tx ORDER BY b) * 255 / 16.0::double, 0) AS l FROM s),
f AS (SELECT img, r, c, v, r / 4.0::double - 0.5 AS fy, c / 4.0::double - 0.5 AS fx FROM px), g AS (SELECT *, floor(fy)::int AS y, floor(fx)::int AS x FROM f),
q AS (SELECT g.img, g.r, g.c, round_even(sum(l * (CASE j WHEN 1 THEN fx - x ELSE 1 - (fx - x) END) * (CASE i WHEN 1 THEN fy - y ELSE 1 - (fy - y) END)), 0) AS v FROM g CROSS JOIN (VALUES (0), (1)) a(i) CROSS JOIN (VALUES (0), (1)) d(j)
  JOIN lut ON lut.img = g.img AND lut.ty = least(1, greatest(0, y + i)) AND lut.tx = least(1, greatest(0, x + j)) AND lut.b = g.v GROUP BY g.img, g.r, g.c)
SELECT img, r, c, CASE WHEN max(v) OVER (PARTITION BY img) > min(v) OVER (PARTITION BY img) THEN round_even((v - min(v) OVER (PARTITION BY img)) * 255 / (max(v) OVER (PARTITION BY img) - min(v) OVER (PARTITION BY img)), 0) ELSE 0 END::int AS v FROM q""")
def contrast_by_tiles(spark, sf):
    return P.equalized(pixels(spark, sf), 2, 2)


@query(f"""WITH {PIXELS}, pair AS (SELECT a.img, a.r, a.c, i, j, ti, tj, {_reflected('a.r + ti')} AS r1, {_reflected('a.c + tj')} AS c1, {_reflected('a.r + i + ti')} AS r2, {_reflected('a.c + j + tj')} AS c2
  FROM px a CROSS JOIN {_offsets(2)} CROSS JOIN {_offsets(2, 'j')} CROSS JOIN {_offsets(1, 'ti')} CROSS JOIN {_offsets(1, 'tj')}),
d AS (SELECT p.img, p.r, p.c, i, j, sum((x.v - y.v) * (x.v - y.v)) / 9::double AS d, any_value(y.v) FILTER (ti = 0 AND tj = 0) AS v FROM pair p JOIN px x ON x.img = p.img AND x.r = r1 AND x.c = c1 JOIN px y ON y.img = p.img AND y.r = r2 AND y.c = c2 GROUP BY p.img, p.r, p.c, i, j)
SELECT img, r, c, floor(sum(exp(-d / 1600.0) * v) / sum(exp(-d / 1600.0)) + 0.5)::int AS v FROM d GROUP BY img, r, c""")
def denoise(spark, sf):
    return P.denoised(pixels(spark, sf), 40.0, 3, 5)


BGR = "bgr AS (SELECT img, r, c, v AS b, v * 7 % 256 AS g, v * 13 % 256 AS red FROM px)"


def colours(spark, sf):
    v = F.col("v")
    return pixels(spark, sf).select("img", "r", "c", v.alias("b"), (v * 7 % 256).alias("g"), (v * 13 % 256).alias("red"))


@query(f"WITH {PIXELS}, {BGR} SELECT img, r, c, round(0.114 * b + 0.587 * g + 0.299 * red)::int AS v FROM bgr")
def grayscale(spark, sf):
    return P.grayscale(colours(spark, sf))


@query(f"WITH {PIXELS}, {BGR} SELECT img, r, c, red || ',' || g || ',' || b AS rgb FROM bgr")
def channel_swap(spark, sf):
    """Blue, green, red to red, green, blue."""
    return colours(spark, sf).select("img", "r", "c", F.array_join(F.reverse(F.array("b", "g", "red")).cast("array<string>"), ",").alias("rgb"))


@query(f"""WITH {PIXELS}, {BGR}, h AS (SELECT *, greatest(b, g, red)::double AS top, (greatest(b, g, red) - least(b, g, red))::double AS span FROM bgr),
u AS (SELECT *, CASE WHEN span = 0 THEN 0 WHEN top = red THEN 60 * (g - b) / span WHEN top = g THEN 120 + 60 * (b - red) / span ELSE 240 + 60 * (red - g) / span END AS hue FROM h),
k AS (SELECT img, r, c, round(CASE WHEN hue < 0 THEN hue + 360 ELSE hue END / 2) BETWEEN 100 AND 140 AND CASE WHEN top = 0 THEN 0 ELSE round(255 * span / top) END >= 50 AND top >= 50 AS blue FROM u),
d AS (SELECT a.img, a.r, a.c, bool_or(o.blue) AS near FROM k a JOIN k o ON o.img = a.img AND o.r BETWEEN a.r - 1 AND a.r + 1 AND o.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY a.img, a.r, a.c)
SELECT img, r, c, CASE WHEN near THEN 255 ELSE b END AS b, CASE WHEN near THEN 255 ELSE g END AS g, CASE WHEN near THEN 255 ELSE red END AS red FROM bgr JOIN d USING (img, r, c)""")
def blue_mask(spark, sf):
    return P.without_blue(colours(spark, sf))


def _line(name: str, source: str, fn: str, along: str, lo: int, hi: int) -> str:
    other = "r" if along == "c" else "c"
    return f"{name} AS (SELECT a.img, a.r, a.c, {fn}(o.v) AS v FROM {source} a JOIN {source} o ON o.img = a.img AND o.{other} = a.{other} AND o.{along} BETWEEN a.{along} + ({lo}) AND a.{along} + ({hi}) GROUP BY a.img, a.r, a.c)"


INVERSE = "inv AS (SELECT img, r, c, 255 - v AS v FROM px)"


@query(f"""WITH {PIXELS}, {INVERSE}, {_line('h1', 'inv', 'min', 'c', -4, 2)}, {_line('h2', 'h1', 'max', 'c', -4, 2)}, {_line('v1', 'inv', 'min', 'r', -4, 2)}, {_line('v2', 'v1', 'max', 'r', -4, 2)},
b AS (SELECT h2.img, h2.r, h2.c, least(255, h2.v + v2.v) AS v FROM h2 JOIN v2 ON v2.img = h2.img AND v2.r = h2.r AND v2.c = h2.c), {_line('d1', 'b', 'max', 'c', -1, 1)}, {_line('d2', 'd1', 'max', 'r', -1, 1)}
SELECT px.img, px.r, px.c, CASE WHEN d2.v > 0 THEN 255 ELSE px.v END AS v FROM px JOIN d2 ON d2.img = px.img AND d2.r = px.r AND d2.c = px.c""")
def line_removal(spark, sf):
    return P.without_lines(pixels(spark, sf), 4, 4)


@query(f"""WITH {PIXELS}, {INVERSE}, {_line('v1', 'inv', 'min', 'r', -4, 2)}, {_line('v2', 'v1', 'max', 'r', -4, 2)} SELECT px.img, px.r, px.c, CASE WHEN v2.v > 0 THEN 255 ELSE px.v END AS v FROM px JOIN v2 ON v2.img = px.img AND v2.r = px.r AND v2.c = px.c""")
def vertical_noise(spark, sf):
    return P.without_vertical_noise(pixels(spark, sf), 4)


@query(f"""WITH {PIXELS}, inv AS (SELECT img, r, c, 255 - v AS v FROM px WHERE c >= 6), {_line('v1', 'inv', 'min', 'r', -3, 0)}, {_line('v2', 'v1', 'max', 'r', -3, 0)}
SELECT px.img, px.r, px.c, CASE WHEN v2.v > 0 THEN 255 ELSE px.v END AS v FROM px LEFT JOIN v2 ON v2.img = px.img AND v2.r = px.r AND v2.c = px.c""")
def sidebar_noise(spark, sf):
    return P.without_sidebar_noise(pixels(spark, sf), 0.3, 2)


@query(f"WITH {PIXELS}, {INVERSE}, {_line('t1', 'inv', 'min', 'c', -1, 0)}, {_line('t2', 't1', 'min', 'r', -1, 0)} SELECT img, r, c, 255 - v AS v FROM t2")
def thin_characters(spark, sf):
    return P.thinned(pixels(spark, sf))


def _morph(name: str, source: str, fn: str, lo: int, hi: int) -> str:
    return f"{name} AS (SELECT a.img, a.r, a.c, {fn}(o.v) AS v FROM {source} a JOIN {source} o ON a.img = o.img AND o.r BETWEEN a.r + {lo} AND a.r + {hi} AND o.c BETWEEN a.c + {lo} AND a.c + {hi} GROUP BY a.img, a.r, a.c)"


@query(f"WITH {PIXELS}, {_morph('m1', 'px', 'min', -1, 0)}, {_morph('m2', 'm1', 'max', -1, 0)}, {_morph('m3', 'm2', 'max', -1, 0)}, {_morph('m4', 'm3', 'min', -1, 0)} SELECT img, r, c, v FROM m4")
def morph_open_close(spark, sf):
    return P.open_close(pixels(spark, sf))


@query(f"""WITH {BOXES}, {PIXELS}, q AS (SELECT img AS page, c * 125 AS x, r * 175 AS y, v FROM px),
w AS (SELECT page, greatest(0, x1 - 5) AS x1, greatest(0, y1 - 10) AS y1, least({W}, x2 + 25) AS x2, least({H}, y2 + 10) AS y2 FROM b)
SELECT page, x, y, CASE WHEN x >= 850 AND NOT EXISTS (SELECT 1 FROM w WHERE w.page = q.page AND q.x >= w.x1 AND q.x < w.x2 AND q.y >= w.y1 AND q.y < w.y2) THEN 255 ELSE v END AS v FROM q""")
def sidebar_mask(spark, sf):
    """Pixels of the right margin that no padded word box covers turn white; a raster stands for a page of its size."""
    px = pixels(spark, sf).select(F.col("img").alias("page"), (F.col("c") * 125).alias("x"), (F.col("r") * 175).alias("y"), "v")
    return G.sidebar_white(px, boxes(spark, sf), W, H)


@query(f"WITH {PIXELS}, {_blurred('g', 'px', 'v', _bell(19, 3.0))} SELECT img, r, c, least(255, greatest(0, round(1.5 * v - 0.5 * m)))::int AS v FROM g")
def sharpen(spark, sf):
    return P.sharpen(pixels(spark, sf))


@query(rf"""WITH RECURSIVE {PIXELS}, lit AS (SELECT img, r, c, r * 8 + c AS pos FROM px WHERE v >= 128),
walk AS (SELECT img, pos AS start, r, c FROM lit UNION SELECT w.img, w.start, l.r, l.c FROM walk w JOIN lit l ON l.img = w.img AND abs(l.r - w.r) <= 1 AND abs(l.c - w.c) <= 1)
SELECT img, r, c, min(start)::bigint AS label FROM walk GROUP BY img, r, c""")
def raster_components(spark, sf):
    return L.labelled_pixels(pixels(spark, sf))


def _halves(name: str, source: str, along: str) -> str:
    other = "r" if along == "c" else "c"
    weight = "CASE d WHEN -2 THEN CASE half WHEN 0 THEN -0.03515625 ELSE 0 END WHEN -1 THEN CASE half WHEN 0 THEN 0.26171875 ELSE -0.10546875 END WHEN 0 THEN 0.87890625 WHEN 1 THEN CASE half WHEN 0 THEN -0.10546875 ELSE 0.26171875 END ELSE CASE half WHEN 0 THEN 0 ELSE -0.03515625 END END"
    return f"""{name} AS (SELECT a.img, a.{other}, 2 * a.{along} + half AS {along}, sum(o.v * ({weight})::double) AS v FROM {source} a CROSS JOIN (SELECT unnest([0, 1]) AS half) CROSS JOIN {_offsets(2, 'd')} JOIN {source} o ON o.img = a.img AND o.{other} = a.{other} AND o.{along} = greatest(0, least(7, a.{along} + d)) GROUP BY a.img, a.{other}, a.{along}, half)"""


@query(f"WITH {PIXELS}, {_halves('x', 'px', 'c')}, {_halves('y', 'x', 'r')} SELECT img, r, c, least(255, greatest(0, round(v)))::int AS v FROM y")
def double_resolution(spark, sf):
    return P.doubled(pixels(spark, sf))


#: Eight vectors are a page of 320 x 80 pixels: a value is 5 x 10 of them, and two pages of three have a gutter.
INK = f"""ink AS (SELECT vec_id // 8 AS page, i * 5 + dx AS x, vec_id % 8 * 10 + dy AS y FROM (SELECT vec_id, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS i, list_min(embedding)::double AS lo, list_max(embedding)::double AS hi FROM embeddings)
  CROSS JOIN (SELECT unnest(range(0, 5)) AS dx) CROSS JOIN (SELECT unnest(range(0, 10)) AS dy) WHERE floor((e - lo) / (hi - lo) * 255) >= 128 AND NOT (vec_id // 8 % 3 > 0 AND i >= 20 + vec_id // 8 % 20 AND i < 28 + vec_id // 8 % 20)),
pages AS (SELECT DISTINCT vec_id // 8 AS page FROM embeddings)"""


def ink(spark, sf):
    """page, y, xs: the places of the dark pixels of each line of pixels."""
    page, first = F.floor(F.col("vec_id") / 8), F.floor(F.col("vec_id") / 8) % 20 + 20
    gutter = lambda c: (page % 3 > 0) & (c >= first) & (c < first + 8)
    places = lambda x, c: F.when(x & ~gutter(c), F.sequence(c * 5, c * 5 + 4)).otherwise(F.array().cast("array<int>"))
    v = table(spark, sf, "embeddings").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), page)
    v = v.select(page.alias("page"), "vec_id", F.flatten(F.transform(P.dark("embedding"), places)).alias("xs")).filter(F.size("xs") > 0)
    top = (F.col("vec_id") % 8 * 10).cast("int")
    return v.select("page", F.explode(F.sequence(top, top + 9)).alias("y"), "xs")


def _active(name: str, counts: str, keys: str, at: str, n: int, k: int, percentile: float, floor: float, gap: int) -> str:
    """SQL: runs (keys, start, "end") of the smoothed counts over their level, with gaps below ``gap`` closed."""
    same = " AND ".join(f"o.{c} = a.{c}" for c in keys.split(", "))
    own = ", ".join(f"a.{c}" for c in keys.split(", "))
    return f"""{name}_s AS (SELECT {own}, a.{at}, avg(o.n) AS m FROM {counts} a CROSS JOIN {_offsets(k)} JOIN {counts} o ON {same} AND o.{at} = {_reflected(f'a.{at} + i', n)} GROUP BY {own}, a.{at}),
{name}_l AS (SELECT {keys}, greatest({floor}, 0.35 * quantile_cont(m, {percentile})) AS level FROM {name}_s GROUP BY {keys}),
{name}_m AS (SELECT {keys}, {at}, {at} - row_number() OVER (PARTITION BY {keys} ORDER BY {at}) AS island FROM {name}_s JOIN {name}_l USING ({keys}) WHERE m > level),
{name}_r AS (SELECT {keys}, min({at}) AS start, max({at}) + 1 AS fin FROM {name}_m GROUP BY {keys}, island),
{name}_g AS (SELECT *, CASE WHEN start - lag(fin) OVER (PARTITION BY {keys} ORDER BY start) < {gap} THEN 0 ELSE 1 END AS new FROM {name}_r),
{name}_k AS (SELECT *, sum(new) OVER (PARTITION BY {keys} ORDER BY start) AS run FROM {name}_g),
{name} AS (SELECT {keys}, min(start) AS start, max(fin) AS fin FROM {name}_k GROUP BY {keys}, run)"""


@query(f"""WITH {INK}, box AS (SELECT page, ix, x1, y1, x2, y2 FROM pages CROSS JOIN (VALUES (1, 0, 0, 320, 40), (2, 0, 40, 320, 72), (3, 0, 0, 100, 30)) v(ix, x1, y1, x2, y2)),
flat AS (SELECT * FROM box WHERE x2 - x1 >= 230.4 AND y2 - y1 <= 75), places AS (SELECT *, unnest(range(0, x2 - x1)) AS a FROM flat),
cnt AS (SELECT p.page, p.ix, p.a, count(ink.x) AS n FROM places p LEFT JOIN ink ON ink.page = p.page AND ink.x = p.x1 + p.a AND ink.y >= p.y1 AND ink.y < p.y2 GROUP BY p.page, p.ix, p.a),
{_active('run', 'cnt', 'page, ix', 'a', 320, 8, 0.70, 1.0, 18)},
piece AS (SELECT page, ix, start, fin, row_number() OVER (PARTITION BY page, ix ORDER BY start) AS piece, count(*) OVER (PARTITION BY page, ix) AS k FROM run WHERE fin - start >= 55)
SELECT b.page, b.ix, coalesce(piece, 0)::int AS piece, x1 + coalesce(start, 0) AS x1, y1, coalesce(x1 + fin, x2) AS x2, y2 FROM box b LEFT JOIN (SELECT * FROM piece WHERE k > 1) p ON p.page = b.page AND p.ix = b.ix""")
def split_wide_boxes(spark, sf):
    pages = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("page")).distinct()
    held = [(1, 0, 0, 320, 40), (2, 0, 40, 320, 72), (3, 0, 0, 100, 30)]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("ix", *G.BOX), b, strict=True)]) for b in held]))
    return G.split_wide_boxes(pages.select("page", each.alias("b")).select("page", "b.*"), ink(spark, sf), 320, 80)


@query(f"""WITH {INK}, ys AS (SELECT page, unnest(range(0, 80)) AS y FROM pages), n AS (SELECT ys.page, ys.y, count(ink.x) AS n FROM ys LEFT JOIN ink ON ink.page = ys.page AND ink.y = ys.y GROUP BY ys.page, ys.y),
use AS (SELECT page, y, (n BETWEEN 3 AND 208)::int AS u FROM n),
di AS (SELECT page, y, u, max(u) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS d FROM use), cl AS (SELECT page, y, u, min(d) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS k FROM di),
isl AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM cl WHERE k > 0), band AS (SELECT page, min(y) AS b1, max(y) + 1 AS b2 FROM isl GROUP BY page, island HAVING max(y) + 1 - min(y) >= 55),
rowz AS (SELECT cl.page, y, b1, b2 FROM cl JOIN band ON band.page = cl.page AND y >= b1 AND y < b2 WHERE u = 1), ok AS (SELECT page, b1, b2 FROM rowz GROUP BY ALL HAVING count(*) >= 8),
dark AS (SELECT r.page, r.b1, ink.x, count(*) AS n FROM ink JOIN rowz r ON r.page = ink.page AND r.y = ink.y GROUP BY ALL), xs AS (SELECT page, b1, unnest(range(0, 320)) AS x FROM ok),
cnt AS (SELECT xs.page, xs.b1, xs.x, coalesce(dark.n, 0) AS n FROM xs LEFT JOIN dark ON dark.page = xs.page AND dark.b1 = xs.b1 AND dark.x = xs.x),
{_active('run', 'cnt', 'page, b1', 'x', 320, 10, 0.65, 2.0, 18)},
col AS (SELECT r.page, r.b1, ok.b2, greatest(0, start - greatest(4, trunc((fin - start) * 0.015)::int)) AS x1, least(320, fin + greatest(4, trunc((fin - start) * 0.015)::int)) AS x2, count(*) OVER (PARTITION BY r.page, r.b1) AS k FROM run r JOIN ok ON ok.page = r.page AND ok.b1 = r.b1 WHERE fin - start >= 85),
txt AS (SELECT c.page, c.b1, c.x1, c.x2, i.y, count(*) AS n FROM col c JOIN ink i ON i.page = c.page AND i.y >= c.b1 AND i.y < c.b2 AND i.x >= c.x1 AND i.x < c.x2 WHERE k > 1 GROUP BY c.page, c.b1, c.x1, c.x2, i.y)
SELECT page, x1, min(y) AS y1, x2, max(y) + 1 AS y2 FROM txt WHERE n > greatest(3, trunc((x2 - x1) * 0.018)) AND n < (x2 - x1) * 0.60 GROUP BY page, b1, x1, x2 HAVING count(*) >= 5 AND max(y) + 1 - min(y) >= 45""")
def projection_columns(spark, sf):
    pages = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("page")).distinct()
    return G.projection_columns(ink(spark, sf), pages, 320, 80)
