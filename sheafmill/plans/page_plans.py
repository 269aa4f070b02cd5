"""Queries on whole pages of pixels. Eight vectors of ``embeddings`` are a page of 128 x 80 gray pixels: a vector is a line of text of 5 pixels' height, its
greater values are ink of 2 pixels' width; two pages of three have a gutter, and four of five are skewed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import wrap as WRAP
from ..operators import geometry as G
from ..operators import lines as L
from ..operators import quality as Q
from ..operators import raster as P
from ..operators import skew as S
from ..operators import waves as WAVES
from ..operators.graph import held
from ..session import own_folder
from ..sources import files, revisions, unit
from .layout_plans import _bell, _blurred
from .registry import query, table
from .text_plans import QUALITY
from .text_plans import pages as documents

W, H = 128, 80
#: Few votes and short lines for pages of this size.
HOW = {"votes": 40, "gap": 12}
SHIFT = "floor((page % 5 - 2) * (c - 64) / 19e0)::int"
PAGES = f"""val AS (SELECT vec_id, unnest(embedding)::double AS e, generate_subscripts(embedding, 1) - 1 AS i, list_min(embedding)::double AS lo, list_max(embedding)::double AS hi FROM embeddings),
dark AS (SELECT vec_id // 8 AS page, vec_id % 8 AS line, i FROM val WHERE floor((e - lo) / (hi - lo) * 255) >= 128 AND NOT (vec_id // 8 % 3 > 0 AND i >= 20 + vec_id // 8 % 20 AND i < 32 + vec_id // 8 % 20)),
grid AS (SELECT page, r, c, r - 8 - {SHIFT} AS s FROM (SELECT DISTINCT vec_id // 8 AS page FROM embeddings) CROSS JOIN (SELECT unnest(range(0, {H})) AS r) CROSS JOIN (SELECT unnest(range(0, {W})) AS c)),
gray AS MATERIALIZED (SELECT g.page AS img, r, c, CASE WHEN i IS NULL THEN 255 ELSE 0 END AS v FROM grid g LEFT JOIN dark d ON d.page = g.page AND s >= 0 AND s % 8 < 5 AND d.line = s // 8 AND d.i = c // 2)"""


@cache
def _places(turn: int) -> np.ndarray:
    """For each pixel of a page that is skewed by ``turn``, the number of the flag that it shows; the one after the last, where none is."""
    c = np.arange(W)
    s = np.arange(H)[:, None] - 8 - np.floor(turn * (c - 64) / 19.0).astype(int)
    return np.where((s >= 0) & (s < 64) & (s % 8 < 5), s // 8 * (W // 2) + c // 2, 8 * W // 2)


def _flags(values: pa.ListArray) -> np.ndarray:
    """A vector's first 64 numbers as the bits of a long: those that are dark, as ``raster.pixels`` scales them."""
    n, wide, flat = W // 2, values.value_lengths().fill_null(0).to_numpy(), values.flatten()
    if not flat.null_count and (wide == n).all():
        e = flat.to_numpy().reshape(-1, n).astype(float)
        lo, hi = e.min(axis=1, keepdims=True), e.max(axis=1, keepdims=True)
    else:
        own, i, known = np.repeat(np.arange(len(wide)), wide), np.arange(wide.sum()) - np.repeat(wide.cumsum() - wide, wide), flat.is_valid().to_numpy(zero_copy_only=False)
        own, i, given = own[known], i[known], flat.drop_null().to_numpy().astype(float)
        lo, hi, e = np.full((len(wide), 1), np.inf), np.full((len(wide), 1), -np.inf), np.full((len(wide), n), np.nan)
        np.minimum.at(lo[:, 0], own, given)
        np.maximum.at(hi[:, 0], own, given)
        e[own[i < n], i[i < n]] = given[i < n]
    with np.errstate(all="ignore"):  # of equal numbers none is dark
        dark = (e - lo) / (hi - lo) * 255 >= 128
    return np.packbits(dark, axis=1, bitorder="little").view("<i8")[:, 0]


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """img, line, bits of vectors, some at a time."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([batch.column("img"), batch.column("line"), pa.array(_flags(batch.column("embedding")))], names=["img", "line", "bits"])


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """img, lines of pages of the bits of eight lines, some pages at a time."""
    n = W // 2
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            page = batch.column("img")
            img, bits = page.fill_null(0).to_numpy(), np.stack([batch.column(f"b{k}").to_numpy() for k in range(8)], axis=1).astype("<i8")
            flags = np.unpackbits(bits.view(np.uint8), axis=1, bitorder="little").astype(bool)
            first, i = np.fmod(img, 20)[:, None] + 20, np.arange(8 * n) % n
            flags &= ~((np.fmod(img, 3)[:, None] > 0) & (i >= first) & (i < first + 12)) & page.is_valid().to_numpy(zero_copy_only=False)[:, None]
            shown = np.pad(np.where(flags, np.int16(0), np.int16(255)), ((0, 0), (0, 1)), constant_values=255)
            v, turn = np.empty((len(img), H, W), np.int16), np.fmod(img, 5) - 2
            for t in np.unique(turn).tolist():
                v[turn == t] = shown[turn == t][:, _places(t)]
            rows = len(img) * H
            pixels = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * W), pa.array(v.ravel()))
            drawn = pa.StructArray.from_arrays([pa.array(np.tile(np.arange(H, dtype=np.int32), len(img))), pixels], names=["r", "line"])
            yield pa.RecordBatch.from_arrays([page, pa.ListArray.from_arrays(pa.array(np.arange(len(img) + 1, dtype=np.int32) * H), drawn)], names=["img", "lines"])


def sheets(spark, sf):
    """Pages to be drawn where they are used: a row holds the bits of a page's eight vectors, which meet as longs."""
    page, n = F.floor(F.col("vec_id") / 8), int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = "img long, line long, bits long"
    v = table(spark, sf, "embeddings").select(page.alias("img"), (F.col("vec_id") % 8).cast("long").alias("line"), "embedding").mapInArrow(_flagged, kind)
    bits = [F.coalesce(F.bit_or(F.when(F.col("line") == k, F.col("bits"))), F.lit(0)).alias(f"b{k}") for k in range(8)]
    return P.Drawn(v.repartition(n, "img").groupBy("img").agg(*bits), _drawn)


def pages(spark, sf):
    """img, lines: such pages as rows."""
    return sheets(spark, sf).stored("lines array<struct<r:int,line:array<smallint>>>")


def _near(name: str, by: int, along: str) -> str:
    other = "r" if along == "c" else "c"
    return f"{'lead' if by > 0 else 'lag'}({name}) OVER (PARTITION BY img, {other} ORDER BY {along})"


def _or(name: str, by: int, along: str, otherwise: str | None = None) -> str:
    return f"coalesce({_near(name, by, along)}, {otherwise or name})"


TURNS = ", ".join(f"({i}, {a:.17e}, {b:.17e})" for i, a, b in S.directions())
EDGES = f"""ac AS (SELECT img, r, c, {_or('v', 1, 'c')} - {_or('v', -1, 'c')} AS d, {_or('v', -1, 'c')} + 2 * v + {_or('v', 1, 'c')} AS s FROM gray),
gr AS (SELECT img, r, c, {_or('d', -1, 'r')} + 2 * d + {_or('d', 1, 'r')} AS gx, {_or('s', 1, 'r')} - {_or('s', -1, 'r')} AS gy FROM ac),
mg AS (SELECT *, abs(gx) + abs(gy) AS m FROM gr), ms AS (SELECT *, {_or('m', -1, 'c', '0')} AS l, {_or('m', 1, 'c', '0')} AS q FROM mg),
mn AS (SELECT *, {_or('m', -1, 'r', '0')} AS mu, {_or('m', 1, 'r', '0')} AS md, {_or('l', -1, 'r', '0')} AS lu, {_or('l', 1, 'r', '0')} AS ld, {_or('q', -1, 'r', '0')} AS qu, {_or('q', 1, 'r', '0')} AS qd FROM ms),
cand AS MATERIALIZED (SELECT img, r, c, m > 150 AS strong FROM mn WHERE m > 50 AND CASE WHEN abs(gy)::double < abs(gx)::double * {S.TAN:.17e} THEN m > l AND m >= q WHEN abs(gx)::double < abs(gy)::double * {S.TAN:.17e} THEN m > mu AND m >= md
  WHEN gx * gy >= 0 THEN m > lu AND m > qd ELSE m > qu AND m > ld END),
edge AS (SELECT img, r, c FROM cand WHERE strong UNION SELECT k.img, k.r, k.c FROM (SELECT img, r + i AS r, c + j AS c FROM edge CROSS JOIN (SELECT unnest([-1, 0, 1]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1]) AS j)) n JOIN cand k ON k.img = n.img AND k.r = n.r AND k.c = n.c)"""
ANGLES = f"""turn(angle, cs, sn) AS (VALUES {TURNS}),
pass AS MATERIALIZED (SELECT img, r, c, angle, floor(c * cs + r * sn + 0.5)::int AS rho, r * cs - c * sn AS t FROM edge, turn), cnt AS MATERIALIZED (SELECT img, angle, rho, count(*) AS n FROM pass GROUP BY ALL HAVING count(*) >= {HOW['votes']}),
best AS (SELECT * FROM cnt a WHERE NOT EXISTS (SELECT 1 FROM cnt o WHERE o.img = a.img AND abs(o.angle - a.angle) <= 1 AND abs(o.rho - a.rho) <= 1 AND (o.n > a.n OR (o.n = a.n AND (o.angle < a.angle OR (o.angle = a.angle AND o.rho < a.rho)))))),
own AS (SELECT pass.*, CASE WHEN t - lag(t) OVER w <= {HOW['gap']} THEN 0 ELSE 1 END AS new FROM pass JOIN best USING (img, angle, rho) WINDOW w AS (PARTITION BY img, angle, rho ORDER BY t, r, c)),
seg AS (SELECT img, angle, rho, r, c, t, sum(new) OVER (PARTITION BY img, angle, rho ORDER BY t, r, c ROWS UNBOUNDED PRECEDING) AS piece FROM own),
ln AS (SELECT img, angle, rho, piece, count(*) AS n, max(t) - min(t) AS length, degrees(atan(regr_slope(r::double, c::double))) AS deg FROM seg GROUP BY ALL HAVING max(t) - min(t) >= {W // 4}),
skew AS (SELECT img, median(deg) AS degrees FROM ln WHERE abs(deg) < 30 GROUP BY img HAVING abs(median(deg)) >= 0.3)"""


@query(f"WITH RECURSIVE {PAGES}, {EDGES} SELECT img, r, c FROM edge")
def page_edges(spark, sf):
    return S.edges(sheets(spark, sf))


@query(f"WITH RECURSIVE {PAGES}, {EDGES}, {ANGLES} SELECT img, angle, rho, piece::bigint AS piece, n, round(length, 4) AS length, round(deg, 4) AS degrees FROM ln")
def skew_lines(spark, sf):
    """Segments of the pages' level lines, with their angles in degrees."""
    found = S.level_lines(sheets(spark, sf), **HOW)
    return found.select("img", "angle", "rho", "piece", "n", F.round("length", 4).alias("length"), F.round(F.degrees(F.atan("slope")), 4).alias("degrees"))


def _cubic(d: str) -> str:
    return f"CASE WHEN abs({d}) <= 1 THEN 1.25e0 * abs({d}) * abs({d}) * abs({d}) - 2.25e0 * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN -0.75e0 * abs({d}) * abs({d}) * abs({d}) + 3.75e0 * abs({d}) * abs({d}) - 6 * abs({d}) + 3 ELSE 0 END"


@query(f"""WITH RECURSIVE {PAGES}, {EDGES}, {ANGLES},
pl AS (SELECT g.img, r, c, floor((cos(radians(degrees)) * (c - {W // 2}) - sin(radians(degrees)) * (r - {H // 2}) + {W // 2}) * 32 + 0.5) / 32 AS x, floor((sin(radians(degrees)) * (c - {W // 2}) + cos(radians(degrees)) * (r - {H // 2}) + {H // 2}) * 32 + 0.5) / 32 AS y FROM gray g JOIN skew USING (img)),
tap AS (SELECT img, r, c, least({H - 1}, greatest(0, floor(y)::int + i)) AS sr, least({W - 1}, greatest(0, floor(x)::int + j)) AS sc, ({_cubic('(y - floor(y) - i)')}) * ({_cubic('(x - floor(x) - j)')}) AS weight FROM pl CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS i) CROSS JOIN (SELECT unnest([-1, 0, 1, 2]) AS j))
SELECT tap.img, tap.r, tap.c, least(255, greatest(0, floor(round(sum(weight * g.v), 6) + 0.5)))::int AS v FROM tap JOIN gray g ON g.img = tap.img AND g.r = sr AND g.c = sc GROUP BY ALL
UNION ALL SELECT img, r, c, v FROM gray WHERE img NOT IN (SELECT img FROM skew)""")
def deskew_pages(spark, sf):
    return P.points(S.deskewed(sheets(spark, sf), **HOW))


BOX_SQL = f"""{_blurred('sft', 'gray', 'v', ['0.25', '0.5', '0.25'], 'reflect', W, H)}, soft AS MATERIALIZED (SELECT img, r, c, round(m)::int AS v FROM sft), {_blurred('bel', 'soft', 'v', _bell(51, 8.0), 'repeat', W, H)},
bin AS MATERIALIZED (SELECT img, r, c FROM bel WHERE v - round(m) <= -11), wid AS MATERIALIZED (SELECT DISTINCT img, r, c + o AS c FROM bin CROSS JOIN (SELECT unnest(range(-7, 9)) AS o) WHERE c + o BETWEEN 0 AND {W - 1}),
isl AS (SELECT img, r, c, c - row_number() OVER (PARTITION BY img, r ORDER BY c) AS k FROM wid), runs AS MATERIALIZED (SELECT img, r, min(c) AS s, max(c) + 1 AS e, r * {L.ROW} + min(c) AS id FROM isl GROUP BY img, r, k),
walk AS (SELECT img, id AS start, id, r, s, e FROM runs UNION SELECT w.img, w.start, n.id, n.r, n.s, n.e FROM walk w JOIN runs n ON n.img = w.img AND abs(n.r - w.r) = 1 AND n.s <= w.e AND n.e >= w.s),
lab AS (SELECT img, id, r, s, e, min(start) AS root FROM walk GROUP BY ALL), box AS MATERIALIZED (SELECT img, root, min(s) AS x1, min(r) AS y1, max(e) AS x2, max(r) + 1 AS y2 FROM lab GROUP BY ALL),
gap AS (SELECT img, r, c, c - row_number() OVER (PARTITION BY img, r ORDER BY c) AS k FROM gray ANTI JOIN wid USING (img, r, c)), free AS MATERIALIZED (SELECT img, r, min(c) AS s, max(c) + 1 AS e FROM gap GROUP BY img, r, k),
outside AS (SELECT * FROM free WHERE r IN (0, {H - 1}) OR s = 0 OR e = {W} UNION SELECT n.* FROM outside w JOIN free n ON n.img = w.img AND abs(n.r - w.r) = 1 AND n.s < w.e AND n.e > w.s),
ext AS (SELECT * FROM box b WHERE root < {L.ROW} OR EXISTS (SELECT 1 FROM outside o WHERE o.img = b.img AND o.r = root // {L.ROW} - 1 AND root % {L.ROW} >= o.s AND root % {L.ROW} < o.e)),
inked AS MATERIALIZED (SELECT b.img, root, x1, y1, x2, y2, count(k.c) AS ink FROM ext b LEFT JOIN bin k ON k.img = b.img AND k.r >= y1 AND k.r < y2 AND k.c >= x1 AND k.c < x2 GROUP BY ALL),
kept AS (SELECT img AS page, row_number() OVER (PARTITION BY img ORDER BY root) AS ix, x1, y1, x2, y2, ink FROM inked WHERE x2 - x1 >= 24 AND y2 - y1 BETWEEN 5 AND 120 AND (x2 - x1) * (y2 - y1) <= 0.22 * {W * H} AND ink / ((x2 - x1) * (y2 - y1))::double BETWEEN 0.035 AND 0.72)"""


@query(f"WITH RECURSIVE {PAGES}, {BOX_SQL} SELECT * FROM kept")
def text_line_boxes(spark, sf):
    """Line-like boxes of the pages as they are, with the ink inside."""
    return L.text_line_boxes(sheets(spark, sf), W, H)


def page_regions(px):
    """page, place, x1 .. y2, lines of pages of W x H pixels: their line boxes merged, split and grouped, replaced where projection columns cover them, in reading order."""
    runs = held(L.page_runs(px, W, H))
    ink = runs.filter("kind = 'ink'").groupBy(F.col("img").alias("page"), F.col("r").alias("y")).agg(F.flatten(F.collect_list(F.sequence("start", F.col("end") - 1))).alias("xs"))
    pieces = held(G.split_wide_boxes(G.merge_nearby(L.boxes_of(runs).drop("ink")), ink, W, H))
    lines = pieces.select("page", (F.col("ix") * 1000 + F.col("piece")).alias("ix"), *G.BOX)
    columns = G.projection_columns(ink, runs.filter("kind = 'page'").select(F.col("img").alias("page")), W, H)
    return G.layout_regions(lines, held(columns), W, H)


@query()
def detect_layout_regions(spark, sf):
    """Regions of the straightened pages, from their pixels."""
    return page_regions(S.deskewed(sheets(spark, sf), **HOW))


def _shares(along: str, size: int, target: int) -> str:
    """SQL: each target place with the source places that it covers and their parts."""
    a, b = f"({along}_t * {size / target!r}e0)", f"(({along}_t + 1) * {size / target!r}e0)"
    return f"s{along} AS (SELECT {along}_t, {along}, least({along} + 1, {b}) - greatest({along}, {a}) AS part FROM (SELECT unnest(range(0, {target})) AS {along}_t) CROSS JOIN (SELECT unnest(range(0, {size})) AS {along}) WHERE least({along} + 1, {b}) - greatest({along}, {a}) > 1e-9)"


@query(f"""WITH {PAGES}, {_shares('c', W, 50)}, {_shares('r', H, 31)}
SELECT img, r_t AS r, c_t AS c, least(255, greatest(0, floor(round(sum(v * sr.part * sc.part) / sum(sr.part * sc.part), 6) + 0.5)))::int AS v FROM gray g JOIN sc ON sc.c = g.c JOIN sr ON sr.r = g.r GROUP BY img, r_t, c_t""")
def area_resize(spark, sf):
    """Pages whose longer side is over 50 pixels, brought down to it."""
    return P.points(P.shrunk(sheets(spark, sf), 50))


def _glyphs(word: str) -> str:
    return f"coalesce(list_sum(list_transform(list_filter(string_split({word}, ''), lambda x: x <> ''), lambda x: coalesce({WRAP.WIDTHS}[unicode(x) - 31], {WRAP.OTHER}))), 0)"


@query(f"""WITH RECURSIVE p AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS para, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, ix, unnest(string_split(para, ' ')) AS word, generate_subscripts(string_split(para, ' '), 1) AS k FROM p), m AS MATERIALIZED (SELECT *, {_glyphs('word')} AS wide FROM w),
f AS (SELECT conv_id, turn, ix, k, 0 AS line, word, wide FROM m WHERE k = 1 UNION ALL SELECT m.conv_id, m.turn, m.ix, m.k, CASE WHEN f.wide + {WRAP.BLANK} + m.wide <= {WRAP.LINE} THEN f.line ELSE f.line + 1 END, m.word, CASE WHEN f.wide + {WRAP.BLANK} + m.wide <= {WRAP.LINE} THEN f.wide + {WRAP.BLANK} + m.wide ELSE m.wide END
  FROM f JOIN m ON m.conv_id = f.conv_id AND m.turn = f.turn AND m.ix = f.ix AND m.k = f.k + 1),
l AS (SELECT conv_id, turn, ix, line, string_agg(word, ' ' ORDER BY k) AS text FROM f GROUP BY ALL), n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ix, line) - 1 AS line_no, text FROM l)
SELECT conv_id, line_no, text, CASE WHEN line_no < 38 THEN 1 ELSE 2 + (line_no - 38) // 39 END AS page_no, CASE WHEN line_no < 38 THEN 20 + 7 * line_no ELSE 15 + 7 * ((line_no - 38) % 39) END AS y FROM n""")
def wrapped_export(spark, sf):
    """Each conversation as a document of wrapped lines on numbered pages."""
    c = table(spark, sf, "conversations").filter("text is not null")
    paragraphs = c.select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("ix", "para"))
    lines = paragraphs.select("conv_id", "turn", "ix", F.posexplode(WRAP.wrapped("para")).alias("line", "text"))
    line_no = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "ix", "line")).cast("long") - 1
    return lines.select("conv_id", line_no.alias("line_no"), "text").withColumns({"page_no": WRAP.page_of(F.col("line_no")), "y": WRAP.top_of(F.col("line_no"))})


FIXED = QUALITY.replace("coalesce(text, '')", "regexp_replace(coalesce(text, ''), '[#*$%&|<>!]', '', 'g')").replace("(doc_id % 101) / 100.0 AS conf", "least(1.0, (doc_id % 101) / 100.0 + 0.1) AS conf")
LEVEL = QUALITY.replace("coalesce(text, '')", "lower(coalesce(text, ''))").replace("(doc_id % 101) / 100.0 AS conf", "(doc_id % 101) / 200.0 AS conf")


@query(f"""WITH a AS (WITH {QUALITY} SELECT page_id, score, confidence, character_count, 'grayscale_deskew' AS variant, 0 AS ordinal FROM quality), b AS (WITH {FIXED} SELECT page_id, score, confidence, character_count, 'safe_enhanced' AS variant, 1 AS ordinal FROM quality),
c AS (WITH {LEVEL} SELECT page_id, score, confidence, character_count, 'configured_preprocessing' AS variant, 2 AS ordinal FROM quality),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE page_id NOT IN (SELECT page_id FROM a WHERE score >= 0.80) UNION ALL SELECT * FROM c WHERE page_id NOT IN (SELECT page_id FROM a WHERE score >= 0.80))
SELECT page_id, variant, score, count(*) OVER (PARTITION BY page_id) AS n_variants, score < 0.62 AS vision_attempted FROM u QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, confidence DESC, character_count DESC, ordinal) = 1""")
def adaptive_variants(spark, sf):
    """Pages read as they are, then again as far as needed: without symbols, and in small letters with half the confidence. The best reading, and whether a vision model is asked."""
    conf = F.col("confidence")
    read = lambda change: lambda rows: Q.page_quality(change(rows)).withColumn("strategy", F.lit("tesseract")).select("page_id", "score", "confidence", "character_count", "strategy")
    steps = [
        WAVES.Variant("grayscale_deskew", {"remove_colors": False, "denoise": False}, read(lambda d: d)),
        WAVES.Variant("safe_enhanced", {"remove_colors": False}, read(lambda d: d.withColumns({"text": F.regexp_replace("text", "[#*$%&|<>!]", ""), "confidence": F.least(F.lit(1.0), conf + 0.1)}))),
        WAVES.Variant("configured_preprocessing", {"remove_colors": True}, read(lambda d: d.withColumns({"text": F.lower("text"), "confidence": conf / 2}))),
    ]
    found = WAVES.candidates(documents(spark, sf), ["page_id"], steps)
    n = F.count("*").over(Window.partitionBy("page_id"))
    best = WAVES.best(found.withColumn("n_variants", n), ["page_id"])
    return best.select("page_id", "variant", "score", "n_variants", WAVES.vision_attempted(F.col("score"), F.array()).alias("vision_attempted"))


@query(f"""WITH {QUALITY}, l AS (SELECT l_orderkey AS page_id, count(*) AS regions FROM lineitem GROUP BY 1)
SELECT page_id, coalesce(regions, 0) > 0 AND (regions >= 5 OR confidence < 0.85) AS layout_attempted, score < 0.68 AND character_count >= 80 AND ((latin_characters >= 80 AND devanagari_characters <= greatest(12, trunc(0.18 * latin_characters))) OR (single_character_token_ratio >= 0.32 AND confidence < 0.58) OR (valid_character_ratio < 0.72 AND confidence < 0.55)) AS early_vision,
  score < 0.62 AS late_vision FROM quality LEFT JOIN l USING (page_id)""")
def attempt_predicates(spark, sf):
    """Which further readings a page gets: by regions (the boxes of its order; five make it complex), by a vision model at once, or at the end."""
    regions = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.count("*").alias("regions"))
    q = Q.page_quality(documents(spark, sf)).join(regions, "page_id", "left")
    return q.select(
        "page_id",
        WAVES.layout_attempted(F.col("regions"), F.col("regions") >= 5, F.col("confidence")).alias("layout_attempted"),
        (F.size(Q.wrong_script_reasons(None)) > 0).alias("early_vision"),
        WAVES.vision_attempted(F.col("score"), F.array()).alias("late_vision"),
    )


@query("""SELECT sha256('document' || chr(31) || doc_id) AS id, lang || '-' || doc_id || '.png' AS original_filename, 'Completed' AS status, sha256('ocr' || chr(31) || doc_id) AS ocr_id, length(text) AS characters, round((doc_id % 101) / 100.0::double, 4) AS confidence, sha256('translation' || chr(31) || doc_id) AS translation_id, lower(text) AS translated_text, source AS model_used FROM documents""")
def unit_of_work(spark, sf):
    """Documents, their extractions and translations, written as two units of work, each of them twice, and read back from what was published."""
    d = table(spark, sf, "documents")
    root = own_folder(spark, "units")
    conf = (F.col("doc_id") % 101) / 100.0
    for name, part in (("labelled", "left_semi"), ("others", "left_anti")):
        rows = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", part)
        made = unit.consolidated(rows, "doc_id", F.concat("lang", F.lit("-"), "doc_id", F.lit(".png")), F.col("text"), conf, F.lower("text"), F.col("source"))
        made = {k: files.typed(v, k) for k, v in made.items()}
        for _ in range(2):  # the second time nothing is written
            unit.publish(root, name, made)
    docs, ocr, translated = (unit.read(spark, root, t, files.TABLES[t]) for t in ("documents", "ocr_results", "translations"))
    ocr = ocr.select(F.col("document_id").alias("id"), F.col("id").alias("ocr_id"), F.length("extracted_text").alias("characters"), F.round("confidence", 4).alias("confidence"))
    translated = translated.select(F.col("document_id").alias("id"), F.col("id").alias("translation_id"), "translated_text", "model_used")
    return docs.select("id", "original_filename", "status").join(ocr, "id").join(translated, "id")


@query("""SELECT md5('d' || doc_id)::uuid::varchar AS id, lang || '.png' AS original_filename, md5('o' || doc_id)::uuid::varchar AS ocr_id, text AS extracted_text FROM documents""")
def revised_tables(spark, sf):
    """Stored documents and extractions after their ids became UUIDs, were taken back and became UUIDs again."""
    root, d = own_folder(spark, "revisions"), table(spark, sf, "documents")
    hexes = lambda kind: F.md5(F.concat(F.lit(kind), F.col("doc_id")).cast("binary"))
    raw = F.when(F.col("doc_id") % 2 == 0, F.upper(hexes("d"))).otherwise(files.dashed(hexes("d")))
    rows = {
        "documents": files.typed(d.select(raw.alias("id"), F.concat("lang", F.lit(".png")).alias("original_filename"), F.lit("Completed").alias("status")), "documents"),
        "ocr_results": files.typed(d.select(hexes("o").alias("id"), raw.alias("document_id"), F.col("text").alias("extracted_text")), "ocr_results"),
    }
    filled = revisions.Revision("rows", lambda spark, had: had | rows, lambda spark, had: had)
    empty, created, ids = revisions.REVISIONS
    for to in ("uuid ids", "rows", "uuid ids"):
        revisions.migrate(spark, root, [empty, created, filled, ids], to)
    now = revisions.tables(spark, root)
    ocr = now["ocr_results"].select(F.col("document_id").alias("id"), F.col("id").alias("ocr_id"), "extracted_text")
    return now["documents"].select("id", "original_filename").join(ocr, "id")
