"""Plans whose cost must grow no faster than their input: what is exchanged, what is broadcast, and calls a page."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafmill.operators import geometry as G
from sheafmill.operators import lines as L
from sheafmill.operators import raster as P
from sheafmill.operators import skew as S
from sheafmill.plans import page_plans, registry

#: Queries on pages of pixels, and the exchanges that they may have: vectors by page, and small rows of a page after that.
PAGES = {"page_edges": 1, "area_resize": 1, "skew_lines": 4, "deskew_pages": 3}
TABLES = ["projection_columns", "text_line_boxes", "detect_layout_regions"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["line_reconstruction", "word_table_pages"])
def test_no_word_is_exchanged(spark, sf, name):
    plan = plan_of(registry.queries()[name](spark, sf))
    assert "Exchange" not in plan and "Generate" not in plan


def test_texts_of_blocks_where_lines_and_blocks_are_empty(spark, tmp_path):
    rows = [(1, "a  b\n \nc\n\n\n\nd"), (2, " \n "), (3, None), (4, "\n\n\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in registry.queries()["line_reconstruction"](spark, str(tmp_path)).collect()}
    assert got == {1: "a b\nc\n\nd", 4: "x"}
    got = {r.doc_id: (r.text, r.n_words) for r in registry.queries()["word_table_pages"](spark, str(tmp_path)).collect()}
    assert got == {1: ("a b\nc\n\nd", 4), 2: ("", 0), 3: ("", 0), 4: ("x", 1)}


@pytest.mark.parametrize("name", ["group_lines", "reading_order"])
def test_many_small_pages_take_no_call_each(spark, name):
    page = F.floor(F.col("id") / 3)
    x = F.col("id") * 37 % 600
    boxes = spark.range(120_000).select(page.alias("page"), (F.col("id") % 3).alias("ix"), x.alias("x1"), (F.col("id") % 3 * 25).alias("y1"), (x + 200).alias("x2"), (F.col("id") % 3 * 25 + 20).alias("y2"))
    began = time.time()
    out = G.group_lines(boxes, 1000, 1400) if name == "group_lines" else G.reading_order(boxes, 1000)
    assert "FlatMapGroups" not in plan_of(out)
    assert out.count() == 120_000 and out.select("page").distinct().count() == 40_000
    assert time.time() - began < 60


def test_pages_of_pixels_go_by_page_without_an_exchange_of_pixels(spark, sf):
    for name in PAGES:
        plan = plan_of(registry.queries()[name](spark, sf))
        assert "BroadcastExchange" not in plan and "Window" not in plan, name
        assert plan.count("Exchange hashpartitioning") <= PAGES[name], name


def test_no_estimate_of_pixels_decides_a_broadcast(spark, sf):
    for name in TABLES:
        assert "BroadcastExchange" not in plan_of(registry.queries()[name](spark, sf)), name


def test_ink_of_a_page_equals_ink_by_windows(spark):
    rng = np.random.default_rng(5)
    for h, w in ((9, 14), (70, 60), (1, 8)):
        v = rng.integers(0, 256, (h, w))
        rows = [(1, r, c, int(v[r, c])) for r in range(h) for c in range(w)]
        got = {(x.r, x.c) for x in P.adaptive_ink(spark.createDataFrame(rows, "img long, r int, c int, v int")).filter("v > 0").collect()}
        assert got == set(zip(*(a.tolist() for a in np.nonzero(P.ink_mask(v.astype(float)))), strict=True))


def test_lines_and_points_of_a_raster_with_nulls(spark):
    rows = [(1, 0, 0, 5), (1, 0, 1, None), (1, 1, 0, 7), (1, 1, 1, 9), (1, 1, 1, 9)]  # one pixel twice
    px = spark.createDataFrame(rows, "img long, r int, c int, v int")
    assert {tuple(x) for x in P.points(P.lines(px)).collect()} == set(rows)
    assert {tuple(x) for x in P.shrunk(px, 9).collect()} == set(rows)
    assert [x.v for x in P.shrunk(px, 1).collect()] == [7]
    assert P.shrunk(px.limit(0), 9).count() == 0 and L.text_line_boxes(px.limit(0), 9, 9).count() == 0


def test_votes_and_links_are_no_rows(spark):
    rows = [(1, r, c, 0 if r in (20, 21, 22) else 255) for r in range(40) for c in range(60)]
    px = spark.createDataFrame(rows, "img long, r int, c int, v int")
    found = S.segments(S.edges(px), L.sizes(px), votes=30)
    assert "Generate" not in plan_of(found) and {round(x.slope, 6) for x in found.collect()} == {0.0}
    runs = L.labelled_runs(L.dark_runs(px, F.col("v") < 128))  # three rows of one component
    assert "Join" not in plan_of(runs) and {x.root for x in runs.collect()} == {20 * L.ROW}


def test_a_page_is_a_row_from_its_pixels_to_its_segments(spark, sf):
    plan = plan_of(registry.queries()["skew_lines"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and not any(x in plan for x in ("FlatMapGroups", "Join", "Generate"))
    a = np.full((60, 150), 255)
    for x in range(5, 140):
        a[20 + x // 12, x] = a[21 + x // 12, x] = a[45, x] = a[46, x] = 0
    rows = [(1, r, c, int(a[r, c])) for r in range(60) for c in range(150)] + [(2, r, c, 255) for r in range(9) for c in range(9)]
    px = spark.createDataFrame(rows, "img long, r int, c int, v int")
    found = S.level_lines(P.whole(px), votes=60, gap=12).collect()
    assert len(found) > 2 and set(found) == set(S.segments(S.edges(px), L.sizes(px), votes=60, gap=12).collect())
    assert {tuple(x) for x in L.sizes(P.whole(px)).collect()} == {(1, 60, 150), (2, 9, 9)}


def test_forms_of_a_raster_give_the_same(spark):
    rng = np.random.default_rng(3)
    rows = [(k, r, c, int(rng.integers(0, 256))) for k in range(300) for r in range(6) for c in range(7)] + [(900, 4, 0, 7), (900, 4, 1, None)]  # four lines missing
    px = spark.createDataFrame(rows, "img long, r int, c int, v int")
    want = {tuple(x) for x in S.edges(px).collect()}
    assert want and want == {tuple(x) for x in S.edges(P.lines(px)).collect()} == {tuple(x) for x in S.edges(P.whole(px)).collect()}
    assert {tuple(x) for x in P.points(P.whole(px)).collect()} == set(rows)
    assert P.shrunk(P.whole(px), 5).columns == ["img", "lines"] and P.shrunk(P.lines(px), 5).columns == ["img", "r", "line"]


def test_boxes_of_a_page_equal_boxes_from_tables_of_runs(spark, sf):
    plan = plan_of(registry.queries()["text_line_boxes"](spark, sf))
    assert plan.count("Exchange hashpartitioning") <= 2 and not any(x in plan for x in ("FlatMapGroups", "Join", "Scan ExistingRDD"))
    rng, rows, want = np.random.default_rng(8), [], set()
    for k, share in enumerate((0.0, 0.3, 0.45, 0.6, 1.0)):
        on = rng.random((40, 90)) < share
        on[5:30, 20] = on[5:30, 60] = on[5, 20:60] = on[29, 20:60] = share > 0  # a frame
        on[6:29, 21:60] &= rng.random((23, 39)) < 0.2
        rows += [(k, int(r), int(c)) for r, c in zip(*np.nonzero(on), strict=True)]
        want |= {(k, *map(int, b)) for b in zip(*L.outer_boxes(on, on), strict=True)}
    px = spark.createDataFrame(rows, "img long, r int, c int")
    dark, pages = L.dark_runs(px, F.lit(True)), spark.createDataFrame([(k, 40, 90) for k in range(5)], "img long, h int, w int")
    runs = L.labelled_runs(dark)
    boxes = L.component_boxes(runs).drop("ink").join(L.outermost(runs, pages), ["img", "root"], "left_semi").withColumnRenamed("root", "ix")
    assert want == {(b.img, b.x1, b.y1, b.x2, b.y2, b.ink) for b in L.ink_in(boxes, dark).collect()} and len(want) > 100


def test_reading_order_takes_sorted_regions_across_batches(spark):
    rng, rows = np.random.default_rng(6), []
    for page in [*range(40), None, 41]:
        for ix in range(700 if page == 41 else int(rng.integers(1, 30))):
            x, y, w = (int(rng.integers(0, n)) for n in (900, 1300, 800))
            rows.append((page, ix, x, y, x + w if rng.random() > 0.1 else None))
    boxes = spark.createDataFrame(rows, "page long, ix int, x1 int, y1 int, x2 int")
    plan = plan_of(G.reading_order(boxes, 1000))
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    want = set()
    for page in {r[0] for r in rows}:
        own, band, at = sorted([r for r in rows if r[0] == page], key=lambda r: (r[3], r[2], r[1])), 0, 0
        bands = {}
        for r in own:
            wide = r[4] is not None and r[4] - r[2] >= 680
            band += wide
            bands.setdefault(band, ([], []))[0 if wide else 1].append(r)
        for _, (wide, narrow) in sorted(bands.items()):
            columns = []
            for r in sorted(narrow, key=lambda r: (r[2], r[3], r[1])):
                fits = [c for c in columns if r[4] is not None and c[1] is not None and abs((r[2] + r[4]) / 2 - (c[0] + c[1]) / 2) <= 0.45 * max(c[1] - c[0], r[4] - r[2])]
                if fits:
                    fits[0][1] = max(fits[0][1], r[4])
                    fits[0][2].append(r)
                else:
                    columns.append([r[2], r[4], [r]])
            for r in [*wide, *(r for c in columns for r in sorted(c[2], key=lambda r: (r[3], r[2])))]:
                want.add((page, r[1], at))
                at += 1
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (before, "50"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert {tuple(r) for r in G.reading_order(boxes, 1000).collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_pages_are_drawn_and_traced_without_a_sort_of_pixels(spark, sf, tmp_path):
    plan = plan_of(registry.queries()["page_edges"](spark, sf))
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 2 and not any(x in plan for x in ("FlatMapGroups", "Generate", "transform(shifts"))
    rows = [(8 * p + k, [float((p + k + i) % 7) for i in range(64)]) for p in (1, 4) for k in range(8)] + [(16, None), (17, [None, *map(float, range(63))]), (None, [1.0, 2.0]), (24, [])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    drawn = {x.img: np.array([y.line for y in sorted(x.lines)]) for x in page_plans.pages(spark, str(tmp_path)).collect()}
    assert set(drawn) == {None, 1, 2, 3, 4} and all(v.shape == (page_plans.H, page_plans.W) for v in drawn.values())
    assert (drawn[None] == 255).all() and (drawn[3] == 255).all() and (drawn[1] == 0).any()
    assert {int(c) // 2 for c in np.nonzero(drawn[2] == 0)[1]} <= set(range(32, 64)) and (drawn[2] == 0).any()  # the greater half of one vector


def test_no_pixel_goes_through_rows_before_the_work_on_its_page(spark, sf):
    for name in ("page_edges", "skew_lines", "text_line_boxes"):
        plan = plan_of(registry.queries()[name](spark, sf))
        assert "lines" not in plan and "collect_list" not in plan and plan.count("MapInArrow") == 2, name
    drawn = page_plans.sheets(spark, sf)
    want = {tuple(x) for x in S.edges(page_plans.pages(spark, sf)).collect()}
    assert want and want == {tuple(x) for x in S.edges(drawn).collect()} and P.like(drawn, page_plans.pages(spark, sf)).columns == list(drawn.columns)


def test_edges_of_a_stack_of_pages_equal_those_of_each_alone(spark):
    rng = np.random.default_rng(9)
    for h, w, most in ((1, 1, 256), (1, 9, 256), (7, 1, 256), (12, 15, 256), (12, 15, 90_000), (3, 40, 2049)):
        v = rng.integers(0, most, (40, h, w)) * (rng.random((40, h, w)) < 0.4)
        v[::3] //= 6  # weak edges beside strong ones of the next page
        page, r, c = S.stack_edges(v, 50, 150)
        alone = [S.page_edges(x.astype(float), 50, 150) for x in v]
        assert [*zip(page.tolist(), r.tolist(), c.tolist(), strict=True)] == [(i, *x) for i, own in enumerate(alone) for x in zip(*(a.tolist() for a in own), strict=True)]
        assert len(page) or h * w < 10
        gx, gy = S.gradients(v.astype(object))  # whole numbers of any size
        assert (gx == S.gradients(S._small(v))[0]).all() and (gy == S.gradients(S._small(v.astype(float)))[1]).all()
    assert all(not len(x) for x in S.stack_edges(np.zeros((3, 0, 0)))) and all(not len(x) for x in S.stack_edges(np.zeros((0, 5, 5), int)))
    pages = [(i, [(r, x) for r, x in enumerate(rng.integers(0, 256, (h, 9)).tolist())]) for i, h in enumerate((4, 4, 5, 0, 4))]
    pages[1][1][2] = (2, [None] * 9)
    px = spark.createDataFrame(pages, f"img long, {P.PAGE}").coalesce(1)
    want = {(i, int(r), int(c)) for i, own in pages if own for r, c in zip(*S.page_edges(np.array([x for _, x in own], float)), strict=True)}
    assert want and {tuple(x) for x in S.edges(px).collect()} == want


@pytest.mark.parametrize("kind", ["float", "double"])
def test_bits_of_a_vector_are_its_dark_numbers(spark, kind):
    rng, nan, inf = np.random.default_rng(2), float("nan"), float("inf")
    plain = [np.round(rng.normal(size=64), 2).tolist() for _ in range(50)] + [[0.0] * 64, [float(i) for i in range(64)], [-inf, *[1.0] * 62, inf], [nan, *map(float, range(63))]]
    odd = [None, [], [None] * 64, [1.0, 2.0], [None, *map(float, range(63))], [nan] * 3, [*map(float, range(90))], [5.0, None, nan, 1.0], *plain[:3]]
    for vectors in (plain, odd):
        v = spark.createDataFrame(list(enumerate(vectors)), f"line long, embedding array<{kind}>").coalesce(1).withColumn("img", F.lit(7).cast("long"))
        got = {x.line: x.bits for x in v.mapInArrow(page_plans._flagged, "img long, line long, bits long").collect()}
        for x in v.select("line", P.dark("embedding").alias("dark")).collect():
            assert got[x.line] % (1 << 64) == sum(1 << i for i, on in enumerate((x.dark or [])[:64]) if on), vectors[x.line]


def test_components_over_chains_of_runs():
    r, start, end = (np.array(x) for x in zip(*[(y, x, x + 1) for y in range(60) for x in range(0, 60, 2) if y % 3 or x % 4 == 0], strict=True))
    for reach in (0, 1):
        root = list(range(len(r)))
        for _ in range(60):
            for i in range(len(r)):
                for j in np.nonzero((np.abs(r - r[i]) == 1) & (start < end[i] + reach) & (end > start[i] - reach))[0].tolist():
                    root[i] = root[j] = min(root[i], root[j])
            if root == list(L.first_runs(r, start, end, reach)):
                break
        assert root == list(L.first_runs(r, start, end, reach))
