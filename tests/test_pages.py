"""Pages of pixels, units of work, live sessions, waves, wrapped lines and bodies against plain computations."""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sheafmill.functions import bodies as B
from sheafmill.functions import wrap
from sheafmill.operators import geometry as G
from sheafmill.operators import lines as L
from sheafmill.operators import raster as P
from sheafmill.operators import skew as S
from sheafmill.operators import waves
from sheafmill.plans import page_plans
from sheafmill.sources import files, providers, revisions, unit
from sheafmill.streaming import sessions


def pixels_of(spark, pages: dict[int, np.ndarray]):
    frames = []
    for k, a in pages.items():
        r, c = np.indices(a.shape)
        frames.append(pd.DataFrame({"img": k, "r": r.ravel(), "c": c.ravel(), "v": a.ravel()}))
    return spark.createDataFrame(pd.concat(frames)).selectExpr("cast(img as long) img", "cast(r as int) r", "cast(c as int) c", "cast(v as int) v").repartition(4)


def image(df, k: int, shape) -> np.ndarray:
    out = np.full(shape, -1)
    for r in df[df.img == k].itertuples():
        out[r.r, r.c] = r.v
    return out


def ruled(degrees: float, h: int = 120, w: int = 240) -> np.ndarray:
    a = np.full((h, w), 255)
    for k in range(2):
        for x in range(10, w - 10):
            y = round(45 + 35 * k + math.tan(math.radians(degrees)) * (x - w / 2))
            a[y : y + 3, x] = 0
    return a


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    h, w = a.shape
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))

    def weight(d):
        d = np.abs(d)
        return np.where(d <= 1, 1.25 * d**3 - 2.25 * d**2 + 1, np.where(d < 2, -0.75 * d**3 + 3.75 * d**2 - 6 * d + 3, 0))

    r, c = np.indices(a.shape)
    x, y = cos * (c - w // 2) - sin * (r - h // 2) + w // 2, sin * (c - w // 2) + cos * (r - h // 2) + h // 2
    x, y = np.floor(x * 32 + 0.5) / 32, np.floor(y * 32 + 0.5) / 32
    fx, fy, total = np.floor(x), np.floor(y), 0
    for i in range(-1, 3):
        for j in range(-1, 3):
            total = total + a[np.clip(fy + i, 0, h - 1).astype(int), np.clip(fx + j, 0, w - 1).astype(int)] * weight(y - fy - i) * weight(x - fx - j)
    return np.clip(np.floor(np.round(total, 6) + 0.5), 0, 255).astype(int)


def test_deskew(spark):
    want = {1: 3.3, 2: -7.6, 3: 12.2, 4: 0.1}
    px = pixels_of(spark, {k: ruled(d) for k, d in want.items()} | {5: np.full((20, 30), 255)})
    found = {r.img: r.degrees for r in S.angles(px, votes=60).collect()}
    assert set(found) == {1, 2, 3} and all(abs(found[k] - want[k]) <= 0.3 for k in found)
    out = S.rotated(px, spark.createDataFrame([(1, found[1]), (3, found[3])], "img long, degrees double")).toPandas()
    for k in (1, 3):
        assert (image(out, k, (120, 240)) == turned(ruled(want[k]), found[k])).all()
    assert (image(out, 2, (120, 240)) == ruled(want[2])).all() and (image(out, 5, (20, 30)) == 255).all()
    none = px.filter("img > 9")
    assert S.angles(none).count() == 0 and S.deskewed(none).count() == 0


def test_a_weak_edge_counts_where_a_strong_one_reaches_it(spark):
    a = np.full((12, 30), 200)
    a[6:, :10] = 100  # steps of 100, and of 30 beside it
    a[6:, 10:] = 170
    b = np.full((12, 30), 200)
    b[6:, :] = 170
    found = S.edges(pixels_of(spark, {1: a, 2: b})).toPandas()
    assert {(r.r, r.c) for r in found[found.img == 1].itertuples()} >= {(5, c) for c in (*range(1, 9), *range(12, 29))}
    assert not len(found[found.img == 2])


def test_components_of_runs(spark):
    a = (np.random.default_rng(1).random((50, 150)) < 0.45) * 255
    r, c = np.indices(a.shape)
    labels = np.where(a > 0, r * 150 + c, 10**9)
    while True:
        wide = np.pad(labels, 1, constant_values=10**9)
        least = np.min([wide[1 + i : 51 + i, 1 + j : 151 + j] for i in (-1, 0, 1) for j in (-1, 0, 1)], axis=0)
        least = np.where(a > 0, least, 10**9)
        if (least == labels).all():
            break
        labels = least
    got = {(x.r, x.c): x.label for x in L.labelled_pixels(pixels_of(spark, {7: a})).collect()}
    assert got == {(i, j): labels[i, j] for i, j in zip(*np.nonzero(a), strict=True)}
    assert L.labelled_pixels(pixels_of(spark, {7: a * 0})).count() == 0


def test_what_lies_in_a_hole_is_no_box_of_its_own(spark):
    a = np.zeros((40, 90), dtype=int)
    a[5, 5:60] = a[30, 5:60] = a[5:31, 5] = a[5:31, 59] = 255  # a frame
    a[15:18, 20:40] = 255  # inside it
    a[10:14, 70:85] = 255  # beside it
    px = pixels_of(spark, {1: a})
    runs = L.labelled_runs(L.dark_runs(px, F.col("v") > 0))
    boxes = L.component_boxes(runs).join(L.outermost(runs, L.sizes(px)), ["img", "root"], "left_semi")
    assert {(b.x1, b.y1, b.x2, b.y2) for b in boxes.collect()} == {(5, 5, 60, 31), (70, 10, 85, 14)}
    counted = L.ink_in(L.component_boxes(runs).drop("ink").withColumnRenamed("root", "ix"), L.dark_runs(px, F.col("v") > 0)).collect()
    assert all(b.ink == (a[b.y1 : b.y2, b.x1 : b.x2] > 0).sum() for b in counted) and len(counted) == 3


def test_area_resize(spark):
    rng = np.random.default_rng(2)
    pages = {1: rng.integers(0, 256, (33, 57)), 2: rng.integers(0, 256, (20, 9)), 3: rng.integers(0, 256, (50, 20))}
    got = P.shrunk(pixels_of(spark, pages), 24).toPandas()
    for k, a in pages.items():
        h, w = a.shape
        s = min(1.0, 24 / max(h, w))
        th, tw = (int(h * s), int(w * s)) if s < 1 else (h, w)
        cover = lambda n, t: np.array([[max(0.0, min(i + 1, (j + 1) * n / t) - max(i, j * n / t)) for i in range(n)] for j in range(t)])
        want = (cover(h, th) @ a @ cover(w, tw).T) / (h / th * w / tw)
        assert np.abs(image(got, k, (th, tw)) - want).max() <= 0.5 + 1e-6


def test_even_kernels(spark):
    a = np.random.default_rng(3).integers(0, 256, (190, 5))
    a[20:150, 1] = 3
    a[60:185, 3] = 0
    px = pixels_of(spark, {1: a})

    def over(v, fn, size, times):
        lo, hi = -(size // 2) * times, (size - 1 - size // 2) * times
        return np.array([[fn(v[max(0, r + lo) : r + hi + 1, c]) for c in range(v.shape[1])] for r in range(v.shape[0])])

    for size, times, got in ((50, 2, P.without_vertical_noise(px, 50)), (80, 3, P.without_sidebar_noise(px, 1.0, 80))):
        opened = over(over(255 - a, np.min, size, times), np.max, size, times)
        assert (image(got.toPandas(), 1, a.shape) == np.where(opened > 0, 255, a)).all()


def test_a_unit_is_there_as_a_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "store")
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    made = lambda d: {k: files.typed(v, k) for k, v in unit.consolidated(d, "doc_id", F.lit("n"), F.col("text"), F.lit(0.5), F.upper("text"), F.lit("m")).items()}
    counts = lambda: [unit.read(spark, root, t, files.TABLES[t]).count() for t in ("documents", "ocr_results", "translations")]
    assert counts() == [0, 0, 0]
    broken = made(docs)
    broken["translations"] = broken["translations"].withColumn("status", F.raise_error(F.lit("killed between the second and the third table")).cast("string"))
    with pytest.raises(PySparkException):
        unit.publish(root, "batch-1", broken)
    assert counts() == [0, 0, 0] and (tmp_path / "store" / "_staged" / "batch-1").exists()
    assert unit.publish(root, "batch-1", made(docs)) and counts() == [2, 2, 2]
    assert not unit.publish(root, "batch-1", made(docs)) and counts() == [2, 2, 2]  # the batch comes again
    folders = unit.stage(root, "batch-1", made(docs))  # two attempts at once: the second to seal is no part of the table
    assert not unit.seal(spark, root, "batch-1", folders) and counts() == [2, 2, 2]
    assert unit.vacuum(spark, root) == 2 and counts() == [2, 2, 2]
    assert {r.status for r in unit.read(spark, root, "documents", files.TABLES["documents"]).collect()} == {"Completed"}
    (tmp_path / "file").write_text("no folder")
    status = unit.publish_or_skip(str(tmp_path / "file"), "batch-2", made(docs))
    told = unit.answered(docs, status, "not saved").first()
    assert (status, told.persistence_status, told.warning) == ("skipped", "skipped", "not saved")


def test_live_sessions(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "out", "state")}
    put = lambda rows: spark.createDataFrame(rows, sessions.EVENT).coalesce(1).write.mode("append").parquet(at["in"])
    out = lambda: sessions.read_results(spark, at["out"])

    def until(condition: str, n: int) -> None:
        began = time.time()
        while out().filter(condition).count() < n:
            assert time.time() - began < 120 and live.isActive, condition
            time.sleep(0.5)

    a, b = "a" * 100, "b" * 100
    put([(1, 0, None, "chunk", a), (1, 1, None, "chunk", "short"), (2, 0, None, "chunk", a), (2, 1, None, "done", None)])
    results = sessions.transcribe(sessions.read_events(spark, at["in"]), timeout_ms=12_000)
    live = sessions.write_results(results, at["out"], at["state"], processingTime="1 second")
    until("kind = 'segment'", 2)
    put([(1, 0, None, "chunk", a), (1, 2, None, "chunk", b), (2, 0, None, "chunk", a), (2, 5, None, "chunk", b)])  # sent again, and after the end
    until("session_id = 1 and kind = 'segment'", 2)
    until("kind = 'error'", 1)
    live.stop()
    got = [(r.session_id, r.chunk_index, r.kind, r.text, r.is_final) for r in out().orderBy("session_id", "batch_id", "chunk_index", "is_final").collect()]
    assert got == [(1, 1, "segment", a, False), (1, 2, "segment", a + b, False), (1, 2, "error", sessions.TIMED_OUT, True), (2, 1, "segment", a, False), (2, 1, "done", a, True)]


def test_later_variants_run_only_for_what_is_open(spark):
    rows = [(1, 0.9, "t"), (2, 0.5, "t"), (3, 0.5, "gemini_vision_m"), (4, 0.7, "t"), (4, 0.1, "t")]
    pages = spark.createDataFrame(rows, "page_id long, score double, strategy string").withColumns({"confidence": F.lit(0.5), "character_count": F.lit(9)})
    worked: dict[str, list[int]] = {}

    def variant(name, settings, gain=0.0):
        def work(rest):
            worked[name] = sorted(r.page_id for r in rest.collect())
            return rest.withColumn("score", F.col("score") + gain)

        return waves.Variant(name, settings, work)

    steps = [variant("first", {"a": 1}), variant("second", {"a": 2}, 0.4), variant("again", {"a": 2, "debug": True}), variant("third", {"a": 3}, 0.1)]
    found = waves.candidates(pages, ["page_id"], steps)
    assert worked == {"first": [1, 2, 3, 4, 4], "second": [2, 4, 4], "third": [2, 4, 4]}  # a strong later variant settles nothing
    assert {r.page_id: r.variant for r in waves.best(found, ["page_id"]).collect()} == {1: "first", 2: "second", 3: "first", 4: "second"}
    assert waves.candidates(pages, ["page_id"], []) is None
    strong = waves.candidates(pages.filter("page_id = 1"), ["page_id"], steps)
    assert strong.count() == 1


def plain_wrap(paragraph: str, width: int) -> list[str]:
    size = lambda t: sum(wrap.WIDTHS[ord(c) - 32] if 32 <= ord(c) < 127 else wrap.OTHER for c in t)
    words = []
    for w in paragraph.split(" "):
        piece = ""
        for c in w:
            if piece and size(piece + c) > width:
                words.append(piece)
                piece = ""
            piece += c
        words.append(piece)
    out = [words[0]]
    for w in words[1:]:
        if size(out[-1]) + wrap.BLANK + size(w) <= width:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def test_wrapped_lines(spark):
    texts = ["", "one", "several words that go on for some time and more", "x" * 90, "a " + "W" * 40 + " é b", "  two  blanks ", "नमस्ते कति " * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for width in (3000, 9000, wrap.LINE):
        assert [r[0] for r in df.select(wrap.wrapped("t", width)).collect()] == [plain_wrap(t, width) for t in texts]
    lines = spark.range(200).select(wrap.page_of(F.col("id")).alias("p"), wrap.top_of(F.col("id")).alias("y")).collect()
    page, y, want = 1, 20, []
    for _ in range(200):
        if y > 297 - 15:
            page, y = page + 1, 15
        want.append((page, y))
        y += 7
    assert [tuple(r) for r in lines] == want


@pytest.mark.parametrize(
    ("body", "kind", "texts", "reason"),
    [
        ('{"text": "a"}', "string", ["a"], None),
        ('{"text": " \\n"}', "string", [" \n"], B.EMPTY_TEXT),
        ('{"text": ["", "b", 3, null, ["c"]]}', "list", ["", "b"], None),
        ('{"text": [1, " "]}', "list", [" "], B.EMPTY_LIST),
        ('{"text": []}', "list", [], B.EMPTY_LIST),
        ('{"text": true}', "other", [], B.NO_TEXT),
        ('{"text": null}', "other", [], B.NO_TEXT),
        ("[]", "other", [], B.NO_TEXT),
        ("no json", "other", [], B.NO_TEXT),
        (None, "other", [], B.NO_TEXT),
    ],
)
def test_bodies(spark, body, kind, texts, reason):
    q = spark.createDataFrame([(body,)], "b string").select(B.request_texts(F.col("b")).alias("q")).select("q.*", B.rejection(F.col("q.kind"), F.col("q.texts")).alias("why")).first()
    assert (q.kind, q.texts, q.why) == (kind, texts, reason)


def test_revisions_go_up_and_down(spark, tmp_path):
    root = str(tmp_path)
    ids = [f"{i:032X}" for i in range(3)]
    rows = lambda had: had | {"documents": files.typed(spark.createDataFrame([(i, "n") for i in ids], "id string, original_filename string"), "documents")}
    empty, created, uuids = revisions.REVISIONS
    steps = [empty, created, revisions.Revision("rows", lambda s, had: rows(had), lambda s, had: had), uuids]
    seen = lambda: {k: sorted(map(tuple, v.collect())) for k, v in revisions.tables(spark, root).items()}
    assert revisions.migrate(spark, root, steps, "uuid ids") == ["up empty", "up tables", "up rows", "up uuid ids"]
    up = seen()
    assert [r[0] for r in up["documents"]] == [f"00000000-0000-0000-0000-{i:012d}" for i in range(3)] and set(up) == set(revisions.IDS)
    assert revisions.migrate(spark, root, steps, "rows") == ["down uuid ids"]
    revisions.migrate(spark, root, steps, "uuid ids")
    assert seen() == up
    assert revisions.migrate(spark, root, steps, None)[-1] == "down empty" and seen() == {}
    assert [e["revision"] for e in revisions.ledger(spark, root)][-3:] == ["tables", "empty", None]
    ids[1] = "not a uuid"
    with pytest.raises(PySparkException):
        revisions.migrate(spark, root, steps, "uuid ids")
    assert revisions.current(spark, root)["revision"] == "rows" and [r[0] for r in seen()["documents"]] == sorted(ids)
    n = len(revisions.ledger(spark, root))
    with pytest.raises(RuntimeError):  # another step was first
        revisions._enter(spark, root, {"number": n, "revision": "x", "tables": {}})
    before = seen()
    assert revisions.vacuum(spark, root) > 0 and seen() == before


def test_boxes_meet_on_the_grid_once(spark):
    rng = np.random.default_rng(4)
    boxes = [(int(p), i, int(x), int(y), int(x + w), int(y + h)) for i, (p, x, y, w, h) in enumerate(rng.integers([0, -200, -200, 0, 0], [2, 500, 500, 300, 200], (120, 5)))] + [(0, 500, None, 1, 2, 3)]
    df = spark.createDataFrame(boxes, "page int, ix int, x1 int, y1 int, x2 int, y2 int")
    pairs = [(r.a_ix, r.b_ix) for r in G.overlapping(G.named(df, "a_"), G.named(df, "b_")).collect()]
    shared = lambda a, b: a[0] == b[0] and None not in a + b and min(a[4], b[4]) > max(a[2], b[2]) and min(a[5], b[5]) > max(a[3], b[3])
    assert sorted(pairs) == sorted((a[1], b[1]) for a in boxes for b in boxes if shared(a, b))


def test_files_that_cannot_be_read_are_rows_of_their_own(spark):
    found = spark.createDataFrame([("a.docx", ".docx", b"x"), ("b.doc", ".doc", b"y"), ("c.pdf", ".pdf", b"z")], "path string, ext string, content binary")
    assert {(r.path, r.ok) for r in files.word_pages(found).collect()} == {("a.docx", False), ("b.doc", False)}

    def draw(content, dpi):
        if content == b"x":
            raise ValueError("broken")
        return [content, content]

    rows = providers.page_images(found, draw).collect()
    assert {(r.path, r.page_no, r.error) for r in rows} == {("a.docx", None, "broken"), ("b.doc", 0, None), ("b.doc", 1, None), ("c.pdf", 0, None), ("c.pdf", 1, None)}


def test_regions_of_a_page_from_its_pixels(spark):
    page = np.full((page_plans.H, page_plans.W), 255)
    for top in (6, 14, 22, 56, 64):  # two blocks of lines, the second to the right
        left = 4 if top < 40 else 60
        for x in range(left, left + 60, 5):
            page[top : top + 5, x : x + 2] = 0
    found = page_plans.page_regions(pixels_of(spark, {3: page, 4: np.full((page_plans.H, page_plans.W), 255)})).orderBy("place").collect()
    assert [(r.page, r.place, r.lines) for r in found] == [(3, 0, 3), (3, 1, 2)]
    assert all(abs(a - b) <= 1 for r, (top, end) in zip(found, [(6, 27), (56, 69)], strict=True) for a, b in ((r.y1, top), (r.y2, end)))
    assert found[0].x1 < 10 and found[1].x1 > 50
