"""Hand-worked cases at the thresholds."""

from __future__ import annotations

import io
import random
import statistics
import struct
import wave
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from sheafmill.functions import routing as R
from sheafmill.functions import text as T
from sheafmill.functions import translit
from sheafmill.operators import geometry as G
from sheafmill.operators import lines as L
from sheafmill.operators import quality as Q
from sheafmill.operators import raster as P
from sheafmill.sources import files, providers
from sheafmill.streaming import sessions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column).first()[0]


@pytest.mark.parametrize(
    ("text", "characters", "words", "deva", "single"),
    [("", 0, 0, 0, 0), (" \t\n", 0, 0, 0, 0), ("की", 2, 1, 2, 1), ("a bc १२", 5, 3, 2, 1), ("a b", 2, 2, 0, 2), ("--- ab", 5, 2, 0, 1)],
)
def test_counts(spark, text, characters, words, deva, single):
    df = T.character_counts(spark.createDataFrame([(text,)], "t string"), F.col("t"))
    got = df.select("character_count", "word_count", "devanagari_characters", "_single", T.characters(F.col("t")), F.size(T.tokens(F.col("t")))).first()
    assert tuple(got) == (characters, words, deva, single, characters, words)


@pytest.mark.parametrize(("n", "factor"), [(39, 39 / 40), (40, 1.0), (299, 1.0), (300, 1.0)])
def test_quality_at_length_limits(spark, n, factor):
    q = Q.page_quality(spark.createDataFrame([("ab" * (n // 2) + "a" * (n % 2), 1.0)], "text string, confidence double")).first()
    assert q.score == pytest.approx(round(factor * (0.60 + 0.15 + 0.10 + 0.10 + 0.05 * min(1, n / 300)), 4), abs=1e-4)


def test_quality_of_nulls(spark):
    q = Q.page_quality(spark.createDataFrame([(None, None)], "text string, confidence double")).first()
    assert (q.score, q.character_count, q.single_character_token_ratio) == (0.0, 0, 1.0)


@pytest.mark.parametrize(("score", "status"), [(0.6199, "low"), (0.62, "medium"), (0.7999, "medium"), (0.80, "high")])
def test_bands(spark, score, status):
    assert spark.range(1).select(Q.quality_status(F.lit(score))).first()[0] == status


@pytest.mark.parametrize(("n", "chunks"), [(219, 1), (220, 1), (221, 2), (441, 3)])
def test_long_units_are_sliced(spark, n, chunks):
    found = one(spark, T.greedy_chunks(F.array("t")), t=" ".join(["w"] * n))
    assert len(found) == chunks
    assert all(len(c.split()) <= 220 for c in found)
    assert " ".join(found).split() == ["w"] * n


def test_paragraphs_come_first(spark):
    assert one(spark, T.units(F.col("t")), t="a b\nc\n\n d.") == ["a b\nc", "d."]
    assert one(spark, T.units(F.col("t")), t="One. Two! त।  च") == ["One.", "Two!", "त।", "च"]


def test_fences(spark):
    assert one(spark, T.clean_transcription(F.col("t")), t="```\nabc\n```") == "abc"
    assert one(spark, T.clean_transcription(F.col("t")), t=" [Unable to transcribe.] ") == ""


def test_routes(spark):
    for path, route in [("a/B.PDF", "pdf"), (".png", "rejected"), ("x.tar.docx", "word"), ("a.weba", "audio"), ("noext", "rejected")]:
        assert one(spark, R.route(R.extension(F.col("t"))), t=path) == route


def test_transliteration():
    assert translit.to_tamyig("क्षि १।") == "ཀྵི ༡།"
    assert translit.from_tamyig("ཀྵི ༡།") == "क्षि १।"
    assert translit.to_ranjana("कि क्ष") == "ls If"
    assert translit.from_ranjana("ls If") == "कि क्ष"
    assert translit.from_ranjana("ll") == "ि"
    assert translit.from_tamyig("क ཀ") == "क ཀ"
    assert translit.to_tamyig("्") == "्"


def test_ladder(spark):
    rows = spark.createDataFrame([("ab",), ("abc",), (None,), (" ",)], "t string")
    got = {r.t: (r.output, r.provider, r.ok) for r in providers.ladder(rows, "t", ["fails", "upper"]).collect()}
    assert got == {"ab": ("AB", "upper", True), "abc": ("abc", None, False), None: (None, None, False), " ": (" ", None, False)}


def test_docx(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(raw.getvalue())
    (tmp_path / "b.docx").write_bytes(b"no zip")
    got = {r.path[-6:]: (r.text, r.ok) for r in files.word_pages(files.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": ("One\ntwo", True), "b.docx": (None, False)}


def test_stored_tables(spark, tmp_path):
    docs = files.with_id(spark.createDataFrame([("x.pdf", "Completed")], "original_filename string, status string"), "original_filename")
    files.append(docs, str(tmp_path), "documents")
    results = docs.select(F.col("id").alias("document_id"), F.lit("t").alias("extracted_text")).union(spark.createDataFrame([("lost", "t")], "a string, b string"))
    files.append(files.with_id(results, "document_id"), str(tmp_path), "ocr_results")
    assert [r.document_id for r in files.orphans(spark, str(tmp_path), "ocr_results").collect()] == ["lost"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, 0, "chunk", "a" * 100), (1, 1, "chunk", "b" * 99), (1, 2, "chunk", "c" * 120), (1, 3, "done", None), (1, 4, "chunk", "d" * 100), (2, 0, "chunk", " " * 100), (2, 1, "other", "x")]
    events = spark.createDataFrame([(s, q, None, k, p) for s, q, k, p in rows], sessions.EVENT)
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = sessions.transcribe(sessions.read_events(spark, str(tmp_path / "in")), timeout_ms=None)
    sessions.write_results(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = sessions.read_results(spark, str(tmp_path / "out"))
    got = {(r.session_id, r.chunk_index, r.text) for r in out.filter("kind = 'segment'").collect()} | {(2, 1, " " * 100)}
    assert got == {tuple(r) for r in sessions.replay(events).collect()} == {(1, 1, "a" * 100), (1, 2, "a" * 100 + "c" * 120), (2, 1, " " * 100)}
    assert out.filter("kind = 'done'").first().text == "a" * 100 + "c" * 120
    assert [r.text for r in out.filter("kind = 'status'").collect()] == [sessions.NO_SPEECH]


def affinity(region, line, h, width):
    """The score of a line for an open region; None where they do not go together."""
    (x1, _, x2, bottom), (a1, top, a2, _) = region, line
    w, v, below = x2 - x1, a2 - a1, top - bottom
    share = max(0, min(x2, a2) - max(x1, a1)) / max(1, min(w, v))
    alike = min(w, v) / max(w, v) >= 0.42
    column = (share >= 0.35 and (alike or min(w, v) >= 0.62 * width)) or (alike and abs(x1 + x2 - a1 - a2) / 2 <= 0.28 * max(w, v))
    return share + 1 / (1 + max(0, below)) if column and -h <= below <= max(18, int(2.7 * h)) else None


def surveyed_regions(lines, width, height):
    """The lines' numbers of each region that is of the size of text."""
    h = statistics.median(y2 - y1 for _, y1, _, y2 in lines)
    open_: list[tuple] = []
    homes: list[set] = []
    for i in sorted(range(len(lines)), key=lambda i: (lines[i][1], lines[i][0])):
        scores = [(affinity(r, lines[i], h, width) or 0, -k) for k, r in enumerate(open_)]
        score, k = max(scores, default=(0, 0))
        if not score:
            open_.append(lines[i])
            homes.append({i})
        else:
            both = list(zip(open_[-k], lines[i], strict=True))
            open_[-k] = (min(both[0]), min(both[1]), max(both[2]), max(both[3]))
            homes[-k].add(i)
    sizes = [(x2 - x1, y2 - y1) for x1, y1, x2, y2 in open_]
    return [m for (w, v), m in zip(sizes, homes, strict=True) if w >= max(30, int(width * 0.025)) and v >= 7 and w * v <= 0.35 * width * height]


def test_lines_are_grouped_by_the_surveyed_rule(spark):
    rng = random.Random(5)
    pages = {
        1: [(50, 10, 950, 40), (50, 50, 350, 70), (50, 75, 350, 95), (600, 50, 940, 70)],  # a heading over two columns
        2: [(100, 10, 300, 30), (190, 35, 290, 55), (100, 60, 300, 80)],  # a narrower line off the centre
        3: [(100, 100, 110, 120), (400, 100, 700, 105), (100, 300, 400, 320)],  # too narrow, too low, kept
        4: [(0, 20 * k, 990, 20 * k + 18) for k in range(40)],  # one region of over 0.35 of the page
        5: [(20, 10, 980, 30), (20, 35, 650, 55), (300, 60, 430, 80)],
    }
    for p in range(6, 40):
        pages[p] = [(x, y, x + rng.choice([20, 60, 150, 300, 640]), y + rng.choice([5, 12, 20])) for x, y in ((rng.randrange(0, 360, 20), rng.randrange(0, 200, 7)) for _ in range(14))]
    rows = [(p, i, *b) for p, lines in pages.items() for i, b in enumerate(lines)]
    got = {}
    for r in G.group_lines(spark.createDataFrame(rows, "page int, ix int, x1 int, y1 int, x2 int, y2 int"), 1000, 1400).collect():
        got.setdefault(r.page, {}).setdefault(r.region, set()).add(r.ix)
    for p, lines in pages.items():
        assert [got.get(p, {})[k] for k in sorted(got.get(p, {}))] == surveyed_regions(lines, 1000, 1400), p
    assert got[1] == {0: {0}, 1: {1, 2}, 2: {3}} and got[3] == {0: {2}} and 4 not in got


def test_reading_order_by_its_definition(spark):
    rng = random.Random(9)
    pages = {p: [(x, y, x + rng.choice([90, 200, 400, 700]), y + 30) for x, y in ((rng.randrange(0, 300, 10), rng.randrange(0, 900, 50)) for _ in range(12))] for p in range(25)}
    rows = [(p, i, *b) for p, regions in pages.items() for i, b in enumerate(regions)]
    got = {}
    for r in G.reading_order(spark.createDataFrame(rows, "page int, ix int, x1 int, y1 int, x2 int, y2 int"), 1000).orderBy("page", "place").collect():
        got.setdefault(r.page, []).append(r.ix)
    for p, regions in pages.items():
        want, waiting = [], []

        def empty(waiting=waiting, want=want, regions=regions):
            columns = []
            for i in sorted(waiting, key=lambda i: (regions[i][0], regions[i][1], i)):
                def fits(column, i=i):
                    left, right = min(regions[k][0] for k in column), max(regions[k][2] for k in column)
                    own = regions[i][2] - regions[i][0]
                    return abs(regions[i][0] + regions[i][2] - left - right) / 2 <= 0.45 * max(own, right - left)

                home = next((c for c in columns if fits(c)), None)
                if home is None:
                    columns.append([i])
                else:
                    home.append(i)
            for c in sorted(columns, key=lambda c: min(regions[k][0] for k in c)):
                want.extend(sorted(c, key=lambda k: (regions[k][1], regions[k][0])))
            waiting.clear()

        for i in sorted(range(len(regions)), key=lambda i: (regions[i][1], regions[i][0], i)):
            if regions[i][2] - regions[i][0] >= 680:
                empty()
                want.append(i)
            else:
                waiting.append(i)
        empty()
        assert got[p] == want, p


@pytest.mark.parametrize(("gap", "found"), [(0.25, True), (-0.25, False), (0.24, False)])
def test_confidence_gaps_count_only_where_the_global_run_leads(spark, gap, found):
    row = (True, True, 100, 140, 0.5 + gap, 0.5, 0.9, 0.9)
    names = "complex_layout boolean, layout_attempted boolean, global_text_length int, layout_text_length int, global_confidence double, layout_confidence double, global_quality double, layout_quality double"
    got = spark.createDataFrame([row], names).select(Q.layout_reasons().alias("r")).first().r
    assert got == (["large_layout_confidence_gap"] if found else [])


def test_units_of_every_kind(spark):
    cases = {
        "a b\n\n c\nd": ["a b", "c\nd"],
        "a b\r\nc\x0bd": ["a b", "c", "d"],
        "One. Two! Three? चार। पाँच": ["One.", "Two!", "Three?", "चार।", "पाँच"],
        "  one ": ["one"],
        "": [""],
        None: [""],
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.units(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases


def test_chunks_by_their_definition(spark):
    rng = random.Random(3)
    texts = ["\n".join(" ".join(f"w{rng.randrange(9)}" for _ in range(rng.choice([1, 5, 60, 110, 219, 220, 221, 500]))) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.greedy_chunks(T.units(F.col("t"))).alias("c")).collect()
    for r in got:
        units = r.t.split("\n") if "\n" in r.t else [r.t]
        want: list[list[str]] = []
        full = True
        for u in units:
            w = u.split()
            if len(w) > 220:
                want += [[" ".join(w[i : i + 220])] for i in range(0, len(w), 220)]
                full = True
            elif full or len(" ".join(want[-1]).split()) + len(w) > 220:
                want.append([u])
                full = False
            else:
                want[-1].append(u)
        assert r.c == ["\n\n".join(c) for c in want]


def test_reflected_windows(spark):
    px = spark.createDataFrame([(1, 0, c, v) for c, v in enumerate([10, 20, 40])], "img long, r int, c int, v int")
    wide = P.padded(px, "r", "c", 3).orderBy("c").collect()
    assert [(r.c, r.v) for r in wide] == [(-3, 20), (-2, 40), (-1, 20), (0, 10), (1, 20), (2, 40), (3, 20), (4, 10), (5, 20)]
    ends = P.padded(px, "r", "c", 2, "repeat").orderBy("c").collect()
    assert [r.v for r in ends] == [10, 10, 10, 20, 40, 40, 40]
    assert P.sharpen(px.limit(0)).count() == 0 and P.sauvola(px.limit(0)).count() == 0


def test_sidebar_pads(spark):
    px = spark.createDataFrame([(1, x, y, 7) for x in (80, 86, 99) for y in (9, 10, 49, 50)], "page long, x int, y int, v int")
    words = spark.createDataFrame([(1, 70, 20, 74, 40)], "page long, x1 int, y1 int, x2 int, y2 int")
    got = {(r.x, r.y): r.v for r in G.sidebar_white(px, words, 100, 100).collect()}
    assert {k for k, v in got.items() if v == 7} == {(80, 9), (80, 10), (80, 49), (80, 50), (86, 10), (86, 49)}


def test_regions_of_a_page_are_read_in_order(spark):
    lines = [(1, k, 50, 100 + 30 * k, 350, 120 + 30 * k) for k in range(8)] + [(1, 10 + k, 650, 100 + 30 * k, 950, 120 + 30 * k) for k in range(8)] + [(1, 20, 50, 20, 950, 60)]
    lines = spark.createDataFrame(lines, "page int, ix int, x1 int, y1 int, x2 int, y2 int")
    columns = spark.createDataFrame([(1, 40, 95, 360, 340), (1, 640, 95, 960, 340)], "page int, x1 int, y1 int, x2 int, y2 int")
    got = G.layout_regions(lines, columns, 1000, 1400).orderBy("place").collect()
    assert [(r.x1, r.y1) for r in got]== [(50, 20), (40, 95), (640, 95)]
    none = G.layout_regions(lines, columns.limit(1), 1000, 1400).orderBy("place").collect()
    assert [(r.x1, r.lines) for r in none] == [(50, 8), (650, 8)]  # the heading spans several columns


def test_a_failing_chunk_is_an_error_of_its_own(spark, tmp_path):
    rows = [(1, 0, None, "chunk", "a" * 100), (1, 1, None, "chunk", "!" * 100), (1, 2, None, "chunk", "c" * 100), (1, 3, None, "done", None), (1, 4, None, "chunk", "d" * 100)]
    spark.createDataFrame(rows, sessions.EVENT).coalesce(1).write.parquet(str(tmp_path / "in"))

    def hear(text):
        if text.endswith("!"):
            raise ValueError("noise")
        return text

    live = sessions.transcribe(sessions.read_events(spark, str(tmp_path / "in")), timeout_ms=None, transcriber=hear)
    sessions.write_results(live, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = [(r.chunk_index, r.kind, r.text) for r in sessions.read_results(spark, str(tmp_path / "out")).collect()]
    heard = "a" * 100 + "!" * 100 + "c" * 100  # the chunk that failed counts, and its audio stays
    assert got == [(1, "segment", "a" * 100), (2, "error", "Transcription error: noise"), (3, "segment", heard), (3, "done", heard)]


def test_saving_is_skipped_where_the_table_cannot_be_written(spark, tmp_path):
    rows = spark.createDataFrame([("1", "x")], "id string, original_filename string")
    assert files.append_or_skip(rows, str(tmp_path), "documents")[1] == "saved"
    (tmp_path / "blocked").write_text("a file, not a folder")
    kept, status = files.append_or_skip(rows, str(tmp_path / "blocked"), "documents")
    assert status == "skipped" and kept.first().original_filename == "x"


def test_stored_tables_in_the_catalog(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS stored_test")
    files.create_tables(spark, str(tmp_path), "stored_test")
    files.append(spark.createDataFrame([("1", "x")], "id string, original_filename string"), str(tmp_path), "documents")
    spark.catalog.refreshTable("stored_test.documents")
    assert spark.table("stored_test.documents").count() == 1 and spark.table("stored_test.translations").count() == 0
    files.drop_tables(spark, "stored_test")
    spark.sql("DROP DATABASE stored_test")


def test_files_of_other_libraries(spark):
    pdf = b"%PDF-1.4\n1 0 obj\nstream\nBT (Hello \\(you\\)) Tj ( there ) Tj ET\nendstream\n2 0 obj\nstream\n" + zlib.compress(b"BT (two) Tj ET") + b"endstream"
    rows = spark.createDataFrame([("a.pdf", pdf), ("b.pdf", b"junk")], "path string, content binary")
    assert [tuple(r) for r in providers.pdf_pages(rows).orderBy("page_no").collect()] == [("a.pdf", 0, "Hello (you)\n there"), ("a.pdf", 1, "two")]
    coded = providers.encoded_images(spark.createDataFrame([("a", b"xy"), ("b", b"")], "path string, image binary"), lambda image, quality: image[:1] + bytes([quality, image[0]])).collect()
    assert {r.path: r.image and bytes(r.image) for r in coded} == {"a": b"x\x5cx", "b": None}
    drawn = providers.page_images(rows.limit(1), lambda content, dpi: [content[:4], str(dpi).encode()]).collect()
    assert [(r.page_no, r.dpi, bytes(r.image)) for r in drawn] == [(0, 150, b"%PDF"), (1, 150, b"150")]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((2, 2, 8000, 0, "NONE", ""))
        w.writeframes(struct.pack("<8h", *[100, 300, 200, 400, 0, 0, 10, 30]))
    heard = {r.path: r for r in providers.normalized_audio(spark.createDataFrame([("a", out.getvalue()), ("b", b"x")], "path string, content binary")).collect()}
    with wave.open(io.BytesIO(bytes(heard["a"].audio))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getnframes()) == (1, 16_000, 8) and struct.unpack("<8h", w.readframes(8))[:3] == (200, 250, 300)
    assert not heard["b"].ok and heard["b"].error.startswith("Audio normalization failed")


BOXES = "page long, ix int, x1 int, y1 int, x2 int, y2 int, lines int"


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_boxes_of_empty_tables_and_null_sides(spark, kind):
    rows = [] if kind == "empty" else [(1, 1, None, None, None, None, None), (1, 2, 0, 0, 100, 20, 2), (1, 2, 0, 0, 100, 20, 2), (1, 3, 5, 5, 5, 5, 1), (None, 1, 0, 0, 900, 30, 1)]
    b = spark.createDataFrame(rows, BOXES)
    n = len(rows)
    assert G.replace_overlapped(b, b.limit(0)).count() == n
    assert G.without_redundant(b, 1000, 1400).count() <= n
    assert G.complex_layout(b, 1000).filter("complex").count() == 0
    assert G.reading_bands(b, 1000).count() == n
    ok = b.filter("page is not null and x1 is not null")
    assert G.reading_order(ok, 1000).count() == ok.count()
    assert G.merge_nearby(ok).count() <= ok.count() and G.group_lines(ok, 1000, 1400).count() <= ok.count()
    px = spark.createDataFrame([], "page long, x int, y int, v int")
    assert G.sidebar_white(px, b, 1000, 1400).count() == 0
    ink = px.select("page", "x", "y")
    assert G.split_wide_boxes(b, ink, 1000, 1400).count() >= n
    assert G.projection_columns(ink, b.select("page").distinct(), 1000, 1400).count() == 0


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_rasters_of_empty_tables_and_null_values(spark, kind):
    rows = [] if kind == "empty" else [(1, r, c, None if r == c else 40 * r) for r in range(4) for c in range(4)] + [(2, 0, 0, None)]
    px = spark.createDataFrame(rows, "img long, r int, c int, v int")
    for made in (P.sauvola(px, 1), P.adaptive_ink(px, 5), P.open_close(px), P.without_lines(px, 2, 2), P.without_vertical_noise(px, 2), P.without_sidebar_noise(px, 0.5, 2), P.thinned(px), P.sharpen(px)):
        assert made.count() == len(rows)
    assert P.doubled(px).count() == 4 * len(rows) and L.labelled_pixels(px).count() <= len(rows)
    bgr = px.select("img", "r", "c", F.col("v").alias("b"), F.col("v").alias("g"), F.lit(1).alias("red"))
    assert P.grayscale(bgr).count() == P.without_blue(bgr).count() == len(rows)


def test_texts_of_empty_tables_and_nulls(spark):
    for rows in ([], [(None, None), ("", 0.5), ("a" * 300_000, 0.5)]):
        df = spark.createDataFrame(rows, "text string, confidence double")
        assert Q.page_quality(df).count() == len(rows)
        assert df.select(T.units(F.col("text")), T.greedy_chunks(T.units(F.col("text"))), T.clean_transcription(F.col("text")), T.without_artifact_lines(F.col("text"))).count() == len(rows)


def png(width, height, rgb):
    """An uncompressed-filter PNG of 8-bit RGB pixels."""
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes(v for p in rgb[y * width : (y + 1) * width] for v in p) for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_transliteration_of_every_letter_both_ways():
    for there, back, table in ((translit.to_tamyig, translit.from_tamyig, translit.T_BASES), (translit.to_ranjana, translit.from_ranjana, translit.R_BASES)):
        first = {}
        for letter, sign in table.items():
            assert there(letter) == sign and there(f"a{letter} ") == f"a{sign} "
            first.setdefault(sign, letter)
        for sign, letter in first.items():
            assert back(sign) == letter
    for base in "कखगचजतदनपबमयरलसह":
        for mark, sign in translit.T_MARKS.items():
            assert translit.to_tamyig(base + mark) == translit.T_BASES[base] + sign
            if mark != "ृ":  # its first sign is read as a joined letter on the way back
                assert translit.from_tamyig(translit.T_BASES[base] + sign) == base + mark
        for joined, sign in translit.T_JOINED.items():
            if f"{base}्{joined}" not in translit.T_BASES:
                assert translit.to_tamyig(f"{base}्{joined}") == translit.T_BASES[base] + sign
        for mark, sign in translit.R_MARKS.items():
            assert translit.to_ranjana(base + mark) == translit.R_BASES[base] + sign
        assert translit.to_ranjana(base + "ि") == "l" + translit.R_BASES[base]


def test_images_are_decoded_as_blue_green_red(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 1, [(1, 2, 3), (40, 50, 60)]))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.origin.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path)).collect()}
    assert (got["a.png"].width, got["a.png"].height, got["a.png"].nChannels) == (2, 1, 3)
    assert bytes(got["a.png"].data) == bytes([3, 2, 1, 60, 50, 40]) and got["b.png"].height == -1
    scanned = {r.path.rsplit("/", 1)[1]: (r.length, r.ext, r.route) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert scanned["b.png"] == (8, ".png", "image")
