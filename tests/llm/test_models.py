"""The quality model, spelling variants and centroid clusters against plain computations and held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import threading
import time
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafmill.llm import additive, clusters, codec, common, language, queries, variants

DOCS = "doc_id long, text string, lang string"


# Spelling variants


def counted(rows) -> dict[str, int]:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def grouped(words: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and edits(v, w) == 1] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= ratio * words[w] else None

    def root(w: str) -> str:
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def as_rows(found) -> set[tuple]:
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.mark.parametrize("shard_words", [3, 40, 4000])
def test_variants_of_words(spark, shard_words):
    rng = random.Random(5)
    stems = ["colour", "nation", "éclair", "straße", "abcabcabc", "aaaaaaa", "x" * 70, "y" * 64]
    words: dict[str, int] = {}
    for s in stems:
        words[s] = rng.choice([5, 25, 125, 625, 3000])
        for _ in range(14):
            i, k = rng.randrange(len(s) + 1), rng.random()
            v = s[:i] + rng.choice("abcéx") + s[i:] if k < 0.4 else s[:i] + s[i + 1 :] if k < 0.7 else s[:i] + rng.choice("abcéx") + s[i + 1 :]
            if len(v) >= 6:
                words.setdefault(v, rng.choice([5, 25, 125, 625]))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_rows(variants.group_variants(df, shard_words=shard_words)) == grouped(words)


def test_variants_follow_forms_to_the_last(spark):
    words = {"abcdef": 5, "abcdeg": 25, "abcdeh": 24, "abcxeg": 125, "abcxyg": 625, "ancxyg": 3125, "ancxyz": 3125}
    got = as_rows(variants.group_variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == grouped(words) and ("abcdef", "abcdeg", "ancxyg", 5, 2, 25) in got


def test_variants_of_texts(spark):
    rng = random.Random(6)
    stems = ["Colour", "nation", "Über", "élève", "harbour", "harbours"]
    rows = [(i if i % 9 else None, " ".join(rng.choice(stems) + rng.choice(["", "s", "e", "1", "Ñ"]) for _ in range(80))) for i in range(120)]
    rows += [rows[3], rows[3], (1000, None), (1001, ""), (1002, "harbour" * 3000 + " " + "colour " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], DOCS).withColumnsRenamed({"lang": "word"}).withColumn("n", F.lit(1))
    assert as_rows(variants.spelling_variants(docs)) == grouped(counted(rows))
    assert variants.spelling_variants(docs.filter("doc_id > 5000")).count() == 0


def test_one_edit():
    rng = random.Random(7)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(6))) for _ in range(2))
        assert variants.one_edit(a, b) == (edits(a, b) == 1), (a, b)
    for n in (63, 64, 65, 66, 90):  # what a deletion leaves is the same, as text or as a hash
        word = "".join(rng.choice("ab") for _ in range(n))
        i = rng.randrange(n)
        assert variants.shortened(word) & variants.shortened(word[:i] + "z" + word[i + 1 :]) and variants.shortened(word) & variants.shortened(word[:i] + word[i + 1 :])


# Centroid clusters


def clustered(rows, k=8, rounds=10, seed=3) -> set[tuple]:
    kept = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    centres = [q for _, q in sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), j) for j, c in enumerate(centres)) for _, q in kept]

    for _ in range(rounds):
        home = assigned()
        for j in range(len(centres)):
            own = [q for (_, q), (_, h) in zip(kept, home, strict=True) if h == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    home, most = assigned(), 2**63 - 1
    inertia = [sum(d for d, h in home if h == j) for j in range(len(centres))]
    return Counter((i, j, min(most, d), min(most, inertia[j]), min(most, sum(inertia)), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, home, strict=True))


def vectors_of(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int").repartition(3)


def cluster_rows(found) -> Counter:
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect())


def test_clusters(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=64) * 0.3 + (i % 5)).tolist()) for i in range(150)]
    rows += [(200, rows[0][1]), (0, rows[0][1]), (201, None), (202, [1.0] * 63), (203, [float("nan")] + [0.0] * 63), (204, [None] + [0.0] * 63), (205, [float("inf")] * 64), (None, rows[3][1])]
    df = vectors_of(spark, rows)
    assert cluster_rows(clusters.cluster(df)) == clustered(rows)
    assert cluster_rows(clusters.cluster(df.filter("vec_id < 3"))) == clustered([r for r in rows if r[0] is not None and r[0] < 3])
    assert clusters.cluster(df.filter("vec_id > 300")).count() == 0


def test_clusters_beyond_exact_doubles(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=64) * 10.0 ** (i % 12)).tolist()) for i in range(60)] + [(70, [1.5e308, -1.5e308] + [0.0] * 62), (71, [2.0**60 + 2.0**9] * 64), (72, [2.0**60] * 64)]
    assert cluster_rows(clusters.cluster(vectors_of(spark, rows))) == clustered(rows)


def test_distances_tie_to_the_smaller_number():
    near, far, wide = clusters.distances(np.array([[0.5, 0.5], [1e9, 1e9]]), [[0, 0], [1024, 1024], [1024, 1024]], 1024)
    assert near.tolist() == [0, 1] and far[0] == 2 * 512**2 and wide == {1: 2 * (1024 * 10**9 - 1024) ** 2}


# Quality model


def quality_text(rng: random.Random, good: bool) -> str:
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 160))]
    if good:
        return ".\n".join(" ".join(words[i : i + 12]).capitalize() for i in range(0, len(words), 12)) + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words) if kind == 1 else "\n".join([" ".join(words[:6])] * 20)


def test_quality_is_learned_from_what_is_not_held_out(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(500):
        good = rng.random() < 0.7
        rows.append((i, quality_text(rng, good)))
        held = zlib.crc32(str(i).encode()) % 4 == 2
        labels.append((i, int(good) if not held else int(not good)))  # labels that are held out are wrong: they must teach nothing
    truth = {i: (q if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - q) for i, q in labels}
    rows += [(900, None), (901, ""), (902, "\n \t"), (903, "long word " * 60_000), (None, "A line of words. And another one.")]
    docs = spark.createDataFrame([(*r, "src") for r in rows], "doc_id long, text string, score string")
    known = spark.createDataFrame([*labels, (901, None), (None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in additive.judge_quality(docs, known).collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found.values())
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in truth)
    held = [i for i in truth if found[i].held_out]
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    unlabelled = additive.judge_quality(docs.limit(3), known.filter("quality > 5")).collect()
    assert [r.score for r in unlabelled] == [0.5] * 3 and not any(r.predicted for r in unlabelled)
    assert additive.judge_quality(docs.filter("doc_id < 0"), known).count() == 0
    one_label = additive.judge_quality(docs, known.filter("quality = 1")).collect()
    assert min(r.score for r in one_label) > 0.9


def test_features_do_not_depend_on_segments():
    rng = random.Random(11)
    for _ in range(30):
        text = "\n".join(quality_text(rng, rng.random() < 0.5) for _ in range(12))
        assert additive.features(text, 2500) == pytest.approx(additive.features(text), abs=1e-9)
    assert len(additive.features(None)) == len(additive.FEATURES) == len(set(additive.FEATURES))


def test_trees_are_the_best_of_their_kind():
    rng = np.random.default_rng(12)
    for _ in range(20):
        g, h = rng.normal(size=7), rng.random(7) + 0.1
        value = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + additive.RIDGE)  # noqa: B023, E731
        gains = [value(slice(0, c)) + value(slice(c, 7)) - value(slice(0, 7)) for c in range(1, 7)]
        gain, cut = additive.best_cut(g, h)
        assert (gain, cut) == (pytest.approx(max(gains)), int(np.argmax(gains)) + 1) if max(gains) > 1e-12 else cut == 0
        tree = additive.small_tree(g, h)
        assert len(tree) == 7 and len({round(v, 12) for v in tree}) <= 3
    x = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing but an interaction
    model = additive.train(x, y)
    test = rng.random((1000, 2))
    assert ((additive.scores(model, test) > 0.5) == ((test[:, 0] > 0.5) ^ (test[:, 1] > 0.5))).mean() > 0.93


def test_queries_return_the_contracts_columns(spark, sf):
    assert queries.op11_quality_model(spark, sf).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert queries.op12_spelling_variants(spark, sf).dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    kinds = [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint"), ("inertia", "bigint"), ("centroid_sha256", "string")]
    assert queries.op13_centroid_clusters(spark, sf).dtypes == kinds


# Tables and folders


def test_token_files_leave_nothing_but_what_is_read(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * 30, "x") for i in range(40)], DOCS)
    root = Path(common.fresh_path(spark, "x")).parent
    before = set(root.iterdir())
    manifest = codec.write_token_files(docs)
    assert all(r.file.startswith("file:") and r.ranks.startswith("file:") for r in manifest.collect())
    assert codec.read_token_files(manifest).count() == 40
    assert sorted("-".join(p.name.split("-")[:2]) for p in set(root.iterdir()) - before) == ["token-files", "token-manifest"]


def test_scratches_of_two_threads_do_not_meet(spark):
    began, gone = threading.Event(), threading.Event()
    kept = {}

    def other() -> None:
        with common.scratch(spark) as held:
            began.wait(60)
            held.append(common.materialise(spark.range(5).toDF("a"), "other"))
            kept["table"] = held[0]
            gone.wait(60)

    thread = threading.Thread(target=other)
    thread.start()
    with common.scratch(spark):
        common.materialise(spark.range(3).toDF("a"), "mine")
        began.set()
        while "table" not in kept:
            time.sleep(0.1)
    gone.set()
    thread.join()
    assert kept["table"].count() == 5
