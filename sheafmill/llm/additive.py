"""Document quality by a generalised additive model with pairwise interactions.

The score's log-odds are a sum of lookup tables, one a feature and one a chosen pair of features. Training takes the features in turn, round after round: each
turn fits a tree of at most three leaves to the gradients summed by bin and adds a small part of it to the feature's table. The pairs that would lower
the loss most by a cut in both features then get tables of their own in the same way, by trees of four leaves. Scoring finds each feature's bin and adds up entries for a
batch of documents at once.

Features are counted over whole texts: a text goes through in segments of at most ``SEGMENT`` characters, cut at line ends or white space, and what is
kept of it are counts and 8 bytes a word (a line longer than a segment counts as several). Training takes at most ``TRAIN_DOCS`` labelled documents, those with the lowest hashes of their keys: a bounded,
reproducible sample; only its feature values reach the driver, only the tables go back.

Edge cases: null and empty texts have the features of no words and are scored; without labelled documents every score is 0.5, with one label only it is near that label;
null labels and keys teach nothing; repeated rows are scored alike; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .language import held_out

TRAIN_DOCS = 20_000
SEGMENT = 1_000_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.1, 1.0
FEATURES = (
    "log_words mean_word upper_share digit_share symbol_share bar_share shout_share punctuation_share other_share "
    "words_a_line repeated_line_share ended_line_share distinct_share repeated_window_share longest_run_share long_word_share"
).split()
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _class(chars: str) -> np.ndarray:
    on = np.zeros(256, dtype=np.int64)
    on[list(chars.encode())] = 1
    return on


_UPPER, _LOWER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_DIGIT, _SYMBOL, _BAR, _SHOUT, _MARK = _class("0123456789"), _class("#*$%&<>"), _class("|"), _class("!"), _class(".,;:?'\"()-")
_BLANK, _LATER = _class(" \t\n\x0b\x0c\r"), np.array([1 if 0x80 <= b < 0xC0 else 0 for b in range(256)])  # bytes after a character's first
_OTHER = np.array([1 if b >= 0xC0 else 0 for b in range(256)])


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of at most ``size`` characters that end at a line end, else at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > size:
        cut = text.rfind("\n", at, at + size) + 1
        if cut <= at:
            blank = text.rfind(" ", at, at + size)
            found = None if blank > at else re.compile(r"\s").search(text, at + size)
            cut = blank + 1 if blank > at else found.end() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def _numbers(items: list[str]) -> np.ndarray:
    """Numbers of equal texts that are equal; they mean nothing outside this document."""
    return np.fromiter(map(hash, items), dtype=np.int64, count=len(items)).view(np.uint64)


def repeated(numbers: np.ndarray) -> np.ndarray:
    """Which numbers occur more than once."""
    _, inverse, counts = np.unique(numbers, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def features(text: str | None, segment: int = SEGMENT) -> list[float]:
    """The FEATURES of a whole text."""
    chars = np.zeros(256, dtype=np.int64)
    words, lines, ended, length, long_words, held = [], [], 0, 0, 0, ""
    parts = list(segments(text or "", segment))
    for i, part in enumerate(parts):
        chars += np.bincount(np.frombuffer(part.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
        own = part.split()
        sizes = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        words.append(_numbers(own))
        length, long_words = length + int(sizes.sum()), long_words + int((sizes > 20).sum())
        rows = (held + part).split("\n")
        held = rows.pop() if i + 1 < len(parts) and len(rows[-1]) < segment else ""
        rows = [r for r in map(str.strip, rows) if r]
        ended += sum(r[-1] in ".!?:;\"'" for r in rows)
        lines.append(_numbers(rows))
    w, rows = np.concatenate(words), np.concatenate(lines)
    n, n_lines, total = len(w), len(rows), max(1, int(chars @ (1 - _BLANK - _LATER)))
    letters = max(1, int(chars @ (_UPPER + _LOWER)))
    again = n_windows = run = 0
    if n >= 3:
        same = repeated(w[:-2] * _MIX[0] + w[1:-1] * _MIX[1] + w[2:] * _MIX[2])
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= same
        again, n_windows = int(covered.sum()), n
    if n:
        ends = np.flatnonzero(np.append(w[1:] != w[:-1], True))
        run = int(np.diff(ends, prepend=-1).max())
    return [
        float(np.log1p(n)),
        length / max(1, n),
        float(chars @ _UPPER) / letters,
        *[float(chars @ c) / total for c in (_DIGIT, _SYMBOL, _BAR, _SHOUT, _MARK, _OTHER)],
        n / max(1, n_lines),
        1 - len(np.unique(rows)) / max(1, n_lines) if n_lines else 0.0,
        ended / max(1, n_lines),
        len(np.unique(w)) / max(1, n),
        again / max(1, n_windows),
        run / max(1, n),
        long_words / max(1, n),
    ]


def _odds(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins by its gradient and curvature sums; a place of 0 means none."""
    left_g, left_h = g.cumsum()[:-1], h.cumsum()[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    if not len(gain) or gain.max() <= 1e-12:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + RIDGE))


def small_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values a bin of a tree of at most three leaves: the best cut, then the better cut of its two sides."""
    _, first = best_cut(g, h)
    if not first:
        return np.full(len(g), _leaf(g, h))
    sides = [(0, first), (first, len(g))]
    cuts = [best_cut(g[a:b], h[a:b]) for a, b in sides]
    which = int(cuts[1][0] > cuts[0][0])
    edges = sorted({0, first, len(g)} | ({sides[which][0] + cuts[which][1]} if cuts[which][1] else set()))
    return np.concatenate([np.full(b - a, _leaf(g[a:b], h[a:b])) for a, b in zip(edges, edges[1:], strict=False)])


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts the rows once and then the columns of each side."""
    best, out = 0.0, np.full(g.shape, _leaf(g, h))
    whole = g.sum() ** 2 / (h.sum() + RIDGE)
    for r in range(1, len(g)):
        gain, values = -whole, np.empty_like(g)
        for rows in (slice(0, r), slice(r, len(g))):
            own_g, own_h = g[rows].sum(axis=0), h[rows].sum(axis=0)
            more, cut = best_cut(own_g, own_h)
            gain += own_g.sum() ** 2 / (own_h.sum() + RIDGE) + more
            for cols in (slice(0, cut), slice(cut, None)) if cut else (slice(0, None),):
                values[rows, cols] = _leaf(own_g[cols], own_h[cols])
        if gain > best:
            best, out = gain, values
    return best, out


def bins_of(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)], axis=1)


def _edges(x: np.ndarray, n: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, n) / n, method="inverted_cdf")) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray) -> dict:
    """Edges, tables, pairs and their tables from rows of features and labels of 0 and 1."""
    model: dict = {"edges": [], "tables": [], "pairs": [], "start": 0.0}
    if not len(y):
        return model
    model["start"] = _odds((y.sum() + 0.5) / (len(y) + 1))
    edges, coarse = [_edges(x[:, j], BINS) for j in range(x.shape[1])], [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    b, c = bins_of(x, edges), bins_of(x, coarse)
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), model["start"])

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(total)
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(tables):
            g, h = (np.bincount(b[:, j], v, len(table)) for v in slopes())
            step = RATE * small_tree(g, h)
            table += step
            total += step[b[:, j]]
    flat = {p: (c[:, p[0]] * (len(coarse[p[1]]) + 1) + c[:, p[1]], (len(coarse[p[0]]) + 1, len(coarse[p[1]]) + 1)) for p in combinations(range(len(edges)), 2)}

    def sums(pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at, shape = flat[pair]
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in slopes())

    gains = {pair: pair_tree(*sums(pair))[0] for pair in flat}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    pair_tables = {p: np.zeros(flat[p][1]) for p in chosen if gains[p] > 0}
    for _ in range(PAIR_ROUNDS):
        for pair, table in pair_tables.items():
            step = RATE * pair_tree(*sums(pair))[1]
            table += step
            total += step.ravel()[flat[pair][0]]
    for j, table in enumerate(tables):  # a table's mean over the sample goes to the start
        mean = table[b[:, j]].mean()
        table -= mean
        model["start"] += mean
    return model | {"edges": edges, "coarse": coarse, "tables": tables, "pairs": list(pair_tables.items())}


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Scores between 0 and 1 of rows of features: bins found and entries added, all rows at once."""
    total = np.full(len(x), model["start"])
    if model["tables"]:
        b, c = bins_of(x, model["edges"]), bins_of(x, model["coarse"])
        for j, table in enumerate(model["tables"]):
            total += table[b[:, j]]
        for (i, j), table in model["pairs"]:
            total += table[c[:, i], c[:, j]]
    return _sigmoid(total)


def _featured(batch: pa.RecordBatch, at: int) -> np.ndarray:
    return np.array([features(t.as_py()) for t in batch.column(at)], dtype=np.float64).reshape(batch.num_rows, len(FEATURES))


def training_rows(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, usable: Column, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``most`` labelled documents with the lowest key hashes."""
    rank = F.xxhash64(F.col("key"), F.lit(11))
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label")).filter("key is not null and label in (0, 1)").distinct()
    known = known.filter(usable).orderBy(rank, "key", "label").limit(most)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key").select("key", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _featured(batch, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["key", "label", "x"])

    schema = StructType([rows.schema["key"], *StructType.fromDDL("label double, x array<double>")])
    found = rows.mapInArrow(run, schema).orderBy(rank, "key", "label", "x").limit(most).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float64).reshape(found.num_rows, len(FEATURES))
    return x, found.column("label").to_numpy()


def score_documents(docs: DataFrame, model: dict, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1000):
                batch = whole.slice(first, 1000)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(held.value, _featured(batch, 1)))], names=[key, "score"])

    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, StructType([docs.schema[key], *StructType.fromDDL("score double")]))


def judge_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", cut: float = 0.7, most: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the labelled documents that are not held out and score them all: key, held_out, score, predicted."""
    model = train(*training_rows(docs, labels, text, key, label, ~held_out("key"), most))
    found = score_documents(docs, model, text, key)
    return found.select(F.col(f"`{key}`"), held_out(f"`{key}`").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
