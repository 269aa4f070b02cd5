"""Language of words and documents by a linear-chain conditional random field, for text that switches language.

A word's potentials are the sum of its features' weights: affixes, character n-grams, non-ASCII letters, and the word itself if the
training words hold it often enough (the lexicon). Transitions are learned with them by maximum likelihood, on chains
of one language and on chains spliced from several. A chain is up to ``CHAIN`` consecutive words of a text; all words of a text are in
chains. Forward-backward gives each word's marginals; a document's are the mean over its words with letters.

Training takes at most ``TRAIN_DOCS`` documents a language, those with the lowest hashes, and of these at most ``TRAIN_CHAINS`` chains
a language, of words cut to ``TRAIN_CHARS`` characters; and the ``MAX_LANGUAGES`` languages with the most usable documents (ties: the one that sorts
first), as the transitions of a CRF grow with their square. That is a bounded, reproducible sample of labelled rows, and all that reaches the driver.
The weights (2^15 features times languages) are the only thing sent to executors. A text is labelled in segments of at most ``SEGMENT`` characters, cut
at white space, so a text of any length takes bounded memory.

Edge cases: null text and text without a letter is ``und`` with score 0; without any training document all is ``und``; ties go to the language that
sorts first; repeated rows are judged alike; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

CHAIN = 64
TRAIN_DOCS = 400
TRAIN_CHAINS = 500
TRAIN_CHARS = 64
SEGMENT = 200_000
SLICE = 4096
N_BITS = 15
N_FEATURES = 1 << N_BITS
MAX_LANGUAGES = 500
MAX_KNOWN_WORDS = 400_000


_SEEDS = np.random.default_rng(10).integers(1, 1 << 62, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def core_of(word: str) -> str:
    """The letters of a lower-cased word."""
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def word_features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of lower-cased words, and the word that each belongs to; none for a word without a letter.

    The n-grams of one to three characters of ^letters$ (those at the ends are affixes), the first four and the last four and
    five characters of it as longer affixes, and the word itself if the lexicon has it. All words at once, on code points.
    """
    cores = [core_of(w) for w in words]
    spoken = np.array([i for i, c in enumerate(cores) if c], dtype=np.int64)
    if not len(spoken):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join(f"^{cores[i]}$" for i in spoken).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(cores[i]) + 2 for i in spoken])
    owner = np.repeat(np.arange(len(spoken)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.arange(len(points)) - first
    left = np.repeat(sizes, sizes) - place
    numbers, owners = [], []
    gram = np.zeros(len(points), dtype=np.uint64)
    for n in range(1, 6):
        ahead = np.zeros(len(points), dtype=np.uint64)
        ahead[: len(points) - n + 1] = points[n - 1 :]
        gram = (gram + ahead) * _SEEDS[n]
        on = left >= n if n < 4 else (left == n) | (place == 0) & (left >= n) if n == 4 else left == n
        numbers.append(gram[on] ^ gram[on] >> np.uint64(29))
        owners.append(owner[on])
    known = [(j, lexicon[cores[i]]) for j, i in enumerate(spoken) if cores[i] in lexicon]
    if known:
        at, number = np.array(known, dtype=np.int64).T
        numbers.append((number.astype(np.uint64) + np.uint64(1)) * _SEEDS[7])
        owners.append(at)
    mixed = np.concatenate(numbers) * _SEEDS[0]
    return (mixed >> np.uint64(64 - N_BITS)).astype(np.int64), spoken[np.concatenate(owners)]


class Potentials:
    """Emission potentials of words, worked out once a word."""

    def __init__(self, weights: np.ndarray, lexicon: dict[str, int]):
        self.weights, self.lexicon = weights, lexicon
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.rows = np.zeros((1024, self.weights.shape[1] + 1), dtype=np.float32)  # last column: has a letter

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.known) > MAX_KNOWN_WORDS:
            self.clear()
        found = list(map(self.known.get, words))
        if None in found:
            new = list({w for w, i in zip(words, found, strict=True) if i is None})
            begin, k = len(self.known), self.weights.shape[1]
            self.known.update(zip(new, range(begin, begin + len(new)), strict=True))
            while len(self.known) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            flat, owner = word_features(new, self.lexicon)
            for j in range(k):
                self.rows[begin : begin + len(new), j] = np.bincount(owner, self.weights[flat, j], len(new))
            self.rows[begin : begin + len(new), k] = np.bincount(owner, minlength=len(new)) > 0
            found = [i if i is not None else self.known[w] for w, i in zip(words, found, strict=True)]
        return self.rows[found]


def chain_rows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain, for texts of so many words that stand one after another."""
    n = -(-counts // CHAIN)
    begin = np.repeat(np.cumsum(counts) - counts, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * CHAIN
    return begin, np.minimum(CHAIN, np.repeat(np.cumsum(counts), n) - begin)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (chains, steps, labels), expected moves and log-likelihood's partition sum; emission is padded at the ends."""
    n, steps, k = emission.shape
    top = emission.max(axis=2, keepdims=True)
    psi = np.exp(emission - top)
    a, begin = np.exp(moves), np.exp(start)
    inside = np.arange(steps)[None, :] < lengths[:, None]
    alpha, scale = np.zeros((n, steps, k)), np.ones((n, steps))
    alpha[:, 0] = begin * psi[:, 0]
    for t in range(steps):
        if t:
            alpha[:, t] = np.where(inside[:, t, None], (alpha[:, t - 1] @ a) * psi[:, t], alpha[:, t - 1])
        scale[:, t] = alpha[:, t].sum(axis=1)
        alpha[:, t] /= scale[:, t, None]
    beta = np.ones((n, k))
    marginal = np.empty_like(alpha)
    expected = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        m = alpha[:, t] * beta
        marginal[:, t] = m / m.sum(axis=1, keepdims=True)
        if t:
            on = inside[:, t]
            ahead = psi[on, t] * beta[on]
            back = ahead @ a.T
            pair = alpha[on, t - 1, :, None] * a[None] * ahead[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            beta[on] = back / back.sum(axis=1, keepdims=True)
    z = float((np.log(scale) * inside).sum() + (top[:, :, 0] * inside).sum())
    return marginal, expected, z


def train(found: dict[str, list[list[str]]], rounds: int = 40, seed: int = 4) -> dict:
    """Weights, moves, start and lexicon from some chains of lower-cased words of each language."""
    labels, rng = sorted(found), np.random.default_rng(seed)
    chains: list[tuple[list[str], list[int]]] = []
    for y, label in enumerate(labels):
        own = found[label]
        own = [own[i] for i in sorted(rng.permutation(len(own))[:TRAIN_CHAINS])]
        chains += [(w, [y] * len(w)) for w in own]
    pool = list(chains)
    for _ in range(len(pool) // 4):  # spliced chains: spans of several languages
        words: list[str] = []
        ys: list[int] = []
        while len(words) < CHAIN:
            w, y = pool[rng.integers(len(pool))]
            n = int(rng.integers(4, 24))
            at = int(rng.integers(max(1, len(w) - n + 1)))
            words += w[at : at + n]
            ys += y[at : at + n]
        chains.append((words[:CHAIN], ys[:CHAIN]))
    seen: dict[str, int] = {}
    for w, _ in pool:
        for x in w:
            core = core_of(x)
            seen[core] = seen.get(core, 0) + 1
    lexicon = {w: i for i, w in enumerate(sorted(w for w, n in seen.items() if n >= 3 and w))}
    vocab = {w: i for i, w in enumerate(dict.fromkeys(x for w, _ in chains for x in w))}
    flat, owner = word_features(list(vocab), lexicon)
    k, n = len(labels), len(chains)
    at, gold, lengths = np.zeros((n, CHAIN), dtype=np.int64), np.zeros((n, CHAIN), dtype=np.int64), np.array([len(w) for w, _ in chains])
    for i, (w, y) in enumerate(chains):
        at[i, : len(w)] = [vocab[x] for x in w]
        gold[i, : len(w)] = y
    inside = np.arange(CHAIN)[None, :] < lengths[:, None]
    truth = np.eye(k)[gold] * inside[:, :, None]
    gold_moves = np.zeros((k, k))
    np.add.at(gold_moves, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    weights, moves, start = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros(k)
    params = [weights, moves, start]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    total = max(1, int(lengths.sum()))
    for step in range(1, rounds + 1):
        word_scores = np.stack([np.bincount(owner, weights[flat, j], len(vocab)) for j in range(k)], axis=1)
        emission = word_scores[at] * inside[:, :, None]
        marginal, expected, _ = forward_backward(emission, lengths, moves, start)
        wrong = truth - marginal * inside[:, :, None]
        by_word = np.stack([np.bincount(at.ravel(), wrong[:, :, j].ravel(), len(vocab)) for j in range(k)], axis=1)
        by_feature = np.stack([np.bincount(flat, by_word[owner, j], N_FEATURES) for j in range(k)], axis=1)
        for j, (p, g) in enumerate(zip(params, (by_feature, gold_moves - expected, wrong[:, 0].sum(axis=0)), strict=True)):
            g = g / total - 1e-6 * p
            first[j] = 0.9 * first[j] + 0.1 * g
            second[j] = 0.99 * second[j] + 0.01 * g * g
            p += 0.15 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-9)
    return {"labels": labels, "weights": weights.astype(np.float32), "moves": moves, "start": start, "lexicon": lexicon}


def chains_of(text: str) -> list[list[str]]:
    words = [w[:TRAIN_CHARS] for w in text.lower().split()]
    return [words[i : i + CHAIN] for i in range(0, len(words), CHAIN)]


def training_chains(docs: DataFrame, text: str, lang: str, key: str, usable: Column, max_languages: int = MAX_LANGUAGES) -> dict[str, list[list[str]]]:
    """At most TRAIN_CHAINS chains of each language, from the documents with the lowest key hashes; only these reach the driver."""
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(1 << 40)))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not counts:
        return {}
    # Twice the share that gives TRAIN_DOCS on average and at least all of a small language: then the lowest hashes of those.
    limits = [(r["lang"], min(1 << 40, int((1 << 40) * 2 * TRAIN_DOCS / max(r["count"], 1)))) for r in counts]
    limits = docs.sparkSession.createDataFrame(limits, "lang string, most long")
    rows = rows.join(F.broadcast(limits), "lang").filter("h < most")
    low = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))).filter(F.col("at") <= TRAIN_DOCS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lang_, at, t in zip(f["lang"], f["at"], f["text"], strict=True):
                made = chains_of(t)
                order = sorted((zlib.crc32(f"{at} {i}".encode()), i) for i in range(len(made)))[:TRAIN_CHAINS]
                if not made:
                    continue
                yield pd.DataFrame({"lang": lang_, "c": [c for c, _ in order], "at": at, "i": [i for _, i in order], "words": [made[i] for _, i in order]})

    made = low.select("lang", "at", "text").mapInPandas(run, "lang string, c long, at int, i int, words array<string>")
    first = Window.partitionBy("lang").orderBy("c", "at", "i")
    made = made.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= TRAIN_CHAINS)
    out: dict[str, list[tuple[int, list[str]]]] = {}
    for r in made.select("lang", "n", "words").collect():
        out.setdefault(r["lang"], []).append((r["n"], r["words"]))
    return {k: [w for _, w in sorted(v)] for k, v in out.items()}


def segments(text: str) -> Iterator[str]:
    """The text in pieces of at most SEGMENT characters, cut at white space; a longer word stays whole."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = max(text.rfind(" ", at, at + SEGMENT), text.rfind("\n", at, at + SEGMENT))
        if cut <= at:
            blank = re.compile(r"\s").search(text, at + 1)
            cut = blank.start() if blank else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


class _Labels:
    """Labels of the words of texts: sums of marginals a document, and the words' labels where they are wanted."""

    def __init__(self, model: dict, n_docs: int, with_words: bool) -> None:
        self.model, self.labels = model, np.array(model["labels"], dtype=object)
        self.potentials = Potentials(model["weights"], model["lexicon"])
        self.reset(n_docs, with_words)

    def reset(self, n_docs: int, with_words: bool) -> None:
        self.spoken, self.sums = np.zeros(n_docs), np.zeros((n_docs, len(self.labels)))
        self.words: list[list[str]] | None = [[] for _ in range(n_docs)] if with_words else None

    def add(self, docs: list[int], texts: list[str]) -> None:
        k = len(self.labels)
        split = [t.lower().split() for t in texts]
        counts = np.array([len(w) for w in split], dtype=np.int64)
        if not counts.sum():
            return
        scored = self.potentials.of([x for w in split for x in w])
        begin, lengths = chain_rows(counts)
        owner = np.repeat(np.array(docs), counts)
        named = np.empty(len(scored), dtype=object)
        for at in range(0, len(begin), SLICE):
            b, n = begin[at : at + SLICE], lengths[at : at + SLICE]
            inside = np.arange(CHAIN)[None, :] < n[:, None]
            spot = np.minimum(b[:, None] + np.arange(CHAIN), len(scored) - 1)
            emission = scored[spot, :k].astype(np.float64) * inside[:, :, None]
            marginal = forward_backward(emission, n, self.model["moves"], self.model["start"])[0][inside]  # in the words' order
            own = slice(int(b[0]), int(b[0]) + len(marginal))
            spoken = scored[own, k] > 0
            np.add.at(self.spoken, owner[own], spoken)
            for j in range(k):
                self.sums[:, j] += np.bincount(owner[own], marginal[:, j] * spoken, len(self.sums))
            if self.words is not None:
                named[own] = np.where(spoken, self.labels[marginal.argmax(axis=1)], "und")
        if self.words is not None:
            ends = np.cumsum(counts)
            for d, e, c in zip(docs, ends, counts, strict=True):
                self.words[d] += named[e - c : e].tolist()

    def result(self) -> tuple[list[str], np.ndarray]:
        best, on = self.sums.argmax(axis=1), self.spoken > 0
        langs = np.where(on, self.labels[best], "und").tolist()
        share = self.sums[np.arange(len(best)), best] / np.maximum(self.spoken, 1)
        return langs, np.where(on, np.minimum(1.0, share), 0.0)


def label_documents(docs: DataFrame, model: dict | None, text: str = "text", keys: tuple[str, ...] = ("doc_id",), with_words: bool = False) -> DataFrame:
    """Per document: keys, lang_pred and score, and with ``with_words`` the label of each white-space word."""
    out = StructType([docs.schema[k] for k in keys])
    for f in StructType.fromDDL("lang_pred string, score double" + (", word_langs array<string>" if with_words else "")):
        out.add(f)
    held = docs.sparkSession.sparkContext.broadcast(model or {"labels": ["und"], "weights": np.zeros((N_FEATURES, 1), np.float32), "moves": np.zeros((1, 1)), "start": np.zeros(1), "lexicon": {}})
    trained = model is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _Labels(held.value, 0, with_words)
        for whole in batches:
            for row in range(0, whole.num_rows, 1000):
                batch = whole.slice(row, 1000)
                labels.reset(batch.num_rows, with_words)
                owners, parts, size = [], [], 0
                for i, t in enumerate(batch.column(len(keys)).to_pylist()):
                    for part in segments(t or ""):
                        owners.append(i)
                        parts.append(part)
                        size += len(part)
                        if size >= 2 * SEGMENT:
                            labels.add(owners, parts)
                            owners, parts, size = [], [], 0
                labels.add(owners, parts)
                langs, scores = labels.result()
                columns = [batch.column(j) for j in range(len(keys))] + [pa.array(langs, pa.string()), pa.array(scores if trained else scores * 0, pa.float64())]
                if with_words:
                    columns.append(pa.array(labels.words, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return docs.select(*[F.col(f"`{k}`") for k in keys], F.col(text)).mapInArrow(run, out)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """Train on the documents that are not held out and label them all: key, held_out, lang_pred, score."""
    chains = training_chains(docs, text, lang, key, ~held_out(key) & F.col(key).isNotNull(), max_languages)
    found = label_documents(docs, train(chains) if chains else None, text, (key,))
    return found.select(F.col(key), held_out(key).alias("held_out"), "lang_pred", "score")
