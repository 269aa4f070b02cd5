"""Spelling variants of a corpus vocabulary: words one edit apart, grouped under the far commoner spelling.

Two words one edit apart share a half: cut a word in two, and an inserted, deleted or replaced code point leaves the other half whole, at the front or
at the end of the other word. Shards hold the halves of their words in an Aho-Corasick automaton. Every word is scanned in the
shards that can hold a half of it; a match counts where the half stands at the word's front (first half) or end (second half), and what is left of
the two words must be one edit apart. That is verified on the pairs that share what a deletion leaves of the rests, so a half with very many words costs no
comparison of all of them. A pair whose halves both match is counted by the first.

A shard holds about ``SHARD_WORDS`` halves. A half with more words is dealt on a grid of its own: its words in parts, the words to scan in
blocks. A task keeps one shard's halves and reads the words to scan as a stream.

Edge cases: null text has no words and a null key counts as empty; repeated rows count again; words of any length are taken whole; of near words with equal counts the
smallest in code-point order is the form; an empty table gives an empty result; other columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHARD_WORDS = 4000
#: Halves with more words than a shard takes are broadcast up to this many (about 60 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_HOT = 20_000
#: Rests longer than this are compared by hashes of what a deletion leaves of them, so that a word of n code points needs n numbers.
LONG = 64
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _lowered(run: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.when(F.octet_length(run) == F.char_length(run), F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def misspelt_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", one_in: int = 199) -> DataFrame:
    """``word``: a row for each run of letters, lower-cased; where the crc32 of key and run is a multiple of ``one_in``, a code point is deleted."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.select("key", _lowered(F.col("run")).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``word, n``: words of some length that are common enough."""
    return words.filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _half(which: int, seg: Column) -> Column:
    return F.struct(F.lit(which).alias("which"), seg.alias("seg"))


def _dealt(words: DataFrame, shard_words: int) -> DataFrame:
    """shard, kind (0 and 1: a word whose first or second half the shard holds, 2: a word to scan), word, n."""
    size, front = F.char_length("word"), lambda k: F.substring("word", F.lit(1), k)
    end = lambda k: F.substring("word", size - k + 1, k)
    mid, low = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")
    held = words.select("word", "n", F.inline(F.array(_half(0, front(mid)), _half(1, end(size - mid)))))
    # Halves of words that are shorter or longer by one have other lengths.
    sought = words.select("word", "n", F.inline(F.array(_half(0, front(low)), _half(0, front(low + 1)), _half(1, end(mid)), _half(1, end(mid + 1)))))
    hot = materialise(held.groupBy("which", "seg").count().filter(F.col("count") > shard_words), "hot-halves")
    parts = hot.select("which", "seg", F.ceil(F.col("count") / shard_words).cast("int").alias("parts"))
    parts = F.broadcast(parts) if hot.count() <= MAX_BROADCAST_HOT else parts
    shards = max(1, -(-2 * words.count() // shard_words))
    own = F.pmod(F.xxhash64("which", "seg"), F.lit(shards)).cast("string")
    one = F.pmod(F.xxhash64("word"), F.col("parts"))
    every = F.explode(F.coalesce(F.sequence(F.lit(0), F.col("parts") - 1), F.array(F.lit(0))))

    def rows(halves: DataFrame, kind: Column, part: Column, block: Column) -> DataFrame:
        found = halves.join(parts, ["which", "seg"], "left").withColumn("other", every)
        cell = F.concat_ws(":", F.col("which"), F.col("seg"), part, block)
        return found.select(F.when(F.col("parts").isNull(), own).otherwise(cell).alias("shard"), kind.alias("kind"), "word", "n")

    return rows(held, F.col("which"), one, F.col("other")).unionByName(rows(sought, F.lit(2), F.col("other"), one).distinct())


def shortened(rest: str) -> set[str | int]:
    """The text and what is left of it without any one code point; texts over LONG as hashes."""
    n = len(rest)
    if n <= LONG:
        return {rest, *[rest[:i] + rest[i + 1 :] for i in range(n)]}
    tail, power = [0] * (n + 1), [1] * (n + 1)  # hashes of the text from i on
    for i in range(n - 1, -1, -1):
        power[n - i] = power[n - i - 1] * _BASE % _MOD
        tail[i] = (ord(rest[i]) * power[n - i - 1] + tail[i + 1]) % _MOD
    out, head = {tail[0]}, 0
    for i in range(n):
        out.add(rest[:i] + rest[i + 1 :] if n - 1 <= LONG else (head * power[n - 1 - i] + tail[i + 1]) % _MOD)
        head = (head * _BASE + ord(rest[i])) % _MOD
    return out


def one_edit(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


class Shard:
    """Halves of words in one automaton; each half has its words by what a deletion leaves of their rests."""

    def __init__(self) -> None:
        self.words: list[tuple[str, int]] = []
        self.halves: dict[str, tuple[dict, dict]] = {}
        self.automaton: ahocorasick.Automaton | None = None

    def hold(self, which: int, word: str, n: int) -> None:
        mid = len(word) // 2
        seg, rest = (word[:mid], word[mid:]) if which == 0 else (word[mid:], word[:mid])
        index = self.halves.setdefault(seg, ({}, {}))[which]
        for v in shortened(rest):
            index.setdefault(v, []).append(len(self.words))
        self.words.append((word, n))

    def near(self, word: str) -> list[tuple[str, int]]:
        """The shard's words one edit from this one; over all shards each once."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for seg, indexes in self.halves.items():
                self.automaton.add_word(seg, (len(seg), *indexes))
            self.automaton.make_automaton()
        out = []
        for last, (size, first, second) in self.automaton.iter(word) if self.halves else ():
            if first and last == size - 1:  # a first half at the front
                out += [w for w in self._candidates(first, word[size:]) if one_edit(word[size:], w[0][size:])]
            if second and last == len(word) - 1:  # a second half at the end; the rests are what stands before
                rest = word[:-size]
                out += [w for w in self._candidates(second, rest) if one_edit(rest, w[0][:-size]) and not word.startswith(w[0][:-size])]
        return out

    def _candidates(self, index: dict, rest: str) -> list[tuple[str, int]]:
        return [self.words[i] for i in {i for v in shortened(rest) for i in index.get(v, ())}]


OUT = "word string, n_near long, best string, best_n long"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and kind: the shard's halves first, then the words to scan."""
    at, shard = None, Shard()
    for batch in batches:
        out: list[tuple[str, int, str, int]] = []
        for name, kind, word, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if name != at:
                at, shard = name, Shard()
            if kind < 2:
                shard.hold(kind, word, n)
            elif found := shard.near(word):
                out.append((word, len(found), *min(found, key=lambda w: (-w[1], w[0]))))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        types = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "n_near", "best", "best_n"])


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n_near, best, best_n`` for the words of ``word, n`` that have near words: how many, and the commonest of them."""
    spark = words.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(words, shard_words).repartition(tasks, "shard").sortWithinPartitions("shard", "kind")
    best = F.min(F.struct(-F.col("best_n"), F.col("best"))).alias("b")
    found = dealt.mapInArrow(_scan, OUT).groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.col1")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of a table ``word, form`` without circles: the last form of each word's chain, by doubling the steps."""
    step = materialise(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialise(step.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = further.select("word", "root")
        step._table = further._table
        if further.filter("moved").isEmpty():
            return step


def group_variants(words: DataFrame, ratio: int = 5, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for a table ``word, n`` of distinct words.

    The form is the commonest near word, if it is at least ``ratio`` times as common; the root is the last of the chain of forms.
    """
    with scratch(words.sparkSession) as kept:
        words = materialise(words, "vocabulary")
        good = F.col("best_n") >= ratio * F.col("n")
        found = words.join(near_words(words, shard_words), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")
        )
        found = materialise(found, "near-words")
        last = roots(found.filter("form is not null"))
        out = materialise(found.join(last, "word", "left").withColumn("root", F.coalesce("root", "word")), "variants")
        kept.append(out)
    return out


def spelling_variants(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The words of whole texts with their forms and roots."""
    return group_variants(vocabulary(misspelt_runs(docs, text, key)))
