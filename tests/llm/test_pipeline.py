"""Every stage of the pipeline on the output of the one before, against a plain computation of what it must do."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafmill.llm import quality, secrets, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, target double"
KEY = "q8Zt4vKLm2NcXw9RbYs1HdTgUoPe6JfA"


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}x{'.' if k % 9 == 8 else ''}" for k, i in enumerate(rng.integers(0, 500, n)))


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as cp

    texts = [(i, prose(i, 60 + i % 50)) for i in range(50)]
    base = prose(900, 120)
    texts += [(100, base), (101, base), (102, base.replace("w", "W", 3)), (103, base + " and a tail of words"), (104, " ".join(base.split()[:70]))]
    texts += [(110, f'{prose(910, 70)}\nset api_key = "{KEY}" here\n{prose(911, 30)}'), (111, f"{prose(912, 80)}\nHome | About | Shop | Help\n{prose(913, 20)}")]
    texts += [(120, "too short"), (121, None), (122, ""), (123, "same line of words here\n" * 40), (124, "## $$ %% " * 60), (125, prose(920, 9000)), (None, prose(930, 90)), (None, prose(930, 90)), (7, prose(940, 75))]
    rows = [(i, t, "en", ["s1", "s2", None][k % 3], None if t is None else len(t), k % 2 == 0, float(k)) for k, (i, t) in enumerate(texts)]
    made = [("input", spark.createDataFrame(rows, COLUMNS).repartition(4).cache())]
    for name, stage in cp.STAGES:
        made.append((name, stage(spark, made[-1][1], "").cache()))
    return dict(made)


def test_stages_and_columns(stages):
    assert list(stages) == ["input", "quality rules", "near-duplicates", "secret scan", "source mixture", "best-fit packing"]
    for name in list(stages)[1:-1]:
        assert stages[name].columns == stages["input"].columns
        assert all(r.n_chars == len(r.text) for r in stages[name].select("n_chars", "text").collect() if name != "near-duplicates")


def fails(line: str, seen: set) -> bool:
    words, chars = WORD.findall(line), len("".join(WORD.findall(line)))
    if not chars:
        return False
    again, pipes = line in seen, line.count("|")
    symbols, shouts = len(re.findall(r"[#*$%&|<>]", line)), line.count("!!")
    furniture = len(words) <= 12 and any(x in line.lower() for x in quality.FURNITURE)
    return again or (pipes > 0 and pipes >= 0.2 * len(words)) or symbols > 0.1 * chars or (shouts > 0 and shouts >= 0.5 * len(words)) or furniture


def test_quality_stage(stages):
    want = []
    for r in stages["input"].collect():
        lines, seen, kept = (r.text or "").split("\n"), set(), []
        for line in lines:
            if not fails(line, seen):
                kept.append(line)
            seen.add(line)
        w = WORD.findall(r.text or "")
        windows = defaultdict(list)
        for i in range(len(w) - 2):
            windows[tuple(w[i : i + 3])].append(i)
        repeated = {j for v in windows.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        clean = "\n".join(kept)
        size = lambda t: len("".join(WORD.findall(t)))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and size(r.text) - size(clean) <= 0.4 * size(r.text):
            want.append((r.doc_id, clean, r.source, r.kept, r.target))
    got = [(r.doc_id, r.text, r.source, r.kept, r.target) for r in stages["quality rules"].collect()]
    assert Counter(got) == Counter(want) and 40 < len(got) < stages["input"].count()


def shingles(text: str) -> set:
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_near_duplicate_stage(stages):
    rows = stages["quality rules"].collect()
    sets, part = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                old = part[i]
                part = [part[j] if p == old else p for p in part]
    home = {r: p for r, p in zip(rows, part, strict=True)}
    left = stages["near-duplicates"].collect()
    assert Counter(home[r] for r in left) == Counter(dict.fromkeys(part, 1))
    for r in left:
        ids = [x.doc_id for x, p in zip(rows, part, strict=True) if p == home[r] and x.doc_id is not None]
        assert r.doc_id == min(ids, default=None)


def test_secret_stage(spark, stages):
    before, after = ({r.doc_id: r for r in stages[n].filter("doc_id is not null").collect()} for n in ("near-duplicates", "secret scan"))
    assert before.keys() == after.keys() and KEY in before[110].text and KEY not in after[110].text and "[SECRET]" in after[110].text
    assert all(before[i].text == after[i].text for i in before if i != 110)
    flagged = secrets.find_secrets(stages["secret scan"], [F.col("doc_id")]).filter("is_secret and finding not like '%SECRET%'")
    assert flagged.count() == 0


def test_mixture_stage(stages):
    before, after = stages["secret scan"].collect(), stages["source mixture"].collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(WORD.findall(r.text))
    for r in after:
        taken[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, total, capped = {s: 1 + i % 3 for i, s in enumerate(order)}, sum(sizes.values()), set()
    level = lambda: (total - 3 * sum(sizes[s] for s in capped)) / sum(weights[s] for s in order if s not in capped)
    while over := [s for s in order if s not in capped and level() * weights[s] > 3 * sizes[s]]:
        capped |= set(over)
    for s in order:
        target = 3 * sizes[s] if s in capped else level() * weights[s]
        assert abs(taken[s] - target) <= 64 + 0.02 * target
    mine = defaultdict(int)
    for r in after:
        mine[r.doc_id, r.kept, r.target] += len(WORD.findall(r.text))
    for r in before:
        assert mine[r.doc_id, r.kept, r.target] <= 3 * len(WORD.findall(r.text))


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokens.default_tokenizer())
    want = Counter()
    for r in stages["source mixture"].collect():
        want[r.doc_id] += len(tk.encode(r.text, add_special_tokens=False).ids) + 1
    got, bins = Counter(), defaultdict(list)
    for r in stages["best-fit packing"].collect():
        got[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want and len(bins) <= -(-sum(want.values()) // 2048) + 1
    for spans in bins.values():
        ends = [0, *(o + n for o, n in sorted(spans))]
        assert [o for o, _ in sorted(spans)] == ends[:-1] and ends[-1] <= 2048


def test_empty_input(spark, stages):
    import corpus_pipeline as cp

    docs = stages["input"].limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
