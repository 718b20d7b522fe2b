"""Suffix-array, substring and n-gram dedup against brute force, with the awkward rows among the documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from kindred.llm import blocks, ngram_join, substring_dedup, suffix_dedup
from kindred.llm.common import components

SCHEMA = "doc_id long, text string, n_words int, kept string"


def corpus(seed=5):
    dice = random.Random(seed)
    words = ["ab", "cde", "é", "zzz", "x", "Foo", "bar,", "日本"] + [f"w{i}" for i in range(60)]
    make = lambda n: " ".join(dice.choice(words) for _ in range(n))
    shared, line = make(70), make(30)
    texts = [make(dice.randrange(1, 150)) for _ in range(40)]
    texts += [make(20) + " " + shared + "\n" + make(10) for _ in range(6)]
    texts += [line] * 5 + [line + " " + make(4) for _ in range(8)]
    base = make(160).split()
    for _ in range(12):
        near = list(base)
        for _ in range(dice.randrange(0, 4)):
            near[dice.randrange(len(near))] = dice.choice(words)
        texts.append(" ".join(near))
    texts += ["", None, "   ", "a" * 900, "aba " * 300, make(5000), texts[3], texts[3], "one two", "ONE two", "one  two"]
    dice.shuffle(texts)
    return [(i, t, 1, "k") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


def same(found, wanted):
    assert len(found) == len(wanted)
    for key, value in wanted.items():
        assert found[key] == value, key


def test_suffix(spark, rows):
    length = 40
    data = {i: (t or "").encode() for i, t, *_ in rows}
    count = Counter(b[k : k + length] for b in data.values() for k in range(len(b) - length + 1))
    wanted = {}
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        wanted[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    out = suffix_dedup.dedup(spark.createDataFrame(rows, SCHEMA), length).collect()
    same({r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out}, wanted)


@pytest.mark.parametrize("hot", [1000, 2])
def test_substring(spark, rows, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    length = 20
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k : k + length]), i)
    wanted = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        wanted[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    out = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA), length).collect()
    same({r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out}, wanted)


def test_suffix_hot(spark, rows, monkeypatch):
    few = [r for r in rows if len(r[1] or "") < 2000]
    one = suffix_dedup.dedup(spark.createDataFrame(few, SCHEMA), 40).orderBy("doc_id").collect()
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    assert suffix_dedup.dedup(spark.createDataFrame(few, SCHEMA), 40).orderBy("doc_id").collect() == one


def test_repeated_rows_and_empty_tables(spark):
    text = "".join(chr(97 + i % 26) + str(i) for i in range(100))
    twice = [(1, text, 1, "k"), (1, text, 1, "k"), (None, "x", 1, "k")]
    out = suffix_dedup.dedup(spark.createDataFrame(twice, SCHEMA)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in out) == [(1, 0), (len(text), len(text)), (len(text), len(text))]
    words = " ".join(f"w{i}" for i in range(60))
    out = substring_dedup.dedup(spark.createDataFrame([(1, words, 1, "k"), (1, words, 1, "k"), (None, words, 1, "k")], SCHEMA)).collect()
    assert sorted(r.n_removed for r in out) == [0, 60, 60]  # a null doc_id is the smallest
    out = ngram_join.join(spark.createDataFrame([(2, words, 1, "k"), (2, words, 1, "k"), (5, words, 1, "k"), (None, "x", 1, "k")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out) == [(0, 0), (2, 2), (2, 2), (5, 2)]
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup(none).count() == substring_dedup.dedup(none).count() == ngram_join.join(none).count() == 0


def brute_components(rows, width=5, percent=75):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("seed", [5, 6])
@pytest.mark.parametrize("frequent", [(1 / 64, 32), (0.02, 2)])
def test_ngram_join(spark, seed, frequent, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    rows = corpus(seed)
    out = ngram_join.join(spark.createDataFrame(rows, SCHEMA)).collect()
    same({r.doc_id: (r.n_shingles, r.component_id) for r in out}, brute_components(rows))


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(found[i] == 0 for i in range(1, 41)) and found[100] == 90 and found[95] == 90


def test_suffix_order_and_prefixes():
    dice = np.random.default_rng(1)
    parts = [dice.integers(97, 99, size=n).astype(np.uint8) for n in (30, 25, 40, 3)]
    flags = suffix_dedup.solver(6)([blocks.Block(1, k, 0, 0, p.tobytes()) for k, p in enumerate(parts)])
    count = Counter(p[k : k + 6].tobytes() for p in parts for k in range(len(p) - 5))
    for p, f in zip(parts, flags):
        assert f.tolist() == [count[p[k : k + 6].tobytes()] > 1 for k in range(len(p) - 5)]
