"""Quality by neighbours, row patterns and conversation tries: against plain versions, with the awkward cases."""

import datetime as dt
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import quality, queries, rowmatch, trie

# --- quality ----------------------------------------------------------------------------------------------------------


def prose(dice, n=60):
    return " ".join(dice.choice(["the", "river", "went", "down", "to", "a", "small", "town", "where", "people", "sang"]) for _ in range(n)).capitalize() + "."


def junk(dice, n=60):
    return " ".join(dice.choice(["BUY", "NOW", "CHEAP"]) + dice.choice(["!!", "###", "***"]) for _ in range(n))


def test_quality_is_held_out_and_whole(spark):
    dice = random.Random(0)
    rows = [(i, junk(dice) if i % 4 == 0 else prose(dice), "clash", 1.0) for i in range(120)]
    rows += [(500, None, "", 1.0), (501, "", "", 1.0), (None, prose(dice), "", 1.0), (3, rows[3][1], "clash", 1.0), (502, prose(dice, 40_000), "", 1.0), (503, "\x00�中", "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality double")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(80)] + [(0, 1), (1, None), (None, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {(r.doc_id, i): r.quality for i, r in enumerate(quality.score(docs, model).orderBy("doc_id", "text").collect())}
    by_id = {}
    for (i, _), q in got.items():
        by_id.setdefault(i, []).append(q)
    assert len(got) == len(rows) and all(0 <= q <= 1 for q in got.values())
    assert all((by_id[i][0] >= 0.7) == (i % 4 != 0) for i in range(80, 120)) and by_id[502][0] >= 0.7 and len(set(by_id[3])) == 1
    assert by_id[500] == by_id[501] == [pytest.approx(model["y"].mean())]  # label 0 of document 0 holds, since the lowest counts
    assert quality.score(docs.limit(0), model).count() == 0
    nothing = quality.fit(docs, labels.where("false"))
    assert {r.quality for r in quality.score(docs, nothing).collect()} == {0.5}


def test_votes_against_a_plain_loop():
    dice = np.random.default_rng(1)
    known, z, y = (quality._unit(dice.standard_normal((n, 8))) if n != 30 else dice.integers(0, 2, 30).astype(float) for n in (31, 12, 30))
    known = known[:30]
    for k in (1, 5, 30, 90):
        wanted = []
        for row in z:
            near = sorted(((float(row @ x), t) for x, t in zip(known, y, strict=True)), reverse=True)[:k]
            total = sum(max(s, 0) ** 4 for s, _ in near)
            wanted.append(sum(max(s, 0) ** 4 * t for s, t in near) / total if total else y.mean())
        assert quality.votes(z, known, y, k, 4.0) == pytest.approx(wanted, rel=1e-4)
    assert quality.votes(np.zeros((1, 8), np.float32), known, y, 3, 4.0) == pytest.approx([y.mean()])


def test_quality_of_held_out_documents(spark):
    """Of the given tables: learnt from three quarters, right on the rest."""
    sf = "/root/testdata/sf0.1"
    scored = queries.op11_quality(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out")
    n, right = scored.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).first()
    assert n > 200 and right / n > 0.97


# --- row patterns -----------------------------------------------------------------------------------------------------


def plain_matches(rows, gap=900):
    """The search, letter by letter, with backtracking."""
    rows, out = {r for r in rows if r[3] is not None and r[1] is not None}, []
    for c in sorted({r[3] for r in rows}):
        own = sorted((r for r in rows if r[3] == c), key=lambda r: (r[1], r[0] is not None, r[0] or 0, r[4] is not None, r[4] or "", r[5] is not None, r[5] or 0))
        cents = [None if r[5] is None or not math.isfinite(r[5]) else math.floor(100 * r[5] + 0.5) for r in own]

        def fits(letter, i, a, own=own, cents=cents):
            if cents[i] is None:
                return False
            if letter == "A":
                return True
            if (own[i][1] - own[i - 1][1]).total_seconds() > gap:
                return False
            if letter == "P":
                return own[i][4] == "view" and cents[i] >= cents[a]
            if cents[i - 1] is None or own[i][4] in (None, "error"):
                return False
            return cents[i] < cents[i - 1] if letter == "D" else cents[i] > cents[i - 1]

        i = number = 0
        while i < len(own):
            found = None
            if fits("A", i, i):
                middle, j = "", i + 1
                while j < len(own) and (fits("D", j, i) or fits("U", j, i)):
                    middle += "D" if fits("D", j, i) else "U"
                    j += 1
                while found is None:
                    if j < len(own) and fits("P", j, i):
                        e = j
                        while e + 1 < len(own) and fits("D", e + 1, i):
                            e += 1
                        found = "A" + middle + "P" + "D" * (e - j), e
                    elif not middle:
                        break
                    else:
                        middle, j = middle[:-1], j - 1
            if found:
                number += 1
                out.append((c, number, own[i][0], own[found[1]][0], found[1] - i + 1, sum(cents[i : found[1] + 1]), found[0]))
                i = found[1]
            else:
                i += 1
    return sorted(out, key=lambda r: r[:2])


CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, labels string"


@pytest.mark.parametrize(("seed", "n", "chunk", "fan"), [(1, 3, 1 << 16, 1024), (2, 300, 5, 2), (3, 300, 50, 1024), (5, 400, 1 << 16, 2), (6, 250, 7, 1024)])
def test_row_pattern(spark, monkeypatch, seed, n, chunk, fan):
    """Small chunks and many tasks cut sessions everywhere; even seeds have no errors, so their sessions are long."""
    monkeypatch.setattr(rowmatch, "CHUNK", chunk)
    monkeypatch.setattr(rowmatch, "FAN", fan)
    dice, t, rows = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        t += dt.timedelta(seconds=dice.choice([0, 1, 60, 900, 900.000001]) if dice.random() < 0.3 else 5)
        value = dice.choice([None, float("nan"), -1.0, 1.0, 1.005, 2.5, 3.0]) if dice.random() < 0.1 else round(dice.uniform(0, 40), 2)
        kind = dice.choice(["view"] * 4 + ["click"] * 3 + (["error", None] if seed % 2 else []))
        rows.append((i if dice.random() < 0.97 else None, t if dice.random() < 0.98 else None, t, dice.choice([7, 7, 7, 1, None]), kind, value, "x"))
        if dice.random() < 0.05:
            rows.append(rows[-1])
    got = sorted(map(tuple, rowmatch.match(spark.createDataFrame(rows, CLICKS)).collect()), key=lambda r: r[:2])
    assert got == plain_matches([tuple(None if x != x else x for x in r) for r in rows])


def test_a_hot_client_is_cut_and_one_session_may_span_tasks(spark):
    """All rows are one session of one client: it is matched whole."""
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(2000):
        rows.append((i, start + dt.timedelta(seconds=i), start, 7, "view" if i % 3 else "click", float(i * 7919 % 1000), "x"))
    got = sorted(map(tuple, rowmatch.match(spark.createDataFrame(rows, CLICKS)).collect()), key=lambda r: r[:2])
    assert got == plain_matches(rows) and got[0][4] > 1000
    assert rowmatch.match(spark.createDataFrame([], CLICKS)).count() == 0


# --- conversations ----------------------------------------------------------------------------------------------------


def plain_trie(rows):
    convs, nodes, below = {}, {}, {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    for own in convs.values():
        own.sort(key=lambda z: z[0])
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        s = tuple(z[1:] for z in convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], ([], []))[0].append(c)
        nodes[s][1].append(c)
    for p in nodes:
        if p:
            below.setdefault(p[:-1], []).append(p)

    def under(p):
        yield p
        for q in below.get(p, ()):
            yield from under(q)

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    out = []
    for p, (members, ends) in nodes.items():
        every = list(under(p))
        saved = sum((len(nodes[q][0]) - 1) * words(q[-1][1]) for q in every if q)
        out.append((min(members), len(p), min(nodes[p[:-1]][0]) if p else None, len(members), len(below.get(p, ())), sum(q not in below for q in every), saved, hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest()))
    return sorted(out, key=str)


SHOWN = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("seed", "n", "parts", "span", "sample", "bound"), [(1, 1, 4, 4096, 4000, 409), (2, 60, 1, 2, 4000, 409), (3, 120, 9, 2, 4000, 409), (4, 120, 7, 4096, 5, 2), (5, 90, 5, 64, 30, 1)])
def test_trie(spark, monkeypatch, seed, n, parts, span, sample, bound):
    """Ranges cut between and inside shared paths; many equal conversations; null turns, roles, texts and ids."""
    for name, value in (("SPAN", span), ("SAMPLE", sample), ("BOUND", bound)):
        monkeypatch.setattr(trie, name, value)
    dice, rows = random.Random(seed), []
    for c in range(n):
        if dice.random() < 0.9:
            hot = dice.random() < 0.4
            rows += [(c if dice.random() < 0.99 else None, t or None, "user" if hot else dice.choice(["user", "system", None]), "a b" if hot else dice.choice(["a b", "a", "", None, "x  y z"]), 5) for t in range(dice.choice([1, 2, 3, 4, 6]))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        found = trie.build(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int"))
        assert sorted(map(tuple, found.select(SHOWN).collect()), key=str) == plain_trie([r[:4] for r in rows])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_of_nothing_and_of_equal_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.build(spark.createDataFrame([], schema)).count() == 0
    assert trie.build(spark.createDataFrame([(None, 1, "user", "x")], schema)).count() == 0
    rows = [(9, 1, "user", "y")] * 3 + [(9, None, None, "w " * 20_000)]
    assert sorted(map(tuple, trie.build(spark.createDataFrame(rows, schema)).select(SHOWN).collect()), key=str) == plain_trie(rows)


def test_loser_tree_merges_runs():
    dice = random.Random(4)
    record = lambda k: bytes([k]) * trie.RECORD
    every = sorted({b"".join(record(dice.randrange(3)) for _ in range(dice.randrange(6))) for _ in range(200)})
    dealt = [[] for _ in range(5)]
    for s in every:
        dealt[dice.randrange(5)].append(s)
    runs = []
    for run in dealt:
        lcps = [0, *(trie._shared(a, b) for a, b in zip(run, run[1:], strict=False))]
        runs.append(trie.Run([(k, s[k * trie.RECORD :], 1, 0, "") for k, s in zip(lcps, run, strict=True)]))
    got = [(s, k) for s, k, _ in trie.merged(runs)]
    assert [s for s, _ in got] == every and [k for _, k in got[1:]] == [trie._shared(a, b) for a, b in zip(every, every[1:], strict=False)]
