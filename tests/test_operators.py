"""Matching against sequential models, scores against literal values, attribution, safety and registry."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred import config, schemas
from kindred.functions import columns as C
from kindred.operators import attribution as A
from kindred.operators import matching as M
from kindred.operators import scoring as S
from kindred.operators.graph import components
from kindred.plans import registry
from kindred.sources import archive


def sequential(edges, threshold, cap):
    used, out = set(), {}
    for left in sorted({e[0] for e in edges}):
        free = [e for e in edges if e[0] == left and e[1] not in used]
        if not free:
            continue
        tier = min(e[2] for e in free)
        order = sorted((e for e in free if e[2] == tier), key=lambda e: (-e[3], e[1]))[:cap]
        best = None
        for e in order:
            if e[4] >= threshold and (best is None or e[4] > best[4]):
                best = e
        if best:
            used.add(best[1])
            out[left] = best[1]
    return out


@pytest.mark.parametrize(("seed", "settled", "n"), [(0, 200_000, 45), (2, 4, 14), (3, 0, 7)])
def test_resolve(spark, monkeypatch, seed, settled, n):
    """In one task, in rounds alone, and with components of several sizes: always the sequential outcome."""
    monkeypatch.setattr(M, "SETTLED", settled)
    dice = random.Random(seed)
    pairs = {(dice.randrange(12), dice.randrange(10)) for _ in range(n)}
    edges = [(a, b, dice.randrange(2), dice.randrange(4), dice.choice([0.5, 0.7, 0.8, 0.9])) for a, b in sorted(pairs)]
    got = M.resolve(spark.createDataFrame(edges, schemas.EDGES), threshold=0.7, cap=3).collect()
    assert {r.l: r.r for r in got} == sequential(edges, 0.7, 3)


def test_tie_takes_the_lowest_index_and_the_cap_counts_free_ones(spark):
    edges = [(1, r, 0, 5, 0.8) for r in range(31)]
    assert M.resolve(spark.createDataFrame(edges, schemas.EDGES), threshold=0.7, cap=30).first().r == 0
    many = [(left, r, 0, 5, 0.8) for left in range(31) for r in range(31)]
    got = M.resolve(spark.createDataFrame(many, schemas.EDGES), threshold=0.7, cap=30).collect()
    assert {r.l: r.r for r in got} == {i: i for i in range(31)}


def test_what_a_later_left_takes_still_fills_the_cap(spark, monkeypatch):
    """2 looks at 20, which is below the threshold but free in its turn, and so not at 21; that 3, which waits for none, takes 20 is later."""
    monkeypatch.setattr(M, "SETTLED", 0)
    edges = [(1, 22, 1, 5, 0.9), (2, 22, 1, 9, 0.8), (2, 20, 1, 7, 0.2), (2, 21, 1, 6, 0.9), (3, 20, 1, 5, 0.9)]
    got = M.resolve(spark.createDataFrame(edges, schemas.EDGES), threshold=0.7, cap=1).collect()
    assert {r.l: r.r for r in got} == sequential(edges, 0.7, 1) == {1: 22, 3: 20}


def test_a_large_component_takes_few_rounds(spark, monkeypatch):
    """All lefts want the same rights, so each waits for the one before: blocks of lefts, not lefts, are rounds."""
    monkeypatch.setattr(M, "SETTLED", 150)
    rounds, kept = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: rounds.append(what) or kept(df, what))
    edges = [(a, b, 1, b % 3, 0.5 + (a * b) % 5 / 10) for a in range(20) for b in range(20)]
    got = M.resolve(spark.createDataFrame(edges, schemas.EDGES), threshold=0.7, cap=6).collect()
    assert {r.l: r.r for r in got} == sequential(edges, 0.7, 6)
    assert 1 < rounds.count("matches") <= 4 and len(rounds) <= 20


def test_edges_that_decide_nothing_are_dropped(spark):
    """Of 200 listed rights those before the last that can win, and of these the ones that another left may take."""
    edges = [(1, r, 1, 500 - r, 0.9 if r == 12 else 0.1) for r in range(200)] + [(0, r, 1, 1, 0.8) for r in (4, 12, 50)]
    df = spark.createDataFrame(edges, schemas.EDGES)
    rows = {(r.l, r.r): (r.base, r.contested) for r in M.deciding(df, 12, 0.7).collect()}
    assert rows == {(0, 4): (0, False), (0, 12): (1, False), (0, 50): (2, False), (1, 4): (4, True), (1, 12): (11, True)}
    assert {(r.l, r.r) for r in M.deciding(df, 13, 0.7).collect()} == rows.keys() - {(1, 4)}
    assert {r.l: r.r for r in M.resolve(df, threshold=0.7, cap=12).collect()} == sequential(edges, 0.7, 12)


def test_ranked_in_buckets(spark):
    rows = [(i % 3, i) for i in range(50)]
    got = M.ranked(spark.createDataFrame(rows, "g long, ord long"), ["g"], "ord", bucket=7).collect()
    assert all(r.k == r.ord // 3 + 1 for r in got) and len(got) == 50


def files(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, path string, size long, sha256 string, semantic_hash string")


def test_file_match(spark):
    left = files(spark, [("a", 10, "s1", "m1"), ("b", 10, "s1", "m1"), ("c", 10, "s9", "m2"), ("d", 10, "s8", None)])
    right = files(spark, [("x", 10, "s1", "m1"), ("y", 10, "s2", "m2"), ("z", 10, "s3", "m1")])
    # b has the content of x, which is taken: the semantic hash is not tried
    assert {r.l: r.r for r in M.match_files(left, right).collect()} == {0: 0, 2: 1}


def test_components(spark):
    dice = random.Random(3)
    links = [(dice.randrange(90), dice.randrange(90)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    low = {x: x for pair in links for x in pair}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: low[x] for a, b in links if a != b for x in (a, b)}


def test_a_left_waits_only_for_those_that_can_win(spark, monkeypatch):
    """Edges below the threshold decide nothing: a chain of them takes no round each."""
    monkeypatch.setattr(M, "SETTLED", 0)
    rounds, kept = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: rounds.append(what) or kept(df, what))
    edges = [(i, i + k, 0, 1, 0.9 if k else 0.2) for i in range(20) for k in (0, 1)]
    got = M.resolve(spark.createDataFrame(edges, schemas.EDGES), threshold=0.7, cap=30).collect()
    assert {r.l: r.r for r in got} == {i: i + 1 for i in range(20)} and rounds.count("matches") <= 3


def test_file_match_takes_a_round_for_a_group(spark, monkeypatch):
    """A hot content is decided by rank: neither its pairs are listed nor is a round needed for each left."""
    monkeypatch.setattr(M, "SETTLED", 0)
    rounds, kept = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: rounds.append(what) or kept(df, what))
    hot = files(spark, [("p", 10, "hot", "m")] * 40)
    assert {r.l: r.r for r in M.match_files(hot, hot.where("ord > 5")).collect()} == {i: i + 6 for i in range(34)}
    assert rounds.count("matches") == 1


@pytest.mark.parametrize(("settled", "n"), [(0, 4), (200_000, 24)])
def test_file_match_of_mixed_groups(spark, monkeypatch, settled, n):
    monkeypatch.setattr(M, "SETTLED", settled)
    dice = random.Random(5)
    make = lambda n: [("p", 10, dice.choice("ABCDE"), dice.choice(["m", "n", None])) for _ in range(n)]
    left, right = make(n) + [("p", 10, f"own{i}", dice.choice("mn")) for i in range(n // 4)], make(n)
    dice.shuffle(left)
    used, wanted = set(), {}
    for i, x in enumerate(left):
        mine = [k for k, y in enumerate(right) if y[2] == x[2]] or [k for k, y in enumerate(right) if x[3] and y[3] == x[3]]
        free = [k for k in mine if k not in used]
        if free:
            wanted[i] = free[0]
            used.add(free[0])
    assert {r.l: r.r for r in M.match_files(files(spark, left), files(spark, right)).collect()} == wanted
    assert M.match_files(files(spark, left), files(spark, right).where("false")).count() == 0


def test_image_threshold(spark):
    base = 0x0123456789ABCDEF
    near, far = base ^ 0b1111111111, base ^ 0b11111111111
    table = lambda rows: spark.createDataFrame([(i, f"{h:016x}" if h is not None else None, s) for i, (h, s) in enumerate(rows)], "ord long, perceptual_hash string, sha256 string")
    got = M.match_images(table([(base, "a"), (base, "b"), (None, "c")]), table([(near, "x"), (far, "y"), (None, "c")])).collect()
    assert {(r.l, r.r, r.sim) for r in got} == {(0, 0, 54 / 64), (2, 2, 1.0)}


@pytest.mark.parametrize(("seed", "settled", "n"), [(0, 0, 6), (2, 40, 12), (3, 200_000, 30)])
def test_image_classes_follow_the_sequential_rule(spark, monkeypatch, seed, settled, n):
    """Few hashes, many equal images, contents without a hash or with several."""
    monkeypatch.setattr(M, "SETTLED", settled)
    dice = random.Random(seed)
    base = [dice.getrandbits(64) for _ in range(3)]
    hashes = base + [base[0] ^ 7, base[0] ^ 0xFF, base[1] ^ 1, None]
    make = lambda n: [(dice.choice(hashes), dice.choice("abcd")) if dice.random() < 0.5 else (base[0], "a") for _ in range(n)]
    left, right = make(n), make(n - 1)
    used, wanted = set(), {}
    for i, (h, s) in enumerate(left):
        best = None
        for k, (g, t) in enumerate(right):
            apart = 0 if s == t else 65 if h is None or g is None else bin(h ^ g).count("1")
            if k not in used and apart <= 10 and (best is None or apart < best[0]):
                best = (apart, k)
        if best:
            used.add(best[1])
            wanted[i] = (best[1], 1 - best[0] / 64)
    table = lambda rows: spark.createDataFrame([(i, f"{h:016x}" if h is not None else None, s) for i, (h, s) in enumerate(rows)], "ord long, perceptual_hash string, sha256 string")
    assert {r.l: (r.r, r.sim) for r in M.match_images(table(left), table(right)).collect()} == wanted


def test_hot_images_take_one_round(spark, monkeypatch):
    monkeypatch.setattr(M, "SETTLED", 0)
    rounds, kept = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: rounds.append(what) or kept(df, what))
    hot = spark.range(10_000).select(F.col("id").alias("ord"), F.lit("00ff00ff00ff00ff").alias("perceptual_hash"), F.lit("same").alias("sha256"))
    assert M.match_images(hot, hot.where("ord >= 100")).where("sim = 1 and r = l + 100").count() == 9_900
    assert rounds.count("matches") == 1


def test_banding_loses_nothing(spark):
    dice = random.Random(1)
    make = lambda: [dice.getrandbits(64) - (1 << 63) for _ in range(20)]
    a = make()
    b = [x ^ sum(1 << k for k in dice.sample(range(63), dice.randrange(0, 16))) for x in a]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "ord long, bits long")
    got = {(r.l, r.r) for r in M.hamming_pairs(frame(a), frame(b), most=10).collect()}
    assert got == {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if bin((x ^ y) & (1 << 64) - 1).count("1") <= 10}


def test_wide_radius_is_compared_in_tiles(spark, monkeypatch):
    """No pair is lost, and no side's keys, hundreds a row at this radius, are listed and broadcast from the driver."""
    monkeypatch.setattr(M, "TILE", 7)
    dice = random.Random(4)
    a = [dice.getrandbits(64) - (1 << 63) for _ in range(30)]
    b = [x ^ sum(1 << k for k in dice.sample(range(63), dice.randrange(0, 40))) for x in a] + [None]
    frame = lambda v: spark.createDataFrame(list(enumerate(v)), "ord long, bits long")
    found = M.hamming_pairs(frame([*a, None]), frame(b), most=20)
    wanted = {(i, j, d) for i, x in enumerate(a) for j, y in enumerate(b[:-1]) if (d := bin((x ^ y) & (1 << 64) - 1).count("1")) <= 20}
    assert {(r.l, r.r, r.distance) for r in found.collect()} == wanted
    assert M.hamming_pairs(frame(a), frame([None]), most=20).count() == 0
    for most in (10, 20):
        plan = M.hamming_pairs(frame(a), frame(b), most=most)._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan


@pytest.mark.parametrize(("classes", "bucket"), [(40, 65_536), (4, 3)])
def test_proposals_follow_the_sequential_rule(spark, monkeypatch, classes, bucket):
    """Groups that compete for all rights need few rounds, not one for each left; a long list is dealt in blocks."""
    monkeypatch.setattr(M, "SETTLED", 0)
    monkeypatch.setattr(M, "BUCKET", bucket)
    rounds, kept = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: rounds.append(what) or kept(df, what))
    dice, n = random.Random(6), 40 if classes == 40 else 16
    group = list(range(n)) if classes == n else [dice.randrange(classes) for _ in range(n)]
    apart = {(c, r): dice.randrange(50) for c in range(classes) for r in range(n) if classes == n or dice.random() < 0.7}
    wanted = {}
    for l, c in enumerate(group):
        free = [(apart[c, r], r) for r in range(n) if (c, r) in apart and r not in wanted.values()]
        if free:
            wanted[l] = min(free)[1]
    lefts = spark.createDataFrame(list(enumerate(group)), "l long, c long")
    rights = spark.createDataFrame([(r, c, d) for (c, r), d in apart.items()], "r long, c long, distance long")
    assert {x.l: x.r for x in M.resolve_groups(lefts, rights, ["c"]).collect()} == wanted
    assert rounds.count("matches") == 1 and rounds.count("holders") <= 20


def test_match_methods(spark):
    def row(i, tokens, size=None):
        return (i, tokens, ["if"], [], [], size or len(tokens), "h" + "".join(tokens), f"m{i}")

    s = "ord long, opcode_tokens array<string>, block_signature array<string>, api_calls array<string>, constants array<string>, instruction_count long, canonical_hash string, identifier string"
    base = [f"t{i}" for i in range(30)]
    left = spark.createDataFrame([row(0, base), row(1, base[:28] + ["x", "y"]), row(2, list("abcdefgh"))], s)
    right = spark.createDataFrame([row(0, base[:29] + ["z"]), row(1, base), row(2, list("qrstuvwx"))], s)
    for lsh in (False, True):
        got = {r.l: (r.r, r.stage) for r in M.match_methods(left, right, lsh=lsh).collect()}
        assert got == {0: (1, "exact"), 1: (0, "fuzzy")}


def test_lsh_parameters():
    assert M.lsh_parameters(0.55, 128) == (21, 6)


def test_aggregate(spark):
    full = [(k, 80.0) for k in config.WEIGHTS]
    row = S.aggregate(spark.createDataFrame(full, "key string, score double")).first()
    assert (row.score, row.minimum, row.maximum, row.analyzed_weight, row.level) == (80.0, 80.0, 80.0, 100, "极高")
    some = [(k, None if k == "images" else 50.0) for k in config.WEIGHTS]
    row = S.aggregate(spark.createDataFrame(some, "key string, score double")).first()
    assert (row.score, row.minimum, row.maximum, row.analyzed_weight, row.level) == (None, 46.0, 54.0, 92, None)


def test_multiset_keeps_duplicates(spark):
    table = lambda *v: spark.createDataFrame([(x, f"p{i}") for i, x in enumerate(v)], "value string, source_path string")
    left, right = table("a", "a", "b"), table("a", "c")
    assert [(r.value, r.occurrences, r.left_source_paths) for r in S.multiset_matches(left, right).collect()] == [("a", 1, ["p0", "p1"])]
    row = S.multiset_score(left, right).first()
    assert (row.score, row.left_coverage, row.right_coverage) == (40.0, 1 / 3, 0.5)
    empty = S.multiset_score(left, right.where("false")).first()
    assert (empty.score, empty.left_coverage, empty.confidence) == (None, 0.0, 0.0)


def test_set_score_of_empty_sides(spark):
    a, none = spark.createDataFrame([("x",)], "v string"), spark.createDataFrame([], "v string")
    at = lambda p, q: (lambda r: (r.score, r.left_coverage, r.right_coverage))(S.set_score(p, q).first())
    assert at(none, none) == (100.0, 1.0, 1.0) and at(a, none) == (0.0, 0.0, 1.0) and at(none, a) == (0.0, 1.0, 0.0) and at(a, a) == (100.0, 1.0, 1.0)


OWN = [("La/A;", "code", "OWNED_SOURCE", "a.kt", "m"), ("La/B;", "code", "OWNED_SOURCE", "b.kt", "m"), ("La/B;", "code", "OWNED_GENERATED", "g.kt", "m"), ("La/C;", "code", "OWNED_SOURCE", "c.kt", "m")]


def test_r8_attribution(spark):
    methods = spark.createDataFrame([(0, "Lx;"), (1, "Ly;"), (2, "Lz;"), (3, "Lq;"), (4, "Lw;")], "ord long, class_name string")
    mapping = [("Lx;", "La/A;"), ("Lx;", "La/A$In$Deep;"), ("Ly;", "La/A;"), ("Ly;", "La/C;"), ("Lz;", "La/B$X;"), ("Lq;", "La/A;"), ("Lq;", "Lno/Where;")]
    got = A.attribute_methods(methods, spark.createDataFrame(mapping, "output string, original string"), spark.createDataFrame(OWN, schemas.OWNERS)).collect()
    assert {r.ord: (r.origin, r.source_path) for r in got} == {0: ("OWNED_SOURCE", "a.kt"), **{i: ("UNRESOLVED", None) for i in (1, 2, 3, 4)}}


def test_last_writer_and_override(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 3, "c"), ("k", 2, "b")], "k string, seq long, v string")
    assert A.last_writer(rows, ["k"], "seq").first().v == "c"


def test_prefix_join(spark):
    rows = spark.createDataFrame([("abc",), ("ab",), ("xbc",), ("",)], "n string")
    assert sorted(r.n for r in A.prefix_join(rows, "n", spark.createDataFrame([("ab",), ("abcd",)], "prefix string")).collect()) == ["ab", "abc"]
    assert A.prefix_join(rows, "n", spark.createDataFrame([], "prefix string")).count() == 0


def test_archive_rules(spark):
    e = [("a", "ok", 10, 5, 0, 0, 0), ("a", "/abs", 1, 1, 0, 0, 1), ("a", "x/../y", 1, 1, 0, 0, 2), ("a", "l", 1, 1, 0, 0o120777, 3), ("a", "big", 300, 1, 0, 0, 4), ("a", "d", 1, 1, 0, 0, 5), ("a", "d/", 0, 0, 0, 0, 6), ("a", "z", 5, 0, 0, 0, 7)]
    got = {r.path: (r.violation, r.duplicate) for r in archive.violations(spark.createDataFrame(e, schemas.ENTRIES)).collect()}
    assert got == {"ok": (None, False), "/abs": ("unsafe path", False), "x/../y": ("unsafe path", False), "l": ("symbolic link", False), "big": ("unsafe ratio", False), "d": (None, True), "d/": (None, True), "z": ("invalid compressed size", False)}


def test_registry(spark):
    s = "left_path string, right_path string, left_sha string, right_sha string"
    records = spark.createDataFrame([("a", "b", "1", "2")], s)
    asked = spark.createDataFrame([("a", "b", "1", "2", True), ("b", "a", "1", "2", True), ("a", "b", "9", "2", True), ("a", "b", "1", "2", False)], s + ", valid boolean")
    assert [r.status for r in registry.pair_status(asked, records).select("left_path", "left_sha", "valid", "status").orderBy("left_path", "left_sha", F.desc("valid")).collect()] == ["matched", "invalid", "stale", "missing"]
    state = spark.createDataFrame([("code", "p", "1")], "role string, path string, sha256 string")
    assert registry.state_differences(state, state).count() == 0
    assert registry.state_differences(state, state.withColumn("sha256", F.lit("2"))).count() == 2
    sides = spark.createDataFrame([("L", 100_000)], "side string, modified long")
    inputs = spark.createDataFrame([("L", "code", 200_000)], "side string, category string, modified long")
    evidence = spark.createDataFrame([("L", "mapping", "code", 50_000)], "side string, role string, category string, modified long")
    assert sorted(r.problem for r in registry.stale(sides, inputs, evidence).collect()) == ["artifact is older than its inputs", "mapping is stale"]


def test_config(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text("min_method_similarity = 0.8\n[archive_limits]\nmax_entries = 5\n")
    c = config.load(f)
    assert c.min_method_similarity == 0.8 and c.archive_limits.max_entries == 5 and c.weights == config.WEIGHTS
    for bad in ("mystery = 1", "min_method_similarity = 2.0", "[weights]\nimages = 9", "long_method_min_instructions = 0", "[archive_limits]\nx = 1"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            config.load(f)
    assert C.TOKEN


def test_expected_inventory(spark):
    s = "type string, qualifiers string, name string"
    got = A.expected_inventory(spark.createDataFrame([("string", "", "a"), ("string", "de", "b")], s), spark.createDataFrame([("string", "", "a", "v")], s + ", value string")).collect()
    assert {(r.name, r.value, r.unverified) for r in got} == {("a", "v", None), ("b", None, "string-de:b")}


def _methods(spark, seed, n=24):
    dice = random.Random(seed)
    some = lambda k, most: [f"w{dice.randrange(k)}" for _ in range(dice.randrange(most))]
    rows = [(i, i % 2, ["a"] * 5 * (i % 3 > 0) + some(2, 14), some(9, 6), some(4, 8), some(5, 5), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "ord long, side long, opcode_tokens array<string>, block_signature array<string>, api_calls array<string>, constants array<string>, instruction_count long")


@pytest.mark.parametrize("room", [64 << 20, 900])
def test_pairs_are_compared_by_counts(spark, monkeypatch, room):
    """Rare and frequent shingles, empty sets, one part and several: as if whole sets had been compared."""
    monkeypatch.setattr(M, "BROADCAST", room)
    rows, df = _methods(spark, 5)
    cut = lambda t, k: {tuple(t[i : i + k]) for i in range(max(len(t) - k + 1, 1))} if t else set()
    held = {o: (cut(t, 5), set(b), cut(a, 2), set(c)) for o, _, t, b, a, c, _ in rows}
    near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    rights = [s for o, x in held.items() if o % 2 for s in x[0]]
    often = {s for s in rights if rights.count(s) > 3}
    want = {}
    for left in range(0, len(rows), 2):
        for right in range(1, len(rows), 2):
            shared = len((held[left][0] & held[right][0]) - often)
            if shared:
                want[left, right] = shared, sum(w * near(x, y) for w, x, y in zip((0.45, 0.25, 0.20, 0.10), held[left], held[right], strict=True))
    a, b = df.where("side = 0"), df.where("side = 1")
    index = M.shingle_index(a, b, C.shingle_hashes(F.col("opcode_tokens")), cap=3)
    got = {(r.l, r.r): (r.shared, r.sim) for r in M.compared(M.rare_pairs(index), a, b, index).collect()}
    assert often and want and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)


def test_only_the_listed_candidates_are_compared(spark, monkeypatch, tmp_path):
    """Of 40 candidates the 30 with most shared shingles, before any sets are met."""
    from kindred.plans import catalogue

    text = "one two three four five six seven"
    rows = [(0, text, "en")] + [(2 * i + 1, " ".join(text.split()[: 5 + i % 3]) + f" x{i} y{i} z{i}", "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    met, whole = [], M.compared
    monkeypatch.setattr(M, "compared", lambda pairs, *rest: met.append(pairs.count()) or whole(pairs, *rest))
    got = catalogue.q_best_candidate_per_left(spark, str(tmp_path)).collect()
    assert met == [30] and len(got) == 1 and got[0].shared == 3


def test_lists_of_equal_rows_meet_once(spark):
    """Passages shared by the same right rows count all their shingles."""
    long = [f"t{i}" for i in range(40)]
    rows = [(0, 0, long), (2, 0, long[:20] + ["q"]), (1, 1, long), (3, 1, long), (5, 1, long[5:])]
    df = spark.createDataFrame(rows, "ord long, side int, t array<string>")
    got = M.inverted_candidates(df.where("side = 0"), df.where("side = 1"), C.shingle_hashes(F.col("t"))).collect()
    assert {(r.l, r.r): r.shared for r in got} == {(0, 1): 36, (0, 3): 36, (0, 5): 31, (2, 1): 16, (2, 3): 16, (2, 5): 11}


def test_copies_meet_as_one_class(spark, monkeypatch):
    """20 copies a side are one class of all their bands, and every pair of rows comes out once."""
    met, whole = [], M.materialise
    monkeypatch.setattr(M, "materialise", lambda df, what: met.append((what, df.select("c").distinct().count())) or whole(df, what) if what == "bands" else whole(df, what))
    rows = [(i, i % 2, [f"t{k}" for k in range(30)]) for i in range(40)] + [(40, 0, []), (41, 1, ["z"])]
    df = spark.createDataFrame(rows, "ord long, side int, t array<string>")
    got = [(r.l, r.r) for r in M.lsh_candidates(df.where("side = 0"), df.where("side = 1"), C.shingles(F.col("t")), parameters=(5, 2)).collect()]
    assert met == [("bands", 1), ("bands", 2)]
    assert sorted(got) == [(a, b) for a in range(0, 40, 2) for b in range(1, 40, 2)]


def test_signatures_move_nothing(spark):
    """As by the rule in plain integers, also of a row longer than a step; without a shuffle."""
    from hashlib import md5

    rows = [(1, ["a", "b", "é\x1f"]), (2, []), (3, None), (4, [f"s{i}" for i in range(5000)])]
    got = M.signatures(spark.createDataFrame(rows, "ord long, s array<string>"), F.col("s"), 7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    x = lambda s: int(md5(s.encode()).hexdigest()[:8], 16) & (2**31 - 1)
    want = {o: [min((x(v) * a + b) % M.PRIME for v in s) for a, b in map(M.permutation, range(7))] for o, s in rows if s}
    assert {r.ord: r.hs for r in got.collect()} == want


@pytest.mark.parametrize(("tile", "many"), [(4096, 8192), (7, 2)])
def test_similarities_of_all_pairs(spark, monkeypatch, tile, many):
    """One tile and several, by products of matrices and pair by pair: as if whole sets had been compared."""
    monkeypatch.setattr(M, "TILE", tile)
    rows, df = _methods(spark, 5)
    cut = lambda t, k: {tuple(t[i : i + k]) for i in range(max(len(t) - k + 1, 1))} if t else set()
    held = {o: (cut(t, 5), set(b), cut(a, 2), set(c)) for o, _, t, b, a, c, _ in rows}
    near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    want = {(a, b): (len(x[0] & y[0]), sum(w * near(p, q) for w, p, q in zip((0.45, 0.25, 0.20, 0.10), x, y, strict=True))) for a, x in held.items() for b, y in held.items() if a % 2 < b % 2 and x[0] & y[0]}
    got = {(r.l, r.r): (r.shared, r.sim) for r in M.similarities(df.where("side = 0"), df.where("side = 1")).collect()}
    assert want and got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    dice = random.Random(many)
    lists = [[[dice.randrange(20) for _ in range(dice.randrange(9))] for _ in range(n)] for n in (13, 17)]
    lists = [[sorted(set(x)) for x in side] for side in lists]
    x, y = (pa.table({"v": pa.array(side, pa.list_(pa.int64()))}) for side in lists)
    found = M._counts(M._met(x, y, "v"), 3, 11, 17, many, 5)
    assert found.tolist() == [[len({*a} & {*b}) for b in lists[1]] for a in lists[0][3:11]]
    assert not M._counts(M._met(x, y.slice(0, 0), "v"), 0, 13, 0).size


def test_pair_similarity_of_a_frequent_line(spark, tmp_path):
    """A line that more than 200 right rows have makes pairs as any other."""
    from kindred.plans import catalogue

    rows = [(i, f"one two three four five x{i}", "en") for i in range(420)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.q_pair_similarity(spark, str(tmp_path))
    assert got.count() == got.select("l", "r").distinct().count() == 210 * 210 and got.where("shared = 1").count() == 210 * 210
    assert "200" not in catalogue.ORACLE["q_pair_similarity"] and "<= 200" in catalogue.ORACLE["q_inverted_candidates"]


def test_large_sets_are_not_broadcast(spark, monkeypatch):
    """Sets beyond the room reach the pairs by joins: nothing of them goes through the driver, in whatever parts."""
    _, df = _methods(spark, 7)
    a, b = df.where("side = 0"), df.where("side = 1")
    index = M.shingle_index(a, b, C.shingle_hashes(F.col("opcode_tokens")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lambda: M.compared(M.rare_pairs(index), a, b, index)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan()
        monkeypatch.setattr(M, "BROADCAST", 900)
        assert "BroadcastExchange" not in plan()
        assert "BroadcastExchange" not in M.similarities(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
