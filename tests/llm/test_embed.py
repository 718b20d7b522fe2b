import numpy as np

from kindred.llm import embed_dedup


def brute(rows, least=0.98):
    good = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = (label, x / np.linalg.norm(x))
    links = {k: [j for j in good if j != k and good[j][0] == good[k][0] and len(good[j][1]) == len(good[k][1]) and good[j][1] @ good[k][1] >= least] for k in good}
    out = {}
    for k, (i, *_) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen)
        out[k] = (i, len(links.get(k, [])), low, i == low)
    return sorted(out.values())


def make():
    dice = np.random.default_rng(3)
    rows, base = [], dice.normal(size=(60, 16))
    for b in base:
        for _ in range(int(dice.integers(1, 6))):
            rows.append([float(np.float32(x)) for x in b + dice.normal(size=16) * dice.choice([0.0, 0.05, 0.12])])
    rows = [(i, v, int(i % 2)) for i, v in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, rows[0][1], None), (n + 5, rows[4][1][:8], 0), (n + 6, [None] + rows[0][1][1:], 0), (n + 7, rows[8][1], 0), (n + 7, rows[8][1], 0)]


def test_near_duplicates(spark, monkeypatch):
    rows = make()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    wanted = brute(rows)
    got = sorted(map(tuple, embed_dedup.near_duplicates(df, list_size=40, probes=3).collect()))
    assert sum(w == g for w, g in zip(wanted, got)) >= 0.9 * len(wanted) and len(got) == len(wanted)
    # none below the limit: every component found lies in a true one
    assert all(g[1] <= w[1] for w, g in zip(wanted, got))
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    assert sorted(map(tuple, embed_dedup.near_duplicates(df, list_size=10_000).collect())) == wanted


def test_empty(spark):
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
