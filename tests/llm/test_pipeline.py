"""The pipeline against brute force, stage by stage; names of queries and stages; the rest without this subpackage."""

import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm import queries

from .test_dedup import brute_components

ROOT = Path(__file__).resolve().parents[2]
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    dice = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [dice.choice(words) for _ in range(n)]
    texts, labels = [], []
    for i in range(240):
        bad = i % 4 == 1
        t = make(dice.randrange(60, 120)) + (["vile", "horrid"] if bad else [])
        dice.shuffle(t)
        texts.append(" ".join(t))
        labels.append((i, 1, int(bad)))
    passage, item = " ".join(make(70)), " ".join(make(14))
    for k in range(6):
        texts.append(" ".join(make(40)) + "\n" + passage + "\n" + " ".join(make(30)))
    base = texts[0].split()
    for k in range(4):
        near = list(base)
        near[5 * k] = "changed"
        texts.append(" ".join(near))
    texts += [" ".join(make(30)) + " " + item.upper(), passage, texts[2], "", None, " ".join(make(6000))]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, item), (1, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {i: t for i, t, *_ in rows}, item


def expected(texts, item):
    yield (docs := {i: t for i, t in texts.items() if "vile" not in (t or "")})
    groups = brute_components([(i, t) for i, t in docs.items()])
    yield (docs := {i: t for i, t in docs.items() if groups[i][1] == i})
    first, out = {}, {}
    split = {i: re.findall(WORD, t or "") for i, t in docs.items()}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        if gone and len(gone) < len(w):
            out[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
        elif not gone:
            out[i] = docs[i]
    yield out
    plain = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    runs = {tuple(plain(item)[k : k + 10]) for k in range(5)}
    yield {i: t for i, t in out.items() if not any(tuple(plain(t)[k : k + 10]) in runs for k in range(len(plain(t)) - 9))}


def test_stages(spark, folder):
    path, texts, item = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    wanted = expected(texts, item)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], wanted, strict=True):
        docs = corpus_pipeline.materialise(stage(spark, docs, path), name)
        assert docs.columns == columns
        rows = docs.collect()
        assert {r.doc_id: r.text for r in rows} == want, name
        assert all(r.n_chars == len(r.text or "") for r in rows)


def test_run(spark, folder):
    path, texts, item = folder
    *_, last = expected(texts, item)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in last.items()}
    rows = corpus_pipeline.run(spark, path).collect()
    got, bins = {}, {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == size
    for b in bins.values():
        assert [o for o, _ in sorted(b)] == [sum(n for _, n in sorted(b)[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= -(-sum(size.values()) // 4096) + 1


def test_toxic_labels_held_out(spark, folder):
    path, texts, _ = folder
    rows = {r.doc_id: r for r in queries.op2_toxicity(spark, path).collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5) == int("vile" in (texts[i] or ""))


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "repeats", "contamination", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_the_rest_works_without(tmp_path):
    import shutil

    shutil.copytree(ROOT / "kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
