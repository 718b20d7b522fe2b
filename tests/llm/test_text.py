"""Toxicity, language, token files, packing, URL rules and decontamination."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kindred.llm import decontaminate, langid, packing, tokens, toxicity, urlrules

SCHEMA = "doc_id long, text string, lang string, toxicity string"
WEIRD = ["", None, " ", "a  b", "x\n\ny z", "tab\there", "Foo,bar 's don't \u03a3\u0130", "e\u0301 caf\u00e9 \u4e2d\u6587 \U0001f600", "a\u00a0b c\u2003d", "<|endoftext|> no", "w" * 3000, "line one\nline two.\nThree"]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "clash") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder(name, spaced):
    dice = random.Random(1)
    letters = " \n\tab1's\u2019.\u00c9\u0301<|endoftext|>\r\u4e2d \x85\x1c,"
    texts = [x or "" for x in WEIRD] + ["".join(dice.choice(letters) for _ in range(dice.randrange(30))) for _ in range(3000)]
    path = public_tokenizers.path(name)
    wanted = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in tokens.Encoder(path, spaced, keep=50)(texts)] == wanted


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 32])
def test_packing_of_bits(bits):
    ids = np.random.default_rng(0).integers(0, 1 << min(bits, 31), 9000).astype("<u4")
    assert (tokens.unpack(tokens.pack(ids, bits), len(ids), bits) == ids).all()
    shard = tokens.Shard(tokens.shard_bytes([3, 9], [ids, ids[:5]], bits))
    assert (shard.ids(4090, 9003) == np.concatenate([ids, ids[:5]])[4090:9003]).all()
    assert shard.doc_ids.tolist() == [3, 9] and shard.starts.tolist() == [0, 9000] and len(shard.ids(5, 5)) == 0


def test_token_files(spark, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = WEIRD + ["same text", "same text"]
    wanted, start = [], 0
    tok = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        wanted.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    out = tokens.read(tokens.write(docs(spark, texts).repartition(3), path, end=0, spaced=True))
    assert sorted(map(tuple, out.collect())) == wanted
    assert tokens.read(tokens.write(docs(spark, []), path, end=0, spaced=True)).count() == 0


def test_pack_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 20)
    dice = random.Random(2)
    texts = WEIRD + [" ".join(dice.choice("abcdefgh") for _ in range(dice.randrange(1, 90))) for _ in range(120)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    rows = packing.pack_documents(docs(spark, texts), public_tokenizers.path("word_bpe_49k.json"), end=1, spaced=False, capacity=64).collect()
    bins = {}
    for r in rows:
        assert r.start == 64 * r.piece and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(map(len, ids.values())) // 64) + 2
    assert packing.pack_documents(docs(spark, []), public_tokenizers.path("word_bpe_49k.json"), end=1, spaced=False).count() == 0


def test_large_pieces_end(spark, monkeypatch):
    """Pieces of over half a sequence never fill one; the rounds still end."""
    monkeypatch.setattr(packing, "GROUP", 10)
    pieces = spark.createDataFrame([(i, 60) for i in range(50)], "key long, length int")
    assert packing.pack(pieces, 100).select("sequence_id").distinct().count() == 50


def test_crossover_keeps_every_document():
    dice = random.Random(0)
    length = [dice.randrange(1, 60) for _ in range(200)]
    one, two = (packing.best_fit(sorted(range(200), key=lambda i: dice.random()), length, 100) for _ in range(2))
    child = packing.crossover(one, two, length, 100, dice)
    assert sorted(i for b in child for i in b) == list(range(200)) and all(sum(length[i] for i in b) <= 100 for b in child)


def test_toxicity(spark):
    dice = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = [dice.choice(plain) for _ in range(40)] + (["Horrid", "vile"] if bad else [])
        dice.shuffle(words)
        texts.append(" ".join(words))
        labels.append((i, None if i % 50 == 1 else int(bad)))
    held = docs(spark, [*texts, "", None, "so HORRID and vile"])
    model = toxicity.fit(held, spark.createDataFrame(labels[:300] + labels[:5], "doc_id long, toxic int"), seen=5, l1=2.0)
    out = {r.doc_id: r.toxicity for r in toxicity.score(held, model).collect()}
    assert all((out[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert out[400] == out[401] < 0.5 <= out[402]
    empty = toxicity.fit(held, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.toxicity for r in toxicity.score(held, empty).collect()} == {0.5}
    assert toxicity.score(docs(spark, []), model).count() == 0


def test_language(spark):
    dice = random.Random(4)
    stems = {"aa": ["kapo", "limu", "tisa", "hono"], "bb": ["grund", "stark", "welt", "zwei"]}
    rows = [(i, " ".join(dice.choice(stems[x]) + dice.choice(stems[x]) for _ in range(12)), x, "c") for i, x in enumerate(["aa", "bb"] * 60)]
    rows += [(200, None, "aa", "c"), (201, "12 34 !", "aa", "c"), (202, "", "bb", "c"), (203, "kapokapokapo", None, "c"), (204, "weltgrundzwei", None, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.fit(df.where("doc_id < 80"))
    out = {r.doc_id: (r.lang_pred, r.lang_score) for r in langid.predict(df, model).collect()}
    assert all(out[i][0] == rows[i][2] for i in range(120))
    assert out[200] == out[201] == out[202] == ("und", 0.0) and out[203][0] == "aa" and out[204][0] == "bb"
    none = langid.predict(df, langid.fit(df.where("false")))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_url_rules(spark):
    rules = spark.createDataFrame([("com", "/", "allow"), ("Example.com", "/en/", "block"), ("a.example.com", "/en/x", "allow"), ("example.com", "/en/", "block"), ("", "/", "block"), (None, "/", "block")], "host string, path string, verdict string")
    urls = ["http://example.com/en/1", "https://WWW.Example.com/en/?q=1", "http://a.example.com/en/xy", "http://a.example.com/en/y", "http://badexample.com/en/", "http://example.com", "none", None, "://", "http://example.org/en/#f", "x://example.com/fr?a/en/"]
    pages = spark.createDataFrame([(i, u, "c", "d") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, rule string, extra string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.extra) for r in urlrules.judge(pages, rules, default="ask").collect()}
    assert out[0] == out[11] == ("example.com", "/en/1", "example.com/en/", "block", "d")
    assert out[1][:4] == ("www.example.com", "/en/", "example.com/en/", "block")
    assert out[2][2:4] == ("a.example.com/en/x", "allow") and out[3][2:4] == ("example.com/en/", "block")
    assert out[4][2:4] == ("com/", "allow") and out[5][:4] == ("example.com", "", None, "ask")
    assert out[6][:4] == out[7][:4] == out[8][:4] == ("", "", None, "ask") and out[9][3] == "ask" and out[10][2] == "com/"
    assert urlrules.judge(pages.where("false"), rules).count() == 0 and {r.verdict for r in urlrules.judge(pages, rules.where("false")).collect()} == {"allow"}


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(14))
    items = spark.createDataFrame([(7, item), (8, "Short One"), (9, ""), (10, None), (None, "odd item here")], "item_id long, text string")
    texts = ["x " + item.upper() + " y", " ".join(item.split()[:9]), " ".join(item.split()[2:12]), "a short, one b", "short two", None, "", "odd item here", "short one short one", "t1 t0 t2"]
    df = spark.createDataFrame([(i, t, 5, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_hit int, extra string")
    out = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in decontaminate.decontaminate(df, items).collect()}
    assert out == {0: (16, 14, ["7"], True), 1: (9, 0, [], False), 2: (10, 10, ["7"], True), 3: (4, 2, ["8"], True), 4: (2, 0, [], False), 5: (0, 0, [], False), 6: (0, 0, [], False), 7: (3, 3, [], True), 8: (4, 4, ["8"], True), 9: (3, 0, [], False)}
    near = decontaminate.matches(spark.createDataFrame([(1, "a b x c d")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d")], "item_id long, text string"), slop=1)
    assert near.count() == 1
    assert decontaminate.decontaminate(df, items.where("false")).where("contaminated").count() == 0
    assert decontaminate.decontaminate(df.where("false"), items).count() == 0


def test_decontamination_of_equal_rows(spark):
    item = " ".join(f"t{i}" for i in range(14))
    items = spark.createDataFrame([(7, item), (8, "short one"), (9, "lone")], "item_id long, text string")
    rows = [(0, "x " + item)] * 3 + [(0, "x y"), (1, "a short one b")] * 2 + [(2, "a lone b")] * 2 + [(3, item)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted((r.doc_id, r.n_words, r.n_hit, *r.item_ids, r.contaminated) for r in decontaminate.decontaminate(df, items).collect())
    assert out == [(0, 2, 0, False)] * 2 + [(0, 15, 14, "7", True)] * 3 + [(1, 4, 2, "8", True)] * 2 + [(2, 3, 1, "9", True)] * 2 + [(3, 14, 14, "7", True)]
    for slop in (0, 1):
        found = decontaminate.matches(df, items, slop=slop)
        assert found.count() == found.distinct().count() and found.select("doc", "version").distinct().count() == 4


def test_decontamination_of_null_doc_ids(spark):
    items = spark.createDataFrame([(7, "some short item")], "item_id long, text string")
    df = spark.createDataFrame([(None, "Some short item."), (None, "clean"), (0, "clean"), (0, "x some short item"), (None, None)], "doc_id long, text string")
    out = {(r.doc_id, r.text): (r.n_hit, *r.item_ids, r.contaminated) for r in decontaminate.decontaminate(df, items).collect()}
    assert out == {(None, "Some short item."): (3, "7", True), (None, "clean"): (0, False), (0, "clean"): (0, False), (0, "x some short item"): (3, "7", True), (None, None): (0, False)}


def test_url_rules_nested_and_of_any_length(spark):
    """Random nested rules, a hot host, hosts that are met once, very long urls: equal to trying every rule on every page."""
    import random

    pick = random.Random(5)
    names = ["a", "b", "ab", "com", "a-b", "é", "com2"]
    host = lambda: ".".join(pick.choice(names) for _ in range(pick.randint(1, 4)))
    path = lambda: "/" + "".join(pick.choice(["en/", "e", "n/", "x"]) for _ in range(pick.randint(0, 3)))
    rules = list({(host(), pick.choice(["", path(), path()])): pick.choice(["allow", "block"]) for _ in range(150)}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    pages = [(k, f"http://{pick.choice(['a.com', host(), f'u{k}.' + host()])}{pick.choice(['', path(), path() + 'x' * 100_000 if k % 50 == 0 else path()])}{pick.choice(['', '?q', '#f'])}") for k in range(1500)]
    pages += [(9000, "http://" + "a." * 5000 + "com/en/"), (9001, None), (9002, "no url"), (9003, "http://")]
    df, table = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string")
    found = {r.page_id: (r.rule, r.verdict) for r in urlrules.judge(df.repartition(5), table, default="ask").collect()}
    assert len(found) == len(pages)
    for k, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        rest = rest.split("?")[0].split("#")[0]
        h, slash, p = rest.partition("/")
        fits = [(len(rh) + len(rp), len(rh), rh + rp, v) for rh, rp, v in rules if ("." + h).endswith("." + rh) and (slash + p).startswith(rp)] if h else []
        assert found[k] == (max(fits)[2:] if fits else (None, "ask")), url[:100]


def test_decontamination_by_shuffles_alone(spark, monkeypatch):
    """Terms of too many bytes are not broadcast; what is found is the same."""
    from functools import partial

    long = "w" * 5000
    df = spark.createDataFrame([(k, f"{long} a b c {'d ' * (k % 3)}{long} e f") for k in range(30)] + [(30, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", f"a b c {long} e"), ("y", f"{long} a b"), ("z", "d d")], "item_id string, text string")
    result = lambda: sorted((r.doc_id, r.n_hit, *r.item_ids) for r in decontaminate.decontaminate(df, items).collect())
    before, few = result(), decontaminate.few
    assert few(items.select("item_id", "text").withColumnRenamed("text", "term"))._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 1
    monkeypatch.setattr(decontaminate, "few", partial(few, size=10))
    monkeypatch.setattr(decontaminate, "small", lambda df: df)
    assert decontaminate.few(items.withColumnRenamed("text", "term"))._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 0
    assert result() == before and before[0] == (0, 6, "x", "y") and before[2] == (2, 5, "y", "z") and before[1] == (1, 3, "y") and before[30] == (30, 0)
