"""Whole comparisons of small archives."""

import json
import struct
import zipfile
import zlib

import pytest

from kindred import config
from kindred.plans import compare, report
from kindred.sources import dex


def png(shade):
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    rows = b"".join(b"\0" + bytes((x * shade + y) % 256 for x in range(32) for _ in range(3)) for y in range(32))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 32, 32, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def uleb(n):
    out = b""
    while True:
        n, low = n >> 7, n & 127
        if not n:
            return out + bytes([low])
        out += bytes([low | 128])


def tiny_dex(bodies, owner="Lcom/app/Main;"):
    """A file with one class of static methods m0, m1, .. () V; bodies: lists of 16-bit units."""
    strings = sorted(["V", owner, "hello", *[f"m{i}" for i in range(len(bodies))]])
    types = sorted([strings.index("V"), strings.index(owner)])
    n = len(bodies)
    at = 112
    strings_at, at = at, at + 4 * len(strings)
    types_at, at = at, at + 4 * len(types)
    protos_at, at = at, at + 12
    methods_at, at = at, at + 8 * n
    classes_at, at = at, at + 32
    data, code, texts = b"", [], []
    for b in bodies:
        code.append(at + len(data))
        data += struct.pack("<HHHHII", 1, 0, 0, 0, 0, len(b)) + struct.pack(f"<{len(b)}H", *b)
        data += b"\0" * (-len(data) % 4)
    for s in strings:
        texts.append(at + len(data))
        data += uleb(len(s)) + s.encode() + b"\0"
    class_at = at + len(data)
    order = sorted(range(n), key=lambda i: strings.index(f"m{i}"))
    data += uleb(0) * 2 + uleb(n) + uleb(0)
    for k, i in enumerate(order):
        data += uleb(1 if k else 0) + uleb(9) + uleb(code[i])
    owner_type = types.index(strings.index(owner))
    void = types.index(strings.index("V"))
    head = struct.pack("<12I", len(strings), strings_at, len(types), types_at, 1, protos_at, 0, 0, n, methods_at, 1, classes_at)
    out = b"dex\n035\0" + b"\0" * 48 + head + struct.pack("<II", len(data), at)
    out = out.ljust(112, b"\0")
    out += b"".join(struct.pack("<I", x) for x in texts) + b"".join(struct.pack("<I", x) for x in types)
    out += struct.pack("<III", strings.index("V"), void, 0)
    out += b"".join(struct.pack("<HHI", owner_type, 0, strings.index(f"m{i}")) for i in order)
    out += struct.pack("<8I", owner_type, 1, 0xFFFFFFFF, 0, 0xFFFFFFFF, 0, class_at, 0)
    return out + data


BODY = [0x0012] * 14 + [0x0038, 2, 0x0128, 0x000E]  # constants, a branch, a jump, return


def bundle(path, renamed=False, code=True, extra=()):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("base/manifest/AndroidManifest.xml", '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app"><application><activity android:name=".Main"/></application></manifest>')
        z.writestr("BUNDLE-METADATA/com.android.tools.build.gradle/app-metadata.properties", "androidGradlePluginVersion=8.1.0\n" if not renamed else "androidGradlePluginVersion=8.2.0\n")
        z.writestr("BUNDLE-METADATA/com.android.tools.build.libraries/dependencies.pb", b"com.squareup.okio\0okio\x003.9.0\0")
        z.writestr(f"base/res/layout/{'other' if renamed else 'main'}.xml", "<LinearLayout android:id='@id/root'/>" * 5)
        z.writestr(f"base/res/drawable/{'pic2' if renamed else 'pic'}.png", png(5))
        z.writestr("base/assets/model.bin", bytes(range(256)) * 20)
        z.writestr("base/lib/arm64-v8a/libx.so", b"\x7fELF" + b"filler" * 50)
        z.writestr("BundleConfig.pb", b"config")
        if code:
            z.writestr("base/dex/classes.dex", tiny_dex([BODY, BODY[:-2] + [0x0012] * 3 + BODY[-2:]]))
        for name, data in extra:
            z.writestr(name, data)
    return str(path)


def test_dex():
    rows = list(dex.Dex(tiny_dex([BODY, [0x001A, 0, 0x000E]])).methods())
    assert [r[:4] for r in rows] == [(0, "Lcom/app/Main;", "m0", "()V"), (1, "Lcom/app/Main;", "m1", "()V")]
    assert [n for n, _ in rows[0][4]] == ["const/4"] * 14 + ["if-eqz", "goto", "return-void"]
    assert rows[1][4][0] == ("const-string", '"Lcom/app/Main;"')
    assert dex.OPCODES[0xE2][0] == "ushr-int/lit8" and dex.OPCODES[0xCF][0] == "rem-double/2addr" and dex.OPCODES[0x3D][0] == "if-lez" and dex.OPCODES[0x8F][0] == "int-to-short"


@pytest.fixture(scope="module")
def pair(tmp_path_factory):
    d = tmp_path_factory.mktemp("bundles")
    return bundle(d / "left.aab"), bundle(d / "right.aab", renamed=True)


def test_legacy(spark, pair, tmp_path):
    out = compare.compare_archives(spark, *pair, mode="legacy", lsh=False)
    d = out["dimensions"]
    assert set(d) == set(config.WEIGHTS) and d["resources"]["score"] == d["images"]["score"] == d["business_code"]["score"] == 100.0
    assert d["resources"]["renamed_matches"] == 1 and d["images"]["renamed_matches"] == 1 and d["dependencies"]["score"] == 100.0
    assert d["long_methods"]["score"] is None and out["aggregate"]["score"] is None and out["aggregate"]["analyzed_weight"] == 85
    folder = report.write(out, tmp_path / "r")
    text = (folder / "report.md").read_text()
    assert "AGP: 8.1.0 -> 8.2.0" in text and json.loads((folder / "analysis.json").read_text())["mode"] == "legacy"
    with pytest.raises(ValueError):
        report.write(out, folder)
    report.write(out, folder, overwrite=True)
    assert (folder / "report.md").read_text() == text
    with pytest.raises(ValueError):
        report.write(out, tmp_path)
    # every finding has a link, every link a file, and dimensions have their weights
    held = json.loads((folder / "analysis.json").read_text())
    assert held["evidence"] and all((folder / x).is_file() and f"]({x})" in text for x in held["evidence"]) and len(held["evidence"]) == len(out["findings"])
    assert held["weights"] == config.WEIGHTS and f"{config.WEIGHTS['images']} %" in text and text.count("## Findings: ") == len(d)
    assert not list((folder / "evidence").glob(".*")) and not compare.incomplete(out)


def test_evidence_of_tasks_that_fail(spark, tmp_path):
    """A text that cannot be made ends the job: nothing of it is listed, the report stays unfinished, and a later one is whole."""
    from pyspark.sql import functions as F

    side = {"path": "a", "sha256": "0", "modules": [], "agp": None, "counts": {}}
    findings = [("business_code", k, f"l{k}", f"r{k}", 1.0) for k in range(1, 9)]
    out = {"mode": "legacy", "left": side, "right": side, "dimensions": {"business_code": {"key": "business_code", "score": 1.0, "left_coverage": 1.0, "right_coverage": 1.0, "confidence": 1.0}}, "findings": findings, "warnings": [], "attribution": {"left": None, "right": None}, "aggregate": None, "diagnostics": {}}
    shown = spark.range(1, 9).select(F.lit("business_code").alias("dimension"), F.col("id").cast("int").alias("rank"), F.lit("left").alias("side"), F.when(F.col("id") < 8, "here").otherwise(F.raise_error(F.lit("lost"))).alias("shown"))
    with pytest.raises(Exception, match="lost"):
        report.write(out | {"snippets": shown}, tmp_path / "r")
    assert not (tmp_path / "r/analysis.json").exists()
    (tmp_path / "r/evidence/business_code-009.txt").write_text("of a task that was lost")
    folder = report.write(out | {"snippets": shown.where("rank < 3")}, tmp_path / "r", overwrite=True)
    assert report.read(folder)["evidence"] == [f"evidence/business_code-{k:03d}.txt" for k in range(1, 9)] and "snippets" not in report.read(folder)
    assert "here" in (folder / "evidence/business_code-002.txt").read_text() and "here" not in (folder / "evidence/business_code-003.txt").read_text()
    assert report.write_texts(spark.createDataFrame([], "name string, text string"), str(tmp_path)) == []


def test_only_unread_code_makes_a_result_incomplete():
    assert compare.incomplete({"warnings": ["x", dex.UNREAD + "a: broken"]}) and not compare.incomplete({"warnings": ["values of 3 resources are missing"]})


def test_heuristic(spark, pair):
    out = compare.compare_archives(spark, *pair, lsh=False)
    d = out["dimensions"]
    assert out["mode"] == "owned" and out["aggregate"] is None and set(d) == {"business_code", "long_methods", "images", "resources", "manifest", "assets"}
    assert d["business_code"]["score"] == 100.0 and d["business_code"]["confidence"] == 0.75 and d["manifest"]["score"] == 100.0
    assert d["long_methods"]["score"] is None and d["long_methods"]["confidence"] == 0.0 and d["assets"]["confidence"] == 0.4


def test_store(spark, pair, tmp_path, monkeypatch):
    from kindred.plans import store
    from kindred.streaming import inbox

    cache, read = str(tmp_path / "cache"), []
    monkeypatch.setattr(compare, "fingerprints", lambda *a, f=compare.fingerprints: read.append(a[1]) or f(*a))
    plain, kept = compare.profile(spark, pair[0]), [compare.cached_profile(spark, p, config.Config(), cache) for p in pair][0]
    assert len(read) == 3 and kept.header == plain.header and kept.warnings == plain.warnings and kept.inventory is None
    for name in ("files", "methods", "images", "manifest", "details", "dependencies", "build"):
        assert sorted(map(str, getattr(kept, name).collect())) == sorted(map(str, getattr(plain, name).collect())), name
    # a second run reads no archive, nor does a folder of equal ones
    read.clear()
    (tmp_path / "in").mkdir()
    for name, source in (("a.aab", pair[0]), ("b.aab", pair[1]), ("c.aab", pair[0])):
        (tmp_path / "in" / name).write_bytes(open(source, "rb").read())
    assert store.fill(spark, str(tmp_path / "in"), config.Config(), cache).count() == 3 and not read
    # the stream reads what is new, once; a batch that comes again changes nothing
    bundle(tmp_path / "in" / "d.aab", extra=[("base/assets/more.bin", b"more")])
    with zipfile.ZipFile(tmp_path / "in" / "e.aab", "w") as z:
        z.writestr("../evil", b"x")
    when = lambda: {p: p.stat().st_mtime_ns for p in sorted((tmp_path / "cache").rglob("*.parquet"))}
    inbox.profiles(spark, str(tmp_path / "in"), config.Config(), cache, str(tmp_path / "cp1")).awaitTermination()
    assert len(read) == 1 and store.done(spark, cache).count() == 4
    before = when()
    inbox.profiles(spark, str(tmp_path / "in"), config.Config(), cache, str(tmp_path / "cp2")).awaitTermination()
    assert len(read) == 1 and when() == before
    with pytest.raises(ValueError, match="unsafe path"):
        compare.cached_profile(spark, str(tmp_path / "in/e.aab"), config.Config(), cache)
    assert compare.cached_profile(spark, str(tmp_path / "in/d.aab"), config.Config(), cache).files.where("path = 'base/assets/more.bin'").count() == 1
    # other settings are other keys
    assert store.keys(spark, pair[0], config.Config(min_method_instructions=5)).first().key != store.keys(spark, pair[0], config.Config()).first().key


def test_archive_source(spark, tmp_path):
    from kindred.sources import archive

    path = tmp_path / "big.aab"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3000):
            z.writestr(f"base/{('assets', 'res/raw', 'none')[i % 3]}/f{i:04d}.bin", bytes([i % 251]) * (i % 400))
    rows = archive.contents(spark, str(path), split=50_000)
    assert rows.rdd.getNumPartitions() > 5 and rows.count() == 2000
    assert {r.path: r.content for r in rows.collect()} == {f"base/{('assets', 'res/raw')[i % 3]}/f{i:04d}.bin": bytes([i % 251]) * (i % 400) for i in range(3000) if i % 3 < 2}
    # kinds and paths are decided in the scan
    some = archive.scan(spark, str(path), content=True, split=50_000).where("kind = 'asset' and startswith(path, 'base/assets/f00') and size > 10")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert some.count() == sum(i % 400 > 10 for i in range(0, 100, 3)) and "Filter" not in plan.split("BatchScan")[0]
    # several archives, broken ones among them
    (tmp_path / "bad.aab").write_bytes(b"PK no archive")
    got = archive.entries(spark, f"{tmp_path}/*.aab").groupBy("archive").count().collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r["count"]) for r in got) == [("bad.aab", 1), ("big.aab", 3000)]
    assert archive.contents(spark, str(tmp_path), pruned=False).count() == 3000


def test_ranges_of_a_dex_file(spark, tmp_path):
    from kindred.sources import archive

    path = bundle(tmp_path / "a.aab", extra=[("base/dex/classes2.dex", b"dex\nno")])
    entries = archive.entries(spark, path)
    whole = sorted(map(str, dex.raw_methods(archive.contents(spark, path)).where("warning is null").collect()))
    parts = dex.scan(entries, split=100)
    assert sorted(map(str, parts.where("warning is null").collect())) == whole and parts.where("warning is not null").select("dex_path").distinct().count() == 1
    data = zipfile.ZipFile(path).read("base/dex/classes.dex")
    assert len([k for part in range(4) for k, *_ in dex.Dex(data).methods(part, 4)]) == len(whole)


def test_unsafe_and_broken(spark, tmp_path):
    bad = bundle(tmp_path / "bad.aab", extra=[("../evil", b"x")])
    with pytest.raises(ValueError, match="unsafe path"):
        compare.profile(spark, bad)
    broken = bundle(tmp_path / "broken.aab", code=False, extra=[("base/dex/classes.dex", b"dex\nno")])
    assert compare.profile(spark, broken).warnings
    with zipfile.ZipFile(tmp_path / "none.aab", "w") as z:
        z.writestr("x", b"y")
    with pytest.raises(ValueError, match="base module"):
        compare.profile(spark, str(tmp_path / "none.aab"))


def test_inbox(spark, tmp_path):
    from kindred.streaming import inbox

    (tmp_path / "in").mkdir()
    bundle(tmp_path / "in" / "a.aab")
    seen = []
    for _ in range(2):
        inbox.watch(spark, str(tmp_path / "in"), lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert len(seen) == 1


def test_catalogue_has_an_oracle_or_a_reason():
    from kindred.plans import catalogue, catalogue_formats

    assert set(catalogue.QUERIES) == set(catalogue.ORACLE) and catalogue_formats.q_manifest_details.__name__ in catalogue.QUERIES


def test_source_tree_and_strict(spark, pair, tmp_path):
    from kindred.sources import tree

    src = tmp_path / "app" / "src"
    for name, text in {
        "main/java/com/app/Main.kt": "package com.app\nclass Main\nfun go() = 1", "test/java/com/app/T.kt": "package com.app\nclass T",
        "main/assets/model.bin": bytes(range(256)) * 20, "main/AndroidManifest.xml": '<manifest><permission name="p"/></manifest>', "main/res/drawable-hdpi/a.png": "x",
        "demo/res/values/strings.xml": "<resources/>",
    }.items():
        f = src / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())
    files = tree.scan(spark, str(tmp_path))
    owners = tree.owners(files, "demoRelease", source_roots=["app/src"])
    rows = [(r.category, r.identifier, r.origin) for r in owners.collect()]
    assert rows == [("asset", "asset:model.bin", "OWNED_SOURCE"), ("code", "Lcom/app/Main;", "OWNED_SOURCE"), ("code", "Lcom/app/MainKt;", "OWNED_SOURCE"), ("image", "drawable-hdpi:a", "OWNED_SOURCE"), ("manifest", "manifest:app/src/main/AndroidManifest.xml", "OWNED_SOURCE"), ("resource", "values:strings", "OWNED_SOURCE")]
    entries = tree.manifest_entries(files, owners)
    assert [r.value for r in entries.collect()] == ["permission:name=p"]
    mapping = spark.createDataFrame([("Lcom/app/Main;", "Lcom/app/Main;")], "output string, original string")
    keys = "type string, qualifiers string, name string"
    merged = spark.createDataFrame([("layout", "", "main", 0, "PUBLIC_DEPENDENCY", "x", "resource"), ("layout", "", "main", 1, "OWNED_SOURCE", "app/src/main/res/layout/main.xml", "resource"), ("string", "", "a", 2, "OWNED_SOURCE", "app/src/main/res/values/s.xml", "resource"), ("string", "", "b", 3, "OWNED_SOURCE", "app/src/main/res/values/s.xml", "resource")], keys + ", seq long, origin string, source_path string, category string")
    inventory = spark.createDataFrame([("string", "", "a", "hello")], keys + ", value string")
    left = compare.strict(compare.profile(spark, pair[0]), owners, mapping, merged, entries, inventory)
    out = compare.compare(left, left, owned=True, lsh=False)["dimensions"]
    assert out["business_code"]["score"] == out["resources"]["score"] == out["assets"]["score"] == out["manifest"]["score"] == 100.0
    assert out["resources"]["l_n"] == 2 and out["resources"]["confidence"] == 0.5 and out["images"]["score"] is None
    assert left.attribution["owned_source"] == 6 and left.attribution["public_dependency"] == 0
