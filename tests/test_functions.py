"""Column functions and parsers against literal expectations."""

import pytest
from pyspark.sql import functions as F

from kindred import config
from kindred.functions import columns as C
from kindred.sources import manifests, parsers


def one(spark, expr, **values):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    ("path", "category", "module"),
    [
        ("base/res/drawable/a.PNG", "image", "base"), ("base/res/layout/a.xml", "resource", "base"), ("f/assets/m.bin", "asset", "f"),
        ("base/lib/arm64-v8a/x.so", "native", "base"), ("base/lib/x.so", None, "base"), ("BundleConfig.pb", "build", "bundle"),
        ("META-INF/A.SF", "build", "bundle"), ("BUNDLE-METADATA/x/y.json", "build", "bundle"), ("base/dex/classes.dex", None, "base"),
    ],
)
def test_dispatch(spark, path, category, module):
    assert one(spark, C.category(F.lit(path))) == category and one(spark, C.module(F.lit(path))) == module


@pytest.mark.parametrize(
    ("name", "family"),
    [("invoke-virtual/range", "invoke"), ("const-string", "const"), ("IF-EQZ", "if"), ("sget-object", "field-get"), ("iput-wide", "field-put"), ("aget", "array-get"), ("aput-byte", "array-put"), ("new-array", "new"), ("packed-switch", "switch"), ("add-int/lit8", "add"), ("throw", "throw"), ("move-result", "move")],
)
def test_opcode_family(spark, name, family):
    assert one(spark, C.opcode_family(F.lit(name))) == family


def test_canonical_ignores_registers_but_not_string_length(spark):
    def digest(*body):
        rows = spark.createDataFrame([(list(body),)], "i array<struct<name:string,output:string>>")
        return rows.select(C.canonical(F.col("i")).alias("x")).first().x

    a = digest(("const-string", 'v0, "abcdefgh"'), ("invoke-virtual", "v0, Ljava/lang/String;->length()I"), ("return", "v0"))
    b = digest(("const-string", 'v7, "zzzzzzzzz"'), ("invoke-virtual", "v7, Ljava/lang/String;->length()I"), ("return", "v7"))
    c = digest(("const-string", 'v7, "zzzzzzz"'), ("invoke-virtual", "v7, Ljava/lang/String;->length()I"), ("return", "v7"))
    assert a.canonical_hash == b.canonical_hash != c.canonical_hash
    assert (a.opcode_tokens, a.block_signature, a.api_calls, a.constants) == (["const", "invoke", "return"], ["return"], ["Ljava/lang/String;->length"], ["string:1"])


def test_shingles_and_jaccard(spark):
    tokens = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    assert one(spark, C.shingles(tokens())) == [] and one(spark, C.shingles(tokens("a", "b"))) == ["a\x1fb"]
    assert len(one(spark, C.shingles(tokens(*"abcdef")))) == 2
    assert one(spark, C.jaccard(tokens(), tokens())) == 1.0 and one(spark, C.jaccard(tokens("a"), tokens())) == 0.0
    assert one(spark, C.jaccard(tokens("a", "b"), tokens("b", "c"))) == pytest.approx(1 / 3)


def test_hashes(spark):
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    binary = lambda b: F.unhex(F.lit(b.hex()))
    data = b"abc \x00\xff deadbeef0 0x123456 cafe android.app"
    features = one(spark, C.printable_tokens(binary(data)))
    assert features == ["0x123456", "abc", "android.app", "cafe", "deadbeef0"]
    assert one(spark, C.semantic_hash(C.printable_tokens(binary(data)), binary(data))) == sha(b"abc\nandroid.app\ncafe")
    assert one(spark, C.semantic_hash(C.printable_tokens(binary(b"\0")), binary(b"\0"))) == sha(b"\0")
    assert one(spark, C.chunk_digests(binary(b""))) == []
    assert one(spark, C.chunk_digests(binary(b"x" * 5000))) == [hashlib.sha1(b"x" * n).hexdigest()[:16] for n in (4096, 904)]
    assert one(spark, C.manifest_markers(C.printable_tokens(binary(data)))) == ["android.app"]
    assert one(spark, C.hamming(C.hash_bits(F.lit("ffffffffffffffff")), C.hash_bits(F.lit("fffffffffffffff0")))) == 4


@pytest.mark.parametrize(
    ("path", "kind", "origin"),
    [
        ("base/res/layout/abc_x.xml", "resource", "PUBLIC_DEPENDENCY"), ("base/res/layout/$m3_x__0.xml", "resource", "PUBLIC_DEPENDENCY"),
        ("base/res/drawable/mtrl_a.9.png", "image", "PUBLIC_DEPENDENCY"), ("base/res/values/google_services.xml", "resource", "TOOL_GENERATED"),
        ("base/assets/nim/x", "asset", "PUBLIC_DEPENDENCY"), ("base/assets/own/nim/x", "asset", "HEURISTIC_OWNED"), ("base/lib/a/x.so", "native", "PUBLIC_DEPENDENCY"),
        ("base/res/layout/main.xml", "resource", "HEURISTIC_OWNED"),
    ],
)
def test_file_origin(spark, path, kind, origin):
    assert one(spark, C.file_origin(F.lit(path), F.lit(kind))) == origin


def test_method_ladder(spark):
    rows = [("Lcom/app/R$id;", False), ("Lcom/app/A;", False), ("Lcom/google/B;", False), ("Lx/C;", True), ("Lx/D;", False), ("Lcom/app/databinding/EBinding;", False)]
    got = spark.createDataFrame(rows, "c string, t boolean").select(C.method_origin(F.col("c"), F.col("t"), ("Lcom/app/",), config.THIRD_PARTY_PREFIXES).alias("x")).collect()
    assert [(r.x.origin, r.x.confidence) for r in got] == [("TOOL_GENERATED", None), ("HEURISTIC_OWNED", 0.75), ("PUBLIC_DEPENDENCY", None), ("PUBLIC_DEPENDENCY", None), ("HEURISTIC_OWNED", 0.45), ("TOOL_GENERATED", None)]


@pytest.mark.parametrize(
    ("lines", "wanted"),
    [
        (["(default)"], ""), (['locale: "sr-Latn"'], "b+sr+Latn"), (['locale: "zh-CN"'], "zh-rCN"), (['locale: "de"'], "de"), (["density: 65534"], "anydpi-v21"), (["density: 240"], "hdpi-v4"),
        (["ui_mode_night: UI_MODE_NIGHT_NIGHT", "sdk_version: 33"], "night-v33"), (["smallest_screen_width_dp: 600", 'locale: "de"'], "de-sw600dp-v13"), (["orientation:  ORIENTATION_LAND"], "land"),
        (["mystery: 1"], None), (["density: 7"], None), (["(default)", "sdk_version: 3"], None), (["sdk_version: x"], None), (["layout_direction: LAYOUT_DIRECTION_RTL", "sdk_version: 8"], "ldrtl-v17"),
    ],
)
def test_qualifiers(spark, lines, wanted):
    assert one(spark, parsers.resource_qualifier(F.array(*map(F.lit, lines)))) == wanted


def test_resource_dump(spark):
    text = """Package 'a':
0x7f010000 - string/title
    (default) - [STR] "Hello   there"
    locale: "zh-CN" - [STR] "x"
    ui_mode_night: UI_MODE_NIGHT_NIGHT
    sdk_version: 33 - [REF] @a/b
0x7f010001 - id/button
    (default) - [ID]
    mystery: 4 - [STR] "no"
    (default) - [ID] last
"""
    values, declared = parsers.resource_dump(spark.createDataFrame([("a", text)], "archive string, text string"))
    assert {(r.type, r.qualifiers, r.name): r.value for r in values.collect()} == {("string", "", "title"): '"Hello there"', ("string", "zh-rCN", "title"): '"x"', ("string", "night-v33", "title"): "@a/b", ("id", "", "button"): "last"}
    assert declared.first().declarations == 2


def test_r8_mapping(spark):
    text = "# note\na.b.C -> x.y:\n    int f -> a\na.b.D -> x.y:\n\n -> z:\nq.R -> s:"
    got = parsers.r8_mapping(parsers.mapping_lines(spark.createDataFrame([(text.encode(),)], "content binary"), [])).collect()
    assert sorted(map(tuple, got)) == [("Ls;", "Lq/R;"), ("Lx/y;", "La/b/C;"), ("Lx/y;", "La/b/D;")]


def test_dependencies(spark):
    data = b"\0com.squareup.okio\0okio\x003.9.0\0\1org.a.b\0core 1.2.3-rc1\0plain\0x\0"
    got = parsers.dependency_coordinates(spark.createDataFrame([("p", data)], "path string, content binary")).collect()
    assert sorted(r.dependency for r in got) == ["com.squareup.okio:okio:3.9.0", "org.a.b:core:1.2.3-rc1"]


MANIFEST = """<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="com.app">
<permission android:name="com.app.P"/><application><activity android:name=".Main" android:exported="True"><intent-filter>
<action android:name="com.app.GO"/></intent-filter></activity><provider android:name="Data"/></application></manifest>"""


def message(*fields):
    """A protocol buffer of (field, bytes) or (field, number)."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return b"".join(varint(f << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v) for f, v in fields)


def binary_manifest(element):
    """The binary form of an ElementTree element."""
    def name(x):
        space, _, short = x.rpartition("}")
        return space.lstrip("{").encode(), short.encode()

    attrs = [(4, message(*[(n, v) for n, v in zip((1, 2, 3), (*name(k), v.encode())) if v], (4, message((1, 7))), (5, 16842755))) for k, v in element.attrib.items()]
    children = [(5, message((2, b"\n  ")))] + [(5, binary_manifest(c)) for c in element]
    return message((1, message((1, message((1, b"android"))), (3, name(element.tag)[1]), *attrs, *children)), (3, message((1, 300))))


def manifest_of(spark, content):
    df = spark.createDataFrame([(content,)], "c binary").withColumn("r", manifests.elements_udf("c"))
    return df.select(manifests.details(F.col("r"), F.col("c")).alias("d"), manifests.owned_values(F.col("r")).alias("o")).first()


@pytest.mark.parametrize("binary", [False, True])
def test_manifest(spark, binary):
    from xml.etree import ElementTree

    content = binary_manifest(ElementTree.fromstring(MANIFEST)) if binary else MANIFEST.encode()
    d, owned = manifest_of(spark, content)
    assert d.package == "com.app" and [tuple(c) for c in d.components] == [("activity", "com.app.Main"), ("provider", "com.app.Data")]
    assert d.actions == ["com.app.GO"] and d.permissions == ["com.app.P"]
    assert d.features == ["action:attr:name", "action:name=com.app.GO", "activity:attr:exported", "activity:attr:name", "activity:exported=true", "count:action:1", "count:activity:1", "count:application:1", "count:intent-filter:1", "count:manifest:1", "count:permission:1", "count:provider:1", "manifest:attr:package", "permission:attr:name", "provider:attr:name", "tag:action", "tag:activity", "tag:application", "tag:intent-filter", "tag:manifest", "tag:permission", "tag:provider"]
    assert owned == ["permission:name=com.app.P", "activity:name=.Main|exported=True", "intent-filter", "action:name=com.app.GO", "provider:name=Data"]


def test_a_manifest_is_parsed_once(spark):
    """A filter on what was parsed does not parse again; a package is read without the elements."""
    from xml.etree import ElementTree

    from kindred.plans import compare

    given = [MANIFEST.encode(), binary_manifest(ElementTree.fromstring(MANIFEST)), b"<manifest/>", b'<m xmlns:a="u" a:package="x"/>', b'<m package=""/>', b"<abc><x", b"", None]
    df = spark.createDataFrame([(x,) for x in given], "c binary")
    details = df.withColumn("r", manifests.elements_udf("c")).select(manifests.details(F.col("r"), F.col("c")).alias("d")).select("d.*")
    packages = df.select(manifests.package_udf("c").alias("package"))
    assert [r.package for r in packages.collect()] == [r.package for r in details.collect()] == ["com.app", "com.app", None, None, "", None, None, None]
    for found in (details, packages):
        prefixes = compare.inferred_prefixes(found)
        assert str(prefixes._jdf.queryExecution().executedPlan()).count("ArrowEvalPython") == 1
        assert {r.prefix for r in prefixes.collect()} == {"Lcom/app/", "L/"}


def test_manifests_that_cannot_be_read(spark):
    d, owned = manifest_of(spark, b"<abc><x")
    assert d.features == ["<abc><x"] and d.package is None and d.components == d.actions == [] and owned is None
    assert manifest_of(spark, b"").d.features == [] and manifests.elements(None) is None and manifests.elements(message((2, b"text"))) is None
    deep = b""
    for _ in range(3000):
        deep = message((1, message((3, b"a"), *[(5, deep)] * bool(deep))))
    assert len(manifests.elements(deep)) == 3000


def test_merger():
    xml = b"""<merger><dataSet config="m"><source path="/p"><file path="/p/l.xml" type="layout" name="a" qualifiers="land"/>
    <file path="/p/v.xml"><string name="t"/><item type="id" name="i"/><item name="no"/></file></source></dataSet>
    <dataSet config="d" from-dependency="true"><source path="/d"><file><color name="c"/></file></source></dataSet></merger>"""
    assert parsers.merger_rows(xml) == [(0, False, "/p/l.xml", "land", "layout", "a"), (1, False, "/p/v.xml", "", "string", "t"), (2, False, "/p/v.xml", "", "id", "i"), (3, True, "/d", "", "color", "c")]
    assert parsers.merger_rows(b"<broken") == []


def test_declared_classes():
    kotlin = 'package a.b\n// class No\nclass A { class Inner }\nobject B\nfun top() = "class X"\n/* interface C */'
    assert parsers.declared_classes("x/File.kt", kotlin) == ["La/b/A;", "La/b/B;", "La/b/FileKt;"]
    assert parsers.declared_classes("x/A.java", "package a;\npublic final class A { enum B {} }\ninterface C {}") == ["La/A;", "La/C;"]
    assert parsers.declared_classes("x/A.java", "") == []


def test_png_and_binaries():
    import struct
    import zlib

    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    rows = b"".join(b"\2" + bytes([x * 8 if y == 0 else 0 for x in range(32) for _ in range(3)]) for y in range(32))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 32, 32, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    p = parsers.png_pixels(png)
    assert p.shape == (32, 32, 3) and (p[5, :, 0] == [x * 8 for x in range(32)]).all() and len(parsers.perceptual_hash(p)) == 16
    assert parsers.png_pixels(b"no") is None and parsers.elf_features(b"\x7fELF\2\1") is None and parsers.elf_features(b"") is None


def test_mapping_lines_of_any_bytes(spark, monkeypatch):
    """Several slices of lines, other line ends, bytes that are no UTF-8, null and empty files."""
    monkeypatch.setattr(parsers, "LINES", 3)
    text = b"# c -> d\n\n  m() -> a\na.A -> x.X:\r\na.B -> x.X:\r\xff.C -> y:\nno arrow\n" + b"".join(b"p.C%d -> q.D%d:\n    int f -> a\n" % (i, i % 4) for i in range(20)) + b"last.One -> z"
    found = parsers.mapping_lines(spark.createDataFrame([("k", text), ("n", None), ("e", b"")], "key string, content binary"), ["key"]).collect()
    assert all(text[r.at :].startswith(r.line.encode()) for r in found if "\ufffd" not in r.line) and {r.key for r in found} == {"k"}
    pairs = {(r.output, r.original) for r in parsers.r8_mapping(spark.createDataFrame(found), key="key").collect()}
    assert pairs == {("Lx/X;", "La/A;"), ("Lx/X;", "La/B;"), ("Ly;", "L\ufffd/C;"), ("Lz;", "Llast/One;")} | {(f"Lq/D{i % 4};", f"Lp/C{i};") for i in range(20)}


def test_resource_table():
    """The binary form gives what the textual dump of the same resources says."""
    from kindred.sources import resources

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def field(number, value):
        return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value

    def value(item, config=b"", compound=False):
        return field(6, field(1, config) + field(2, field(5 if compound else 4, item)))

    def entry(name, *values):
        return field(3, field(2, name.encode()) + b"".join(values))

    def kind(name, *entries):
        return field(3, field(2, name.encode()) + b"".join(entries))

    style = field(2, b"".join(field(3, field(4, field(1, field(2, 7) + field(3, x)))) for x in (b"color/accent", b"x/y")))
    table = field(2, field(2, b"com.example") + kind("string", entry("app_name", value(field(2, field(1, b"Example App"))), value(field(2, field(1, "\u793a\u4f8b".encode())), field(3, b"zh-CN"))), entry("none"))
        + kind("color", entry("accent", value(field(7, field(9, 0xFF102030))), value(field(7, field(12, 0xFF112233)), field(18, 240))))
        + kind("style", entry("AppTheme", value(style, compound=True)))
        + kind("bool", entry("night_enabled", value(field(7, field(8, 1)), field(17, 1) + field(24, 33))))
        + kind("dimen", entry("gap", value(field(7, field(13, 16 << 8 | 1))), value(field(7, field(6, (1 << 64) - 5)), field(15, 2)))))
    assert list(resources.values(table)) == [
        ("string", "app_name", ["(default)"], '"Example App"'), ("string", "app_name", ['locale: "zh-CN"'], '"\u793a\u4f8b"'), ("string", "none", None, None),
        ("color", "accent", ["(default)"], "#ff102030"), ("color", "accent", ["density: 240"], "#123"), ("style", "AppTheme", ["(default)"], "[@color/accent, @x/y]"),
        ("bool", "night_enabled", ["ui_mode_night: UI_MODE_NIGHT_NIGHT", "sdk_version: 33"], "true"), ("dimen", "gap", ["(default)"], "16dp"), ("dimen", "gap", ["orientation: ORIENTATION_LAND"], "-5"),
    ]
    with pytest.raises(ValueError):
        list(resources.values(b"\xff" * 20))
