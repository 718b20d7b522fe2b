"""Strict ownership from settings to a report: evidence, lock, registry, command line."""

import hashlib
import json
import os
import zipfile

import pytest

from kindred import __main__ as command
from kindred.plans import ownership, report
from kindred.sources import archive

from .test_compare import bundle

KOTLIN = "package com.app\nclass Main\nfun go() = 1\nfun m0() = 2"
MANIFEST = '<manifest xmlns:android="http://schemas.android.com/apk/res/android"><application><activity android:name=".Main"/></application></manifest>'


def project(root, *, embedded=True, renamed=False):
    """A project that was built: sources, mergers, mapping, artifact."""
    res = root / "app/src/main/res/layout"
    res.mkdir(parents=True)
    name = "other" if renamed else "main"
    (res / f"{name}.xml").write_text("<x/>")
    for path, text in {"app/src/main/java/com/app/Main.kt": KOTLIN, "app/src/test/java/com/app/T.kt": "package com.app\nclass T", "app/src/main/AndroidManifest.xml": MANIFEST}.items():
        f = root / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    asset = root / "app/src/main/assets/model.bin"
    asset.parent.mkdir(parents=True)
    asset.write_bytes(bytes(range(256)) * 20)
    build = root / "app/build/intermediates/incremental/demoRelease"
    final, own = build / "mergeDemoReleaseResources/merger.xml", build / "packageDemoReleaseResources/merger.xml"
    for f, dependency in ((final, "true"), (own, "false")):
        f.parent.mkdir(parents=True)
        f.write_text(f'<merger><dataSet from-dependency="{dependency}"><source path="{res}"><file path="{res}/{name}.xml" type="layout" name="{name}" qualifiers=""/></source></dataSet></merger>')
    mapping = b"# \xff\xfe\ncom.app.Main -> com.app.Main:\r\n    int x -> a\ncom.\xff.Bad -> b.\xfe:\n"
    (root / "app/src/main/java/com/app/Bytes.java").write_bytes(b"package com.app; class Bytes { String s = \"\xff\"; }")
    disk = root / "app/build/outputs/mapping/demoRelease/mapping.txt"
    disk.parent.mkdir(parents=True)
    disk.write_bytes(mapping)
    extra = [(archive.MAPPING, "# nothing\n"), ("BUNDLE-METADATA/z/mapping.txt", mapping)] if embedded else []
    report = root / "app/build/reports/hardening/demoRelease/bundle-verification.json"
    report.parent.mkdir(parents=True)
    report.write_bytes(b'{"variant": "demo\xffRelease"}')  # no report of this variant
    bundle(root / "app.aab", renamed=renamed, extra=extra)
    return root


def settings(folder, left, right, **more):
    side = lambda n, p: f'[{n}]\nproject_root = "{p}"\nsource_roots = ["app/src"]\nvariant = "demoRelease"\nartifact_output = "app.aab"\n' + more.get(n, "")
    path = folder / "ownership.toml"
    path.write_text('schema_version = 2\nprovenance_lock = "pair.lock"\n' + more.get("top", "") + side("left", left) + side("right", right))
    return path


@pytest.fixture(scope="module")
def built(tmp_path_factory):
    d = tmp_path_factory.mktemp("owned")
    return d, settings(d, project(d / "l"), project(d / "r", embedded=False, renamed=True))


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (("demoRelease", "DemoRelease"), "lower camel case"), (('"app/src"', '"../src"'), "outside the project"), (("variant =", "varient ="), "unknown keys varient"), (("schema_version = 2", "schema_version = 9"), "not supported"),
        (('provenance_lock = "pair.lock"\n', ""), "needs a provenance_lock"), (('"pair.lock"', '"l/pair.lock"'), "outside the projects"), (('"pair.lock"', '"ownership.toml"'), "overlap the settings"),
        (('artifact_output = "app.aab"\n', 'artifact_output = "app.aab"\nprepare_task = "rm -rf"\n'), "no task path"), (("project_root", "x_root"), "unknown keys x_root"),
    ],
)
def test_settings(built, change, said):
    d, path = built
    text = path.read_text()
    wrong = d / "wrong.toml" if "ownership" not in change[1] else path
    try:
        wrong.write_text(text.replace(*change, 1))
        with pytest.raises(ValueError, match=said):
            ownership.load(wrong)
    finally:
        path.write_text(text)
    given = ownership.load(path)
    assert given.left.modules == ["app"] and given.lock == d / "pair.lock" and given.right.artifact == d / "r/app.aab"


def test_embedded_mapping(spark, built):
    d, _ = built
    rows = archive.embedded_mapping(archive.contents(spark, str(d / "l/app.aab"))).collect()
    found = {(r.output, r.original, r.entry) for r in rows}
    assert found == {(a, b, "BUNDLE-METADATA/z/mapping.txt") for a, b in (("Lcom/app/Main;", "Lcom/app/Main;"), ("Lb/\ufffd;", "Lcom/\ufffd/Bad;"))}
    assert archive.embedded_mapping(archive.contents(spark, str(d / "r/app.aab"))).count() == 0


def test_owned_from_lock_to_report(spark, built, tmp_path, capsys):
    d, path = built
    registry = str(tmp_path / "registry")
    pair = [str(d / "l/app.aab"), str(d / "r/app.aab")]
    assert ownership.Registry(registry).lookup(*pair)[0] == "missing"
    assert command.main(["prepare", str(path), "--registry", registry]) == 0
    lock = json.loads((d / "pair.lock").read_text())
    roles = {n: sorted(x["role"] for x in s["evidence"]) for n, s in lock["sides"].items()}
    assert roles["left"] == ["artifact", "embedded-mapping", "final", "module-package", *["source"] * 5] and roles["right"] == ["artifact", "final", "mapping", "module-package", *["source"] * 5]
    assert ownership.Registry(registry).lookup(*pair)[:2] == ("matched", path) and ownership.Registry(registry).lookup(*pair[::-1])[0] == "missing"
    # the registered pair is compared by ownership
    assert command.main([*pair, str(tmp_path / "out"), "--registry", registry]) == 0
    found = report.read(tmp_path / "out")
    score = {k: v["score"] for k, v in found["dimensions"].items()}
    assert found["strategy"] == "strict" and found["selection"]["status"] == "matched" and score["business_code"] == score["resources"] == score["assets"] == score["manifest"] == 100.0
    assert found["attribution"]["left"]["owned_source"] > 0 and "## Attribution" in (tmp_path / "out/report.md").read_text()
    assert json.loads((tmp_path / "out/analysis.schema.json").read_text())["required"] and set(found["evidence"]) == {f"evidence/{p.name}" for p in (tmp_path / "out/evidence").iterdir()}
    assert "app/src/main/java/com/app/Main.kt:4" in (tmp_path / "out/evidence/business_code-001.txt").read_text() + (tmp_path / "out/evidence/business_code-002.txt").read_text()
    assert found["origins"]["left"]["by_source"]["app/src/main/java/com/app/Main.kt"] >= 2 and "agp" not in found["left"] and found["diagnostics"]["agp"] == {"left": "8.1.0", "right": "8.2.0"}
    text = (tmp_path / "out/report.md").read_text()
    assert "proven own" in text and "### Sources, left" in text and "| app/src/main/java/com/app/Main.kt | " in text and "## Diagnostics" in text
    assert found["dimensions"]["business_code"]["origins"]["left"]["OWNED_SOURCE"] > 0 and "snippets" not in found
    # an input that changed: the lock no longer holds, auto falls back, owned says so
    source = d / "l/app/src/main/java/com/app/Main.kt"
    source.write_text(KOTLIN + "\nclass More")
    try:
        assert command.main([*pair, str(tmp_path / "auto"), "--registry", registry]) == 0
        found = report.read(tmp_path / "auto")
        assert found["selection"]["status"] == "stale" and "Main.kt" in found["selection"]["message"] and found["strategy"] == "heuristic"
        assert command.main([*pair, str(tmp_path / "no"), "--mode", "owned", "--ownership-config", str(path)]) == 2 and "since the lock" in capsys.readouterr().err
        os.utime(source, (os.stat(source).st_mtime + 100,) * 2)
        with pytest.raises(ValueError, match="older than its inputs"):
            ownership.write_lock(spark, ownership.load(path))
    finally:
        source.write_text(KOTLIN)


def test_what_changes_after_the_lock_does_not_reach_the_result(spark, built, tmp_path):
    d, path = built
    given = ownership.load(path)
    e = ownership.gather(spark, given.left)
    artifact, source = d / "l/app.aab", d / "l/app/src/main/java/com/app/Main.kt"
    held = artifact.read_bytes()
    try:
        bundle(artifact, code=False)
        source.write_text("package com.app\nclass Other")
        p = ownership.profile(spark, e)
        assert p.header["path"] == str(artifact) and p.header["sha256"] == hashlib.sha256(held).hexdigest() and p.methods.count() == 2
        assert {r.identifier for r in e.owners.where("category = 'code'").collect()} == {"Lcom/app/Main;", "Lcom/app/MainKt;", "Lcom/app/Bytes;"}
    finally:
        artifact.write_bytes(held)
        source.write_text(KOTLIN)


def test_a_lock_is_never_written_over_something_else(spark, built, tmp_path):
    d, path = built
    given = ownership.load(path)
    (tmp_path / "notes").write_text("mine")
    for wrong, said in ((tmp_path / "notes", "no lock"), (tmp_path / "link", "link")):
        if said == "link":
            wrong.symlink_to(tmp_path / "notes")
        with pytest.raises(ValueError, match=said):
            ownership.write_lock(spark, ownership.Ownership(given.left, given.right, wrong, path))
    os.link(tmp_path / "notes", tmp_path / "twice")
    with pytest.raises(ValueError, match="of its own"):
        ownership._read_alone(tmp_path / "twice")
    with pytest.raises(ValueError, match="changed meanwhile"):
        ownership.replace_atomically(tmp_path / "notes2", "x", (b"", (0, 0)))
    assert (tmp_path / "notes").read_text() == "mine" and not list(tmp_path.glob(".*.tmp"))


def test_registry_records(built, tmp_path):
    d, path = built
    (d / "pair.lock").touch()
    given, registry = ownership.load(path), ownership.Registry(tmp_path / "r")
    record = registry.register(given)
    pair = (given.left.artifact, given.right.artifact)
    text = record.read_text()
    for change, status in ((("{", "["), "invalid"), (('"schema_version": 1', '"schema_version": 2'), "invalid"), (('"sha256": "', '"sha256": "0'), "stale"), (("app.aab", "b.aab"), "invalid"), (("pair.lock", "gone.lock"), "stale"), (("x", "x"), "matched")):
        record.write_text(text.replace(*change, 1))
        assert registry.lookup(*pair)[0] == status, change
    record.unlink()
    record.symlink_to(path)
    assert registry.lookup(*pair)[0] == "invalid"
    (tmp_path / "l").symlink_to(tmp_path / "r")
    with pytest.raises(ValueError, match="must be a folder"):
        ownership.Registry(tmp_path / "l")


def test_archives_that_are_not_read(spark, tmp_path):
    from kindred.config import ArchiveLimits

    (tmp_path / "a.aab").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "b.aab", "w") as z:
        z.writestr("x", b"y" * 5000)
    limits = ArchiveLimits(max_input_size=1000)
    problems = {r.archive.rsplit("/", 1)[1]: r.problem for r in archive.check(archive.entries(spark, str(tmp_path), limits), limits).collect()}
    assert problems == {"a.aab": "not an archive", "b.aab": "input too large"}
    assert archive.contents(spark, str(tmp_path), limits).count() == 0
