"""The catalogue's queries on formats: each builds the inputs of a parser or rule from the driver's tables - a manifest, a
dump, a source file a row - and calls the library; the SQL says what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred import config
from kindred.functions import columns as C
from kindred.operators import attribution as A
from kindred.plans import compare, registry, report
from kindred.plans.catalogue import CLASS, PRINTABLE, _any, dealt, query, table
from kindred.sources import archive, dex, manifests, parsers, resources, tree


def part(spark, sf_dir, **columns: str) -> DataFrame:
    """p_partkey with columns of Spark SQL over part."""
    return table(spark, sf_dir, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in columns.items()])


def lines(x: Column | str) -> Column:
    return F.array_join(x, "\n")


# --- manifests -------------------------------------------------------------------------------------------------------------

MANIFEST = """case when p_partkey % 11 = 0 then '<broken tok' || p_partkey else '<manifest xmlns:android="http://schemas.android.com/apk/res/android" package="app.p' || p_size % 7 || '"><uses-sdk android:minSdkVersion="' || p_size
    || '"/><permission android:name="perm' || p_partkey % 5 || '"/><application><activity android:exported="TRUE" android:name="' || case p_partkey % 3 when 0 then '.Main' when 1 then 'Main' else 'x.y.Main' end
    || '"><intent-filter><action android:name="act' || p_size % 3 || '"/></intent-filter></activity></application></manifest>' end"""
TAGS = ("action", "activity", "application", "intent-filter", "manifest", "permission", "uses-sdk")


def _manifests(spark, sf_dir) -> DataFrame:
    return dealt(table(spark, sf_dir, "part")).select("p_partkey", F.expr(f"cast({MANIFEST} as binary)").alias("content"))


@query(
    f"""select p_partkey, case when bad then '<broken' || chr(10) || 'tok' || p_partkey else array_to_string(list_sort([{", ".join(f"'tag:{t}', 'count:{t}:1'" for t in TAGS)},
    'action:attr:name', 'action:name=act' || p_size % 3, 'activity:attr:exported', 'activity:attr:name', 'activity:exported=true', 'manifest:attr:package', 'permission:attr:name', 'uses-sdk:attr:minSdkVersion', 'uses-sdk:minSdkVersion=' || p_size]), chr(10)) end as features,
    case when not bad then 'app.p' || p_size % 7 end as package, case when bad then '' else 'activity=' || case when p_partkey % 3 = 2 then 'x.y.Main' else 'app.p' || p_size % 7 || '.Main' end end as components,
    case when bad then '' else 'perm' || p_partkey % 5 end as permissions, case when bad then '' else 'act' || p_size % 3 end as actions from (select *, p_partkey % 11 = 0 as bad from part)"""
)
def q_manifest_details(spark, sf_dir):
    """FN-13, FN-14."""
    p = _manifests(spark, sf_dir).withColumn("rows", manifests.elements_udf("content"))
    d = p.select("p_partkey", manifests.details(F.col("rows"), F.col("content")).alias("d"))
    named = F.transform("d.components", lambda c: F.concat(c.tag, F.lit("="), c["name"]))
    return d.select("p_partkey", lines("d.features").alias("features"), "d.package", lines(named).alias("components"), lines("d.permissions").alias("permissions"), lines("d.actions").alias("actions"))


@query(
    """select p_partkey, array_to_string(['uses-sdk:minSdkVersion=' || p_size, 'permission:name=perm' || p_partkey % 5, 'activity:name=' || case p_partkey % 3 when 0 then '.Main' when 1 then 'Main' else 'x.y.Main' end || '|exported=TRUE', 'intent-filter', 'action:name=act' || p_size % 3], chr(10)) as elements
    from part where p_partkey % 11 <> 0"""
)
def q_owned_manifest(spark, sf_dir):
    """FN-16: the elements of owned manifests; one that cannot be read gives none."""
    p = _manifests(spark, sf_dir).withColumn("x", manifests.owned_values(manifests.elements_udf("content")))
    return p.where("x is not null").select("p_partkey", lines("x").alias("elements"))


@query("select distinct 'Lapp/p' || p_size % 7 || '/' as prefix from part where p_partkey % 11 <> 0")
def q_inferred_prefixes(spark, sf_dir):
    """PRJ-08: class prefixes of the packages that manifests name."""
    return compare.inferred_prefixes(_manifests(spark, sf_dir).select(manifests.package_udf("content").alias("package")))


# --- resources -------------------------------------------------------------------------------------------------------------


@query(
    """select type, qualifiers, name, max_by(source_path, seq) as source_path from (select 'string' as type, case when l_linenumber = 2 then 'de' else '' end as qualifiers, 's' || l_partkey % 500 as name, (l_orderkey * 10 + l_linenumber) * 1000000 + l_suppkey as seq,
    'src/' || case l_orderkey % 4 when 0 then 'values' when 1 then 'values-de' when 2 then 'layout' else 'valuesX' end || '/f' || l_suppkey || '.xml' as source_path, case when l_returnflag = 'N' then 'image' else 'resource' end as category from lineitem where l_orderkey % 4 < 2) where category = 'resource' group by all"""
)
def q_value_owners(spark, sf_dir):
    """JN-10: the last writer of every value that a values file backs."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.lit("string").alias("type"), F.when(F.col("l_linenumber") == 2, "de").otherwise("").alias("qualifiers"), F.concat(F.lit("s"), F.col("l_partkey") % 500).alias("name"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_suppkey")).alias("seq"),
        F.expr("'src/' || case l_orderkey % 4 when 0 then 'values' when 1 then 'values-de' when 2 then 'layout' else 'valuesX' end || '/f' || l_suppkey || '.xml'").alias("source_path"), F.when(F.col("l_returnflag") == "N", "image").otherwise("resource").alias("category"),
    )
    return A.value_owners(rows).select("type", "qualifiers", "name", "source_path")


def message(field: int, *parts: Column) -> Column:
    """A field of a protocol buffer that holds bytes, with its length in two bytes."""
    byte = lambda x: F.unhex(F.lpad(F.hex(x.cast("long")), 2, "0"))
    # one element, so that the body is written once however deep messages lie in one another
    whole = lambda b: F.concat(F.lit(bytes([field << 3 | 2])), byte(F.octet_length(b) % 128 + 128), byte(F.floor(F.octet_length(b) / 128)), b)
    return F.get(F.transform(F.array(F.concat(*parts)), whole), F.lit(0))


def varint(x: Column) -> Column:
    """Of a number below 2**35, in five bytes."""
    part = lambda k: F.unhex(F.lpad(F.hex(F.shiftrightunsigned(x, 7 * k).bitwiseAND(F.lit(127)) + (128 if k < 4 else 0)), 2, "0"))
    return F.concat(*[part(k) for k in range(5)])


@query(
    """select s_suppkey, r[1] as type, r[2] as qualifiers, r[3] as name, r[4] as value, 4::bigint as declared, 3::bigint as covered from (select s_suppkey, unnest([
    ['string', '', 'title', '"n ' || s_suppkey || '"'], ['string', 'de', 'title', '@x/' || s_nationkey], ['bool', 'night-v33', 'on', 'true'], ['color', '', 'c' || s_suppkey, '#ff1020' || printf('%02x', s_nationkey)]]) as r from supplier)"""
)
def q_resource_table(spark, sf_dir):
    """SRC-07: the same from the binary table; the last value wins, what is not known has none and is not covered."""
    text = lambda field, x: message(field, (F.expr(x) if isinstance(x, str) else x).cast("binary"))
    raw = lambda *x: F.lit(bytes(x))
    item = lambda *x: message(2, message(4, *x))
    value = lambda item, *config: message(6, message(1, *config) if config else message(1, raw()), item)
    entry = lambda name, *values: message(3, text(2, name), *values)
    kind = lambda name, *entries: message(3, text(2, f"'{name}'"), *entries)
    string = lambda x: item(message(2, text(1, x)))
    title = entry("'title'", value(string("'old'")), value(string(r"'n \n ' || s_suppkey")), value(item(message(1, text(3, "'x/' || s_nationkey"))), text(3, "'de'")))
    on = entry("'on'", value(item(message(7, raw(0x40, 1))), raw(0x88, 1, 1, 0xC0, 1, 33)))
    color = entry("'c' || s_suppkey", value(item(message(7, raw(0x48), varint(F.expr("4279246848L + s_nationkey"))))))
    mystery = entry("'odd'", value(string("'no'"), raw(0x08, 5)))
    table_bytes = message(2, text(2, "'app'"), kind("string", title, mystery), kind("bool", on), kind("color", color))
    held = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("archive"), F.lit("base/resources.pb").alias("path"), table_bytes.alias("content"))
    values, covered = resources.inventory(resources.raw_values(held))
    return values.join(covered, "archive").select(F.col("archive").cast("long").alias("s_suppkey"), "type", "qualifiers", "name", "value", "declared", F.col("covered").cast("long").alias("covered"))

MERGER = """'<merger><dataSet config="m" from-dependency="' || case when c_custkey % 2 = 0 then 'True' else 'false' end || '"><source path="/p"><file path="/p/' || c_custkey || '.xml" qualifiers="' || case when c_custkey % 3 = 0 then 'land' else '' end
    || '"><string name="s' || c_custkey || '"/><item type="id" name="i' || c_nationkey || '"/><item name="none"/></file><file name="d' || c_custkey || '" path="/p/' || c_custkey || '.png" type="drawable"/><file><color name="c"/></file></source></dataSet></merger>'"""


@query(
    """select c_custkey, r[1]::bigint as seq, c_custkey % 2 = 0 as from_dependency, r[2] as path, r[3] as qualifiers, r[4] as type, r[5] as name from (select c_custkey, unnest([
    ['0', '/p/' || c_custkey || '.xml', case when c_custkey % 3 = 0 then 'land' else '' end, 'string', 's' || c_custkey], ['1', '/p/' || c_custkey || '.xml', case when c_custkey % 3 = 0 then 'land' else '' end, 'id', 'i' || c_nationkey],
    ['2', '/p/' || c_custkey || '.png', '', 'drawable', 'd' || c_custkey], ['3', '/p', '', 'color', 'c']]) as r from customer)"""
)
def q_merger_rows(spark, sf_dir):
    """FN-15, SRC-11: the resources of a merger, in document order."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.explode(parsers.merger_udf(F.expr(f"cast({MERGER} as binary)"))).alias("x"))
    return c.select("c_custkey", "x.seq", "x.from_dependency", "x.path", "x.qualifiers", "x.type", "x.name")


DUMP = r"""'Package ''a'':\n0x7f010000 - string/title\n    (default) - [STR] "n   ' || s_suppkey || '"\n    locale: "de" - [REF] @x/' || s_nationkey || '\n    ui_mode_night: UI_MODE_NIGHT_NIGHT\n    sdk_version: ' || (9 + s_nationkey) || ' - [ID]\n    mystery: 1 - [STR] no\n0x7f010001 - bool/on' || s_suppkey || '\n    (default) - [BOOL] a   b\n    (default) - [BOOL] true\n'"""


@query(
    """select s_suppkey, r[1] as type, r[2] as qualifiers, r[3] as name, r[4] as value, 2::bigint as declarations from (select s_suppkey, unnest([
    ['string', '', 'title', '"n ' || s_suppkey || '"'], ['string', 'de', 'title', '@x/' || s_nationkey], ['string', 'night-v' || 9 + s_nationkey, 'title', '[ID]'], ['bool', '', 'on' || s_suppkey, 'true']]) as r from supplier)"""
)
def q_resource_dump(spark, sf_dir):
    """FN-17, WIN-04, SRC-07: a resource holds until the next, configuration lines wait for their value, the last value wins."""
    dumps = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(DUMP).alias("text"))
    values, declared = parsers.resource_dump(dumps, key="s_suppkey")
    return values.join(declared, "s_suppkey").select("s_suppkey", "type", "qualifiers", "name", "value", "declarations")


@query(
    """select p_partkey, case p_partkey % 8 when 0 then '' when 1 then 'b+sr+Latn-v' || p_size when 2 then 'de-rAT' when 3 then 'fr-sw' || p_size || 'dp-v13' when 4 then case when p_size % 2 = 0 then 'ldpi-v4' end when 5 then 'land-night-v' || greatest(8, p_size) when 6 then 'ldrtl-large-v17' end as qualifier from part"""
)
def q_resource_qualifier(spark, sf_dir):
    """FN-18."""
    given = """case p_partkey % 8 when 0 then array('(default)') when 1 then array('sdk_version: ' || p_size, 'locale: "sr-Latn"') when 2 then array('locale: "de-at"') when 3 then array('smallest_screen_width_dp: ' || p_size, 'locale: "fr"')
        when 4 then array('density: ' || case when p_size % 2 = 0 then 120 else 121 end) when 5 then array('ui_mode_night: UI_MODE_NIGHT_NIGHT', 'sdk_version: ' || p_size, 'orientation: ORIENTATION_LAND') when 6 then array('screen_layout_size: SCREEN_LAYOUT_SIZE_LARGE', 'layout_direction: LAYOUT_DIRECTION_RTL') else array('(default)', 'mystery: 2') end"""
    return part(spark, sf_dir, c=given).select("p_partkey", parsers.resource_qualifier(F.col("c")).alias("qualifier"))


# --- dependencies, sources, properties ------------------------------------------------------------------------------------------


@query("select p_partkey, 'org.g' || p_size || ':core' || p_partkey % 9 || ':' || case p_partkey % 4 when 0 then '1.' || p_size || '.0' else '2.3.4-rc1' end as dependency from part where p_partkey % 4 < 2")
def q_dependency_coordinates(spark, sf_dir):
    """FN-08, WIN-03: group, artifact and version in consecutive runs of ASCII."""
    runs = "concat(case when p_partkey % 4 = 3 then 'orgg' else 'org.g' end, p_size, chr(0), 'core', p_partkey % 9, case when p_partkey % 4 = 1 then ' v2.3.4-rc1' else '' end, chr(1), case p_partkey % 4 when 2 then 'plain' else '1.' || p_size || '.0' end, chr(0))"
    return parsers.dependency_coordinates(part(spark, sf_dir, content=f"cast({runs} as binary)"), key="p_partkey")


@query(
    """select p_partkey, case when p_partkey % 2 = 0 then 'La/b' || p_size || '/A' || p_partkey || ';' || chr(10) || 'La/b' || p_size || '/B' || p_partkey || ';' || chr(10) || 'La/b' || p_size || '/File' || p_partkey || 'Kt;'
    else 'La/b' || p_size || '/A' || p_partkey || ';' || chr(10) || 'La/b' || p_size || '/I' || p_partkey || ';' end as classes from part"""
)
def q_declared_classes(spark, sf_dir):
    """FN-20, WIN-05: declarations at bracket depth 0 alone, outside comments and strings."""
    kotlin = r"""'package a.b' || p_size || '\n// class No\n)) class A' || p_partkey || ' { class Inner { } }\nobject B' || p_partkey || '\nfun top() = "class X { "'"""
    java = r"""'package a.b' || p_size || ';\npublic final class A' || p_partkey || ' { enum In {} }\n/* class C */ interface I' || p_partkey || ' {}'"""
    p = part(spark, sf_dir, path="case when p_partkey % 2 = 0 then 'x/File' || p_partkey || '.kt' else 'x/A.java' end", text=f"case when p_partkey % 2 = 0 then {kotlin} else {java} end")
    return p.select("p_partkey", lines(parsers.declared_classes_udf("path", "text")).alias("classes"))


@query("select p_partkey, case when p_size % 3 > 0 then '8.' || p_size || '.1' end as agp, case when p_partkey % 5 > 0 then 'hardening:present' || chr(10) || 'hardening:aabSha256:' || sha256(p_name) else 'hardening:present' end as hardening from part")
def q_build_properties(spark, sf_dir):
    """FN-24, FN-25."""
    p = part(spark, sf_dir, a=r"cast('appMetadataVersion=1.1\n' || case when p_size % 3 > 0 then 'androidGradlePluginVersion=8.' || p_size || '.1\r\n' else '' end as binary)", h="""cast(case when p_partkey % 5 > 0 then '{"aabSha256":"' || upper(sha2(p_name, 256)) || '","note":"x","otherSha256":"short"}' else 'no json' end as binary)""")
    return p.select("p_partkey", parsers.agp_version(F.col("a")).alias("agp"), lines(parsers.hardening_features(F.col("h"))).alias("hardening"))


TREE = """case p_partkey % 7 when 0 then 'app/src/main/java/a/A' || p_partkey || '.kt' when 1 then 'app/src/test/java/a/T' || p_partkey || '.kt' when 2 then 'app/src/demo/res/values-de/s' || p_partkey || '.xml' when 3 then 'app/src/demoRelease/assets/d/m' || p_partkey || '.bin'
    when 4 then 'gen/java/G' || p_partkey || '.java' when 5 then 'app/src/main/res/drawable/i' || p_partkey || '.9.png' else 'app/src/hush/AndroidManifest' || p_partkey || '.xml' end"""


@query(
    f"""select case p_partkey % 7 when 0 then 'La/A' || p_partkey || ';' when 2 then 'values-de:s' || p_partkey when 3 then 'asset:d/m' || p_partkey || '.bin' when 4 then 'LG' || p_partkey || ';' else 'drawable:i' || p_partkey end as identifier,
    case p_partkey % 7 when 0 then 'code' when 2 then 'resource' when 3 then 'asset' when 4 then 'code' else 'image' end as category, case when p_partkey % 7 = 4 then 'OWNED_GENERATED' else 'OWNED_SOURCE' end as origin, {TREE} as source_path, case when p_partkey % 7 = 4 then ':gen' else ':app' end as module, sha256(case p_partkey % 7 when 0 then 'package a' || chr(10) || 'class A' || p_partkey when 4 then 'class G' || p_partkey || ' {{}}' else p_name end) as sha256
    from part where p_partkey % 7 not in (1, 6)"""
)
def q_source_owners(spark, sf_dir):
    """SRC-09, SRC-10, PRJ-23: what the source sets of a variant and the generated roots own."""
    files = part(spark, sf_dir, path=TREE, modified="0L", content=r"cast(case p_partkey % 7 when 0 then 'package a\nclass A' || p_partkey when 4 then 'class G' || p_partkey || ' {}' else p_name end as binary)").drop("p_partkey")
    return tree.owners(files, "demoRelease", source_roots=["app/src"], generated_roots=["gen"]).drop("modified")


# --- files and methods -----------------------------------------------------------------------------------------------------------


@query(f"select 'META-INF/' || page_id || '.SF' as path, 'bundle' as module, 'build' as category, array_to_string({PRINTABLE}[1:200], chr(10)) as features, octet_length(encode(coalesce(html, '')))::bigint as size, sha256(coalesce(html, '')) as sha256 from pages")
def q_feature_cap(spark, sf_dir):
    """SRT-06: of a build file the first 200 features."""
    pages = table(spark, sf_dir, "pages").select(F.lit("a").alias("archive"), F.expr("'META-INF/' || page_id || '.SF'").alias("path"), F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return archive.file_rows(pages).select("path", "module", "category", lines("features").alias("features"), "size", "sha256")


#: A library of one section of eight bytes, before and after the number of its machine.
ELF = ("7f454c460201010000000000000000000300", "01000000" + "00" * 16 + "4000000000000000" + "00000000" + "400000000000" + "400003000200" + "00" * 64, "01000000" + "01000000" + "00" * 16 + "0001000000000000" + "0800000000000000" + "00" * 24, "07000000" + "03000000" + "00" * 16 + "0801000000000000" + "1100000000000000" + "00" * 24, "002e74657874002e736873747274616200")
_ELF = "unhex('{0}') || unhex(case when p_partkey % 4 = 0 then '3e00' else 'b700' end) || unhex('{1}{2}{3}') || {t} || unhex('{4}')"


@query(
    f"""select 'base/lib/x86/n' || p_partkey || '.so' as path, case when p_partkey % 2 = 0 then array_to_string(list_sort(['elf', 'arch:' || case when p_partkey % 4 = 0 then 62 else 183 end, 'text:' || sha256('T' || lpad(p_partkey::varchar, 7, '0')), 'chunk:' || substr(sha1({_ELF.format(*ELF, t="encode('T' || lpad(p_partkey::varchar, 7, '0'))")}), 1, 16)]), chr(10))
    else array_to_string(list_sort(['binary', 'lib' || p_partkey || '.so', 'chunk:' || substr(sha1('lib' || p_partkey || '.so ' || p_name), 1, 16)]), chr(10)) end as features from part"""
)
def q_native_features(spark, sf_dir):
    """FN-09: of ELF libraries, with machine and code, and of files that are none."""
    elf = _ELF.format(*ELF, t="cast('T' || lpad(cast(p_partkey as string), 7, '0') as binary)")
    p = part(spark, sf_dir, archive="'a'", path="'base/lib/x86/n' || p_partkey || '.so'", content=f"case when p_partkey % 2 = 0 then {elf} else cast('lib' || p_partkey || '.so ' || p_name as binary) end").drop("p_partkey")
    return archive.file_rows(p).select("path", lines("features").alias("features"))


@query("select p_partkey, p_name, row_number() over (order by p_name, p_partkey) - 1 as ord from part")
def q_canonical_order(spark, sf_dir):
    """SRT-05: places in canonical order, without one sorting task."""
    return compare.ordered(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query(f"select p_partkey as position, {CLASS} || '->m()V' as identifier, 'base' as module, p_size::bigint as instruction_count from part where p_size >= 12 and not {_any(CLASS.join('()'), config.THIRD_PARTY_PREFIXES)}")
def q_method_retention(spark, sf_dir):
    """PRJ-04, PRJ-05, FN-12: methods of enough instructions that are not a third party's."""
    raw = part(spark, sf_dir, archive="'a'", dex_path="'base/dex/classes.dex'", class_name=CLASS, method_name="'m'", descriptor="'()V'", instructions="array_repeat(named_struct('name', 'nop', 'output', ''), p_size)", warning="cast(null as string)").withColumnRenamed("p_partkey", "position")
    return dex.method_rows(raw).where("not third_party").select("position", "identifier", "module", "instruction_count")


# --- evidence and reports ---------------------------------------------------------------------------------------------------------

DAY = 86_400


@query(
    """with a as (select o_orderkey as side, (date_diff('day', date '1970-01-01', o_orderdate) + 60) * 86400 as made, (date_diff('day', date '1970-01-01', o_orderdate) + 60 - o_custkey % 2) * 86400 - o_orderkey % 9 * 3600 as ev from orders),
    i as (select l_orderkey as side, l_returnflag as category, max(date_diff('day', date '1970-01-01', l_shipdate)) * 86400 as newest from lineitem group by all)
    select a.side, 'artifact is older than its inputs' as problem from a join (select side, max(newest) as newest from i group by side) i on i.side = a.side where newest > made
    union all select a.side, 'mapping is stale' from a left join i on i.side = a.side and category = 'R' where made - ev > 21600 or coalesce(newest, 0) > ev"""
)
def q_freshness(spark, sf_dir):
    """SEC-04: artifacts older than an input, evidence far older than its artifact or than its inputs."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    day = lambda c: F.datediff(c, F.lit("1970-01-01")).cast("long")
    at = (day("o_orderdate") + 60) * DAY
    artifacts = o.select(F.col("o_orderkey").alias("side"), at.alias("modified"))
    evidence = o.select(F.col("o_orderkey").alias("side"), F.lit("mapping").alias("role"), F.lit("R").alias("category"), (at - F.col("o_custkey") % 2 * DAY - F.col("o_orderkey") % 9 * 3600).alias("modified"))
    inputs = li.select(F.col("l_orderkey").alias("side"), F.col("l_returnflag").alias("category"), (day("l_shipdate") * DAY).alias("modified"))
    return registry.stale(artifacts, inputs, evidence)


@query(
    """with a as (select event_type, user_id % 10 as bucket from events where event_id % 2 = 0), b as (select event_type, user_id % 10 as bucket from events where event_id % 2 = 1)
    select 'added' as change, event_type, bucket, count(*) as n from (select * from a except all select * from b) group by all union all select 'missing', event_type, bucket, count(*) from (select * from b except all select * from a) group by all"""
)
def q_state_difference(spark, sf_dir):
    """SET-06, SRC-19: what two states of evidence have that the other lacks."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.pmod("user_id", F.lit(10)).alias("bucket"))
    now, locked = (e.where(F.pmod("event_id", F.lit(2)) == k).drop("event_id") for k in (0, 1))
    return registry.state_differences(now, locked).groupBy("change", "event_type", "bucket").agg(F.count("*").alias("n"))


@query(r"with d as (select doc_id, string_split(text, chr(10)) as s, list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'the')), true) as p from documents) select doc_id, p::int as line, array_to_string(s[greatest(p - 12, 1) : p + 39], chr(10)) as snippet from d where p > 0")
def q_source_window(spark, sf_dir):
    """SNK-05, WIN-07: from 12 lines before the first line with the word to 39 after it."""
    d = table(spark, sf_dir, "documents").select("doc_id", C.snippet(F.col("text"), F.lit("the")).alias("x"))
    return d.where("x is not null").select("doc_id", "x.line", "x.snippet")


@query(
    """with m as (select o_orderstatus as metric, nullif(count(*) filter (where year(o_orderdate) % 2 = 0), 0)::varchar as l, nullif(count(*) filter (where year(o_orderdate) % 2 = 1), 0)::varchar as r from orders group by all)
    select metric, l as "left", r as "right" from m where l is distinct from r"""
)
def q_difference_report(spark, sf_dir):
    """SNK-12: metrics that differ between two sides, the orders of even and of odd years."""
    o = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate") % 2)
    of = lambda y: o.where(F.col("y") == y).groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("string").alias("value"))
    return report.metric_differences(of(0), of(1))
