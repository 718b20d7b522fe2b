"""Comparing two archives: profiles, dimensions, total, findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.config import ORIGINS, Config
from kindred.functions import columns as C
from kindred.operators import attribution as A
from kindred.operators import matching as M
from kindred.operators import scoring as S
from kindred.plans import report, store
from kindred.sources import archive, dex, files, images, manifests, parsers, resources
from kindred.storage import materialise


@dataclass
class Profile:
    """The tables of one side."""

    header: dict
    files: DataFrame
    methods: DataFrame
    images: DataFrame
    manifest: DataFrame  # module, value
    details: DataFrame  # module and manifest details of text manifests
    dependencies: DataFrame
    build: DataFrame
    warnings: list = field(default_factory=list)
    confidence: dict = field(default_factory=dict)
    attribution: dict | None = None
    inventory: DataFrame | None = None  # type, qualifiers, name, value of the archive's own resource table


def ordered(df: DataFrame, *by: str) -> DataFrame:
    """df with ord, its place in canonical order.  One side of one comparison: its rows are sorted once, in ranges."""
    ranged = df.orderBy(*by).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    ranged = materialise(ranged, "ordered")
    base = ranged.groupBy("_p").agg(F.min("_i").alias("_low"), F.count("*").alias("_n"))
    before = base.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a partition
    return ranged.join(F.broadcast(before.select("_p", "_low", "_base")), "_p").withColumn("ord", F.col("_i") - F.col("_low") + F.col("_base")).drop("_p", "_i", "_low", "_base")


#: A report names so many files that cannot be read, code first.
MOST_WARNINGS = 1000

#: What is read of an archive, a table each with the column archive.
TABLES = ("entries", "files", "methods", "images", "manifest", "details", "listed", "build", "resources", "warnings")


def fingerprints(spark: SparkSession, path: str, config: Config = Config(), skip: list[str] = ()) -> dict[str, DataFrame]:
    """The TABLES of all safe archives under path but those to skip, and `problems` (archive, problem) of the others.

    Every archive is read in many tasks, and many archives in the same jobs.
    """
    entries = materialise(archive.scan(spark, path, config.archive_limits, content=False, skip=skip), "entries")
    problems = archive.check(entries, config.archive_limits)
    based = archive.inventory(entries).where(F.array_contains("modules", "base")).select("archive")
    none = entries.select("archive").distinct().join(based, "archive", "left_anti").join(problems.select("archive"), "archive", "left_anti")
    problems = materialise(problems.unionByName(none.withColumn("problem", F.lit("the archive holds no manifest of a base module"))), "problems")
    unsafe = [r.archive for r in problems.select("archive").collect()]  # of those that the driver lists anyway
    safe = entries.join(problems.select("archive"), "archive", "left_anti")
    contents = materialise(archive.scan(spark, path, config.archive_limits, content=True, skip=[*skip, *unsafe]).where("kind is not null").select("archive", "path", "content"), "contents")
    raw = materialise(dex.scan(safe), "methods")
    image = contents.where(C.category(F.col("path")) == "image").select("archive", "path", "content", images.image_udf("content").alias("i"))
    xml = contents.where(F.col("path").endswith("/manifest/AndroidManifest.xml")).select("archive", F.split_part("path", F.lit("/"), F.lit(1)).alias("module"), "content")
    one = contents.where(F.col("path").endswith("dependencies.pb")).select(F.struct("archive", "path").alias("k"), "content")
    built = contents.where(C.category(F.col("path")) == "build")
    values = materialise(resources.raw_values(contents), "values")
    held, covered = resources.inventory(values)
    features = [
        safe.where("kind = 'dex'").select("archive", F.concat_ws(":", F.lit("dex-size"), "path", "size").alias("value")),
        built.select("archive", F.concat(F.lit("entry:"), "path").alias("value")),
        built.where(F.lower("path").contains("hardening")).select("archive", F.explode(parsers.hardening_features(F.col("content"))).alias("value")),
        built.where(F.col("path").endswith("app-metadata.properties")).groupBy("archive").agg(F.max(parsers.agp_version(F.col("content"))).alias("agp")).where("agp is not null").select("archive", F.concat(F.lit("agp:"), "agp").alias("value")),
    ]
    return {
        "entries": safe,
        "files": archive.file_rows(contents, asset_semantic=config.asset_semantic),
        "methods": dex.method_rows(raw, config),
        "images": image.select("archive", "path", C.module(F.col("path")).alias("module"), F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), "i.*"),
        "manifest": xml.select("archive", "module", F.explode(C.manifest_markers(C.printable_tokens(F.col("content")))).alias("value")),
        "details": xml.withColumn("rows", manifests.elements_udf("content")).select("archive", "module", manifests.details(F.col("rows"), F.col("content")).alias("d")).select("archive", "module", "d.*"),
        "listed": parsers.dependency_coordinates(one, key="k").select("k.archive", "dependency"),
        "build": reduce(DataFrame.unionByName, features).distinct(),
        "resources": held,
        "warnings": raw.where("warning is not null").select("archive", "warning").unionByName(resources.coverage_warnings(covered)).distinct(),
        "problems": problems,
    }


def assemble(spark: SparkSession, t: dict[str, DataFrame], path: str, sha256: str, config: Config = Config()) -> Profile:
    """The profile of one archive from its rows of the TABLES."""
    counts = archive.inventory(t["entries"]).first()
    methods = t["methods"].drop("archive")
    dependencies = t["listed"].select("dependency").unionByName(A.implicit_dependencies(methods, config.third_party_prefixes)).distinct()
    dependencies = materialise(dependencies, "dependencies")
    methods = ordered(A.classify_methods(methods, dependencies), "identifier", "dex_path", "position")
    agp = t["build"].where("startswith(value, 'agp:')").select(F.max(F.substr("value", F.lit(5)))).first()[0]
    totals = {k: counts[k] for k in ("entries", "dex", "native", "assets", "resources", "manifests")}
    totals["dex_bytes"] = t["entries"].where("kind = 'dex'").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    totals |= S.method_counts(methods, config).first().asDict() | {"images": t["images"].count()}
    fixed = [f"module:{m}" for m in counts.modules] + [f"count:{k}:{totals[k]}" for k in ("dex", "native", "assets", "resources", "manifests")]
    build = t["build"].select("value").unionByName(spark.createDataFrame([(x,) for x in fixed], "value string")).distinct()
    warnings = sorted(r.warning for r in t["warnings"].select("warning").orderBy(~F.startswith("warning", F.lit(dex.UNREAD)), "warning").limit(MOST_WARNINGS).collect())
    header = {"path": path, "sha256": sha256, "modules": list(counts.modules), "agp": agp, "counts": totals}
    own = lambda name: t[name].drop("archive")
    held = own("resources") if t["entries"].where("kind = 'table'").limit(1).count() else None
    return Profile(header, ordered(own("files"), "path"), methods, ordered(own("images"), "path"), own("manifest"), own("details"), dependencies, build, warnings, inventory=held)


def profile(spark: SparkSession, path: str, config: Config = Config()) -> Profile:
    """Everything that the comparison needs of one archive; what breaks the safety rules is an error."""
    t = fingerprints(spark, path, config)
    bad = t["problems"].first()
    if bad:
        raise ValueError(f"{bad.archive}: {bad.problem}")
    return assemble(spark, t, path, files.digests(spark, path).first().sha256, config)


def cached_profile(spark: SparkSession, path: str, config: Config, cache: str | None) -> Profile:
    """profile(), through a store of fingerprints where one is named."""
    return profile(spark, path, config) if cache is None else store.profile(spark, path, config, cache)


def inferred_prefixes(details: DataFrame) -> DataFrame:
    """Class prefixes of the packages that manifests name: what is under them is the application's own."""
    return details.where("package is not null").select(F.concat(F.lit("L"), F.regexp_replace(F.replace("package", F.lit("."), F.lit("/")), "/+$", ""), F.lit("/")).alias("prefix")).distinct()


def heuristic(p: Profile, config: Config = Config()) -> Profile:
    """Only what seems the application's own, by the names of classes, files and manifest entries."""
    business = (*config.business_prefixes, *sorted(r.prefix for r in inferred_prefixes(p.details).collect()))  # a row a module
    listed = [r.p for r in p.dependencies.select(C.dependency_prefix(F.col("dependency")).alias("p")).where("p is not null").distinct().collect()]
    public = tuple(sorted({*config.third_party_prefixes, *listed}))
    methods = p.methods.withColumn("_x", C.method_origin(F.col("class_name"), F.col("third_party"), business, public)).select("*", "_x.origin", F.col("_x.confidence").alias("_c")).drop("_x")
    files = p.files.withColumn("origin", C.file_origin(F.col("path"), F.col("category")))
    entries, other = A.manifest_entries(p.details, public)
    kept = files.where("origin = 'HEURISTIC_OWNED'")
    counted = methods.select("origin").unionByName(files.select("origin")).unionByName(entries.select("origin")).unionByName(other.select(F.lit("PUBLIC_DEPENDENCY").alias("origin")))
    owned = methods.where("origin = 'HEURISTIC_OWNED'")
    images = p.images.join(kept.select("path"), "path", "left_semi")
    some = lambda df: df.limit(1).count() > 0
    code = owned.agg(F.coalesce(F.avg("_c"), F.lit(0.0))).first()[0]
    confidence = {"business_code": code, "long_methods": code, "images": 0.45 * some(images), "resources": 0.45 * some(kept.where("category = 'resource'")), "manifest": 0.6 * some(entries), "assets": 0.4 * some(kept.where("category = 'asset'"))}
    return Profile(p.header, ordered(kept.drop("ord"), "path"), ordered(owned.drop("ord", "_c").withColumn("third_party", F.lit(False)), "identifier", "dex_path", "position"), ordered(images.drop("ord"), "path"), entries, p.details, p.dependencies, p.build, p.warnings, confidence, S.attribution_summary(counted, ORIGINS).first().asDict())


def _pairs(matches: DataFrame, left: DataFrame, right: DataFrame, weight: str, title: str) -> DataFrame:
    a = left.select(F.col("ord").alias("l"), F.col(weight).alias(f"l_{weight}"), F.col(title).alias("left"))
    b = right.select(F.col("ord").alias("r"), F.col(weight).alias(f"r_{weight}"), F.col(title).alias("right"))
    return materialise(matches.join(a, "l").join(b, "r"), "pairs")


def top_findings(pairs: DataFrame, most: int, *order) -> DataFrame:
    """(rank, left, right, sim) of the first `most` pairs."""
    top = pairs.orderBy(*order).limit(most)
    return top.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "left", "right", "sim")  # of so few rows


def _dimension(key: str, pairs: DataFrame, left: DataFrame, right: DataFrame, weight: str, policy: str, config: Config, order) -> tuple[dict, list]:
    row = S.finalize(S.mass(pairs, left, right, weight), policy).first().asDict()
    renamed = pairs.agg(F.count_if(F.col("left") != F.col("right"))).first()[0]
    top = top_findings(pairs, config.max_findings_per_dimension, *order).orderBy("rank").collect()
    return row | {"key": key, "renamed_matches": renamed}, [(key, r["rank"], r.left, r.right, r.sim) for r in top]


def compare(left: Profile, right: Profile, config: Config = Config(), *, owned: bool = False, lsh: bool = True) -> dict:
    """mode, dimensions (a dict each), findings (dimension, rank, left, right, similarity) and, unless owned, the total."""
    policy = (lambda _: "owned") if owned else (lambda p: p)
    rows, findings, sides = [], [], {}

    def add(result, a, b):
        rows.append(result[0])
        findings.extend(result[1])
        sides[result[0]["key"]] = {"left": a, "right": b}

    mine = (lambda p: p.methods) if owned else (lambda p: p.methods.where("not third_party"))
    for key, least in (("business_code", config.min_method_instructions), ("long_methods", config.long_method_min_instructions)):
        a, b = (mine(p).where(F.col("instruction_count") >= least) for p in (left, right))
        matches = M.match_methods(a, b, similarity=config.min_method_similarity, lsh=lsh, posting_cap=config.posting_cap, candidate_cap=config.candidate_cap, threshold=config.lsh_threshold, permutations=config.minhash_permutations).drop("stage")
        pairs = _pairs(matches, a, b, "instruction_count", "identifier")
        add(_dimension(key, pairs, a, b, "instruction_count", policy("methods"), config, [F.desc(F.col("sim") * F.least("l_instruction_count", "r_instruction_count")), "left"]), a, b)
    groups = {"resources": ["resource"], "assets": ["asset"]} if owned else {"resources": ["resource"], "assets_native": ["asset", "native"]}
    for key, kinds in groups.items():
        a, b = (p.files.where(F.col("category").isin(kinds)) for p in (left, right))
        add(_dimension(key, _pairs(M.match_files(a, b), a, b, "size", "path"), a, b, "size", policy("files"), config, [F.desc(F.least("l_size", "r_size")), "l"]), a, b)
    pairs = _pairs(M.match_images(left.images, right.images, threshold=config.image_threshold), left.images, right.images, "size", "path")
    add(_dimension("images", pairs, left.images, right.images, "size", policy("files"), config, [F.desc("sim"), "l"]), left.images, right.images)
    if owned:
        row = S.multiset_score(left.manifest, right.manifest).first().asDict()
        common = S.multiset_matches(left.manifest, right.manifest).orderBy("value").limit(config.max_findings_per_dimension).collect()
        add((row | {"key": "manifest"}, [("manifest", k + 1, r.value, r.value, 1.0) for k, r in enumerate(common)]), left.manifest, right.manifest)
    else:
        value = lambda p: p.manifest.select(F.concat_ws(":", "module", "value").alias("value"))
        for key, a, b in (("manifest", value(left), value(right)), ("dependencies", left.dependencies.toDF("value"), right.dependencies.toDF("value")), ("build_structure", left.build, right.build)):
            common = a.intersect(b).orderBy("value").limit(config.max_findings_per_dimension).collect()
            add((S.set_score(a, b).first().asDict() | {"key": key}, [(key, k + 1, r.value, r.value, 1.0) for k, r in enumerate(common)]), a, b)
    for r in rows:
        given = [p.confidence[r["key"]] for p in (left, right) if r["key"] in p.confidence]
        r["confidence"] = min([r.get("confidence", 1.0), *given])
        r["score"] = None if r["score"] is None else round(r["score"], 2)
    out = {"mode": "owned" if owned else "legacy", "left": left.header, "right": right.header, "dimensions": {r["key"]: r for r in rows}, "findings": findings, "warnings": sorted({*left.warnings, *right.warnings}), "attribution": {"left": left.attribution, "right": right.attribution}, "aggregate": None}
    listed = {s: [r.value for r in p.build.orderBy("value").collect()] for s, p in (("left", left), ("right", right))}  # of one archive each
    out["diagnostics"] = diagnostics(out["left"], out["right"], listed)
    out["differences"] = report.difference_rows(left.files.sparkSession, out)
    if owned:
        for key, found in dimension_origins(sides).items():
            out["dimensions"][key]["origins"] = found
        out["origins"] = {s: origins(p) for s, p in (("left", left), ("right", right))}
        dependencies = {s: [r[0] for r in p.dependencies.orderBy("dependency").collect()] for s, p in (("left", left), ("right", right))}
        out["diagnostics"] |= {"dependencies": dependencies, "build_structure": listed, "native": {s: out[s]["counts"]["native"] for s in ("left", "right")}}
    else:
        spark = left.files.sparkSession
        table = spark.createDataFrame([(r["key"], r["score"]) for r in rows], "key string, score double")
        out["aggregate"] = S.aggregate(table, config).first().asDict()
        out["weights"] = dict(config.weights)
    return out


def incomplete(result: dict) -> bool:
    """Whether code of either side could not be read, so that there is no certain result."""
    return any(w.startswith(dex.UNREAD) for w in result["warnings"])


def diagnostics(left: dict, right: dict, build: dict) -> dict:
    """What no dimension scores, of either side: signatures, hardening, versions."""
    some = lambda test: {s: [v for v in build[s] if test(v)] for s in ("left", "right")}
    return {"signing": some(lambda v: "META-INF" in v), "hardening": some(lambda v: v.startswith("hardening:")), "agp": {"left": left["agp"], "right": right["agp"]}}


def dimension_origins(sides: dict[str, dict[str, DataFrame]]) -> dict:
    """How many rows of each origin the sides of every dimension have."""
    out, every = {}, None
    for key, pair in sides.items():
        out[key] = {side: {} for side in pair}
        for side, t in pair.items():
            origin = F.coalesce("origin", F.lit("UNRESOLVED")) if "origin" in t.columns else F.lit("UNRESOLVED")
            t = t.select(F.lit(key).alias("key"), F.lit(side).alias("side"), origin.alias("origin"))
            every = t if every is None else every.unionByName(t)
    for r in every.groupBy("key", "side", "origin").agg(F.count("*").alias("n")).collect():  # a row a key of these
        out[r.key][r.side][r.origin] = r.n
    return out


def origins(p: Profile, most: int = 50) -> dict:
    """How many methods, files and images have each origin, and the source files with most of them."""
    rows = None
    for kind in ("methods", "files", "images", "manifest"):
        t = getattr(p, kind)
        t = t.select(*[F.col(c) if c in t.columns else F.lit(None).cast("string").alias(c) for c in ("origin", "source_path")])
        rows = t if rows is None else rows.unionByName(t)
    top = S.source_counts(rows).orderBy(F.desc("n"), "source_path").limit(most).collect()
    return {"by_origin": {r.origin: r.n for r in S.origin_counts(rows).orderBy("origin").collect()}, "by_source": {r.source_path: r.n for r in top}}


def compare_archives(spark: SparkSession, left: str, right: str, config: Config = Config(), *, mode: str = "heuristic", lsh: bool = True, cache: str | None = None) -> dict:
    a, b = (cached_profile(spark, p, config, cache) for p in (left, right))
    if mode == "legacy":
        return compare(a, b, config, lsh=lsh)
    out = compare(heuristic(a, config), heuristic(b, config), config, owned=True, lsh=lsh)
    return out | {"strategy": "heuristic"}


def strict(p: Profile, owners: DataFrame, mapping: DataFrame, resources: DataFrame, manifest: DataFrame, inventory: DataFrame | None = None) -> Profile:
    """Only what provenance proves to be the application's own.

    owners: as sources.tree gives them; mapping: output and original classes; resources: type, qualifiers, name, seq, origin,
    source_path, category of merged resources; manifest: owned entries; inventory: the values that the archive holds
    (type, qualifiers, name, value), against which values-backed resources are held.
    """
    own = F.col("origin").isin("OWNED_SOURCE", "OWNED_GENERATED")
    by_class = A.attribute_methods(p.methods, mapping, owners.select("identifier", "category", "origin", "source_path", "module"))
    methods = p.methods.drop("origin", "source_path").join(by_class, "ord")
    assets = owners.where("category = 'asset'").select(F.regexp_replace("identifier", "^asset:", "").alias("name"), "sha256", "origin", "source_path", "module")
    files = p.files.join(A.attribute_files(p.files, resources, assets), "ord")
    counted = methods.select("origin").unionByName(files.select("origin")).unionByName(manifest.select("origin"))
    warnings, share = list(p.warnings), 1.0
    kept = files.where(own)
    inventory = p.inventory if inventory is None else inventory
    if inventory is not None:
        last = A.value_owners(resources).where(own)
        held = materialise(A.expected_inventory(last, inventory), "inventory")
        n, found = held.agg(F.count("*"), F.count("value")).first()
        share = found / n if n else 1.0
        folder = F.when(F.col("qualifiers") != "", F.concat_ws("-", "type", "qualifiers")).otherwise(F.col("type"))
        data = F.col("value").cast("binary")
        made = held.where("value is not null").select(F.concat(F.lit("verified-resources/"), folder, F.lit("/"), "name").alias("path"), F.lit("base").alias("module"), F.lit("resource").alias("category"), F.octet_length(data).cast("long").alias("size"), F.sha2(data, 256).alias("sha256"), F.sha2(data, 256).alias("semantic_hash"), F.array("value").alias("features"), "origin", "source_path")
        kept = kept.drop("ord").unionByName(made)
        counted = counted.unionByName(held.select(F.when(F.col("value").isNull(), "UNRESOLVED").otherwise(F.col("origin")).alias("origin")))
    images = p.images.join(files.where(own).select("path"), "path", "left_semi")
    return Profile(p.header, ordered(kept.drop("ord"), "path"), ordered(methods.where(own).drop("ord"), "identifier", "dex_path", "position"), ordered(images.drop("ord"), "path"), manifest, p.details, p.dependencies, p.build, warnings, {"resources": share}, S.attribution_summary(counted, ORIGINS).first().asDict())
