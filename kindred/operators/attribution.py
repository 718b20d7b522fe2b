"""Whose a row is: prefix rules, and joins with provenance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred import config
from kindred.functions import columns as C


def prefix_join(rows: DataFrame, column: str, prefixes: DataFrame, name: str = "prefix") -> DataFrame:
    """Rows with any of the prefixes (left semi).  Each row offers its own prefixes of the lengths in use: an equi-join."""
    lengths = [r[0] for r in prefixes.select(F.length(name)).distinct().collect()]  # distinct lengths: at most the longest prefix
    if not lengths:
        return rows.where("false")
    keys = F.array_distinct(F.array(*[F.left(F.col(column), F.lit(n)) for n in sorted(lengths)]))
    flat = rows.select(column).distinct().select(column, F.explode(keys).alias(name))
    hit = flat.join(prefixes.select(name).distinct(), name, "left_semi").select(column).distinct()
    return rows.join(hit, column, "left_semi")


def classify_methods(methods: DataFrame, dependencies: DataFrame) -> DataFrame:
    """third_party also for classes of the bundle's dependencies (column `dependency`) and for generated classes."""
    prefixes = dependencies.select(C.dependency_prefix(F.col("dependency")).alias("prefix")).where("prefix is not null")
    hit = prefix_join(methods, "class_name", prefixes).select("class_name").distinct().withColumn("_hit", F.lit(True))
    out = methods.join(hit, "class_name", "left")
    return out.withColumn("third_party", F.col("third_party") | F.coalesce("_hit", F.lit(False)) | F.col("class_name").rlike(config.GENERATED_CLASS)).drop("_hit").select(*methods.columns)


def implicit_dependencies(methods: DataFrame, prefixes) -> DataFrame:
    """Dotted names of the third-party prefixes that any method has."""
    spark = methods.sparkSession
    p = spark.createDataFrame([(x,) for x in prefixes], "prefix string")
    lengths = sorted({len(x) for x in prefixes})
    own = methods.select("class_name").distinct().select(F.explode(F.array(*[F.left("class_name", F.lit(n)) for n in lengths])).alias("prefix")).distinct()
    return p.join(own, "prefix", "left_semi").select(F.replace(F.regexp_replace("prefix", "^L|/$", ""), F.lit("/"), F.lit(".")).alias("dependency"))


def unique_owner(candidates: DataFrame, key: str) -> DataFrame:
    """Per key its owner, if all candidates are one (origin, source_path, module)."""
    one = F.struct("origin", "source_path", "module")
    return candidates.groupBy(key).agg(F.min(one).alias("lo"), F.max(one).alias("hi")).where("lo <=> hi").select(key, "lo.origin", "lo.source_path", "lo.module")


def source_owner(descriptors: DataFrame, owners: DataFrame) -> DataFrame:
    """(descriptor, origin, source_path, module): the class itself, else the classes it is nested in.

    A class with an ambiguous owner has none, even where an outer class would give one.
    """
    own = owners.where("category = 'code'").select("identifier", "origin", "source_path", "module")
    direct = descriptors.distinct().join(own.withColumnRenamed("identifier", "descriptor"), "descriptor")
    rest = descriptors.distinct().join(own.select(F.col("identifier").alias("descriptor")), "descriptor", "left_anti")
    # every outer class of La/B$C$D; : a prefix before a $, as an equi-join key
    outer = F.transform(F.filter(F.sequence(F.lit(2), F.length("descriptor")), lambda i: F.substr(F.col("descriptor"), i, F.lit(1)) == "$"), lambda i: F.concat(F.substr(F.col("descriptor"), F.lit(1), i - 1), F.lit(";")))
    nested = rest.select("descriptor", F.explode(outer).alias("identifier")).join(own, "identifier").drop("identifier")
    return unique_owner(direct.unionByName(nested.select(*direct.columns)), "descriptor")


def attribute_methods(methods: DataFrame, mapping: DataFrame, owners: DataFrame) -> DataFrame:
    """(ord, origin, source_path): kept if every original class of its class resolves, all to one owner.  mapping: output, original."""
    found = source_owner(mapping.select(F.col("original").alias("descriptor")), owners)
    joined = mapping.join(found.withColumnRenamed("descriptor", "original"), "original", "left")
    one = F.struct("origin", "source_path", "module")
    per = joined.groupBy("output").agg(F.count("*").alias("n"), F.count("origin").alias("m"), F.min(one).alias("lo"), F.max(one).alias("hi"))
    per = per.select(F.col("output").alias("class_name"), F.when((F.col("n") == F.col("m")) & F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).alias("owner"))
    return methods.select("ord", "class_name").join(per, "class_name", "left").select("ord", F.coalesce("owner.origin", F.lit("UNRESOLVED")).alias("origin"), "owner.source_path")


def last_writer(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Per key the row with the largest seq."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("x")).select(*keys, *[f"x.{c}" for c in rest])


def local_override(rows: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Rows from a dependency take the local owner of their key, if there is one.  owner columns: origin, source_path, category."""
    cols = ["origin", "source_path", "category"]
    other = local.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    out = rows.join(other, keys, "left")
    use = F.col("from_dependency") & F.coalesce("_hit", F.lit(False))
    return out.withColumns({c: F.when(use, F.col(f"_{c}")).otherwise(F.col(c)) for c in cols}).select(*rows.columns)


def file_keys(path: F.Column) -> F.Column:
    """struct<kind, type, qualifiers, name> of an archive path; null outside assets and res."""
    s = F.split(path, "/")
    folder = F.get(s, F.lit(2))
    asset = F.struct(F.lit("asset").alias("kind"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("qualifiers"), F.array_join(F.slice(s, F.lit(3), F.greatest(F.size(s) - 2, F.lit(1))), "/").alias("name"))
    kind = F.when(C.suffix(path).isin(*config.IMAGE_SUFFIXES), "image").otherwise("resource")
    rest = F.regexp_extract(folder, "^[^-]*-(.*)$", 1)
    resource = F.struct(kind.alias("kind"), F.split_part(folder, F.lit("-"), F.lit(1)).alias("type"), rest.alias("qualifiers"), C.base_name(path).alias("name"))
    return F.when((F.size(s) >= 3) & (F.get(s, F.lit(1)) == "assets"), asset).when((F.size(s) >= 4) & (F.get(s, F.lit(1)) == "res"), resource)


def attribute_files(files: DataFrame, resources: DataFrame, assets: DataFrame) -> DataFrame:
    """(ord, origin, source_path): resources (type, qualifiers, name, seq, origin, source_path) by key, the last written wins;
    assets (name, sha256, origin, source_path, module) by name and content, if unique."""
    keyed = files.select("ord", "path", "sha256", file_keys(F.col("path")).alias("k")).select("ord", "sha256", "k.*")
    last = last_writer(resources.select("type", "qualifiers", "name", "seq", "origin", "source_path"), ["type", "qualifiers", "name"], "seq").drop("seq")
    by_key = keyed.where("kind <> 'asset'").join(last, ["type", "qualifiers", "name"]).select("ord", "origin", "source_path")
    met = keyed.where("kind = 'asset'").join(assets, ["name", "sha256"]).select("ord", "origin", "source_path", "module")
    by_content = unique_owner(met, "ord").select("ord", "origin", "source_path")
    found = by_key.unionByName(by_content)
    return files.select("ord").join(found, "ord", "left").select("ord", F.coalesce("origin", F.lit("UNRESOLVED")).alias("origin"), "source_path")


def value_owners(resources: DataFrame) -> DataFrame:
    """Of the resources that a values file backs the last writer of each (type, qualifiers, name)."""
    backed = F.exists(F.split("source_path", "/"), lambda x: (x == "values") | x.startswith("values-"))
    return last_writer(resources.where(backed & (F.col("category") == "resource")), ["type", "qualifiers", "name"], "seq")


def expected_inventory(expected: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every expected (type, qualifiers, name) with the value found, or the label of what is missing."""
    keys = ["type", "qualifiers", "name"]
    out = expected.join(inventory.select(*keys, "value"), keys, "left")
    label = F.concat(F.col("type"), F.when(F.col("qualifiers") != "", F.concat(F.lit("-"), F.col("qualifiers"))).otherwise(""), F.lit(":"), F.col("name"))
    return out.withColumn("unverified", F.when(F.col("value").isNull(), label))


def path_origin(path: F.Column, from_dependency: F.Column, *, generated_roots, source_roots, selected_modules, project_root: str) -> F.Column:
    under = lambda roots: C.starts_with_any(path, [r.rstrip("/") + "/" for r in roots])
    packaged = under([f"{m.rstrip('/')}/build/intermediates/packaged_res" for m in selected_modules])
    inside = under([project_root])
    return (
        F.when(under(generated_roots), "OWNED_GENERATED")
        .when(under(source_roots), "OWNED_SOURCE")
        .when(from_dependency & packaged, "UNRESOLVED")
        .when(from_dependency | path.contains(".gradle/caches"), "PUBLIC_DEPENDENCY")
        .when(inside & path.contains("/build/generated/"), "TOOL_GENERATED")
        .otherwise("UNRESOLVED")
    )


def manifest_entries(details: DataFrame, public_prefixes) -> tuple[DataFrame, DataFrame]:
    """Owned entries (value, origin, source_path, in order) and public ones, of details (module, components
    array<struct<tag,name>>, actions, permissions)."""
    c = details.select("module", F.lit(0).alias("kind"), F.explode("components").alias("x")).select("module", "kind", F.col("x.tag").alias("tag"), F.col("x.name").alias("name"))
    flat = lambda column, kind, tag: details.select("module", F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), F.explode(column).alias("name")).where(~F.col("name").startswith("android."))
    every = c.unionByName(flat("actions", 1, "action")).unionByName(flat("permissions", 2, "permission"))
    every = every.withColumn("public", C.public_dotted(F.col("name"), public_prefixes))
    value = F.concat("tag", F.lit(":name="), "name")
    owned = every.where("not public").select("kind", value.alias("value"), F.lit("HEURISTIC_OWNED").alias("origin"), F.concat(F.lit("aab://"), "module", F.lit("/manifest/AndroidManifest.xml")).alias("source_path"))
    return owned.orderBy("kind", "value").drop("kind"), every.where("public").select(value.alias("value"))


def first_existing(candidates: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the first row by order that exists."""
    w = Window.partitionBy(key).orderBy(order)
    return candidates.where("existing").withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def latest_by_category(inputs: DataFrame) -> DataFrame:
    """Latest modification by category and over all (category null)."""
    return inputs.groupingSets([[F.col("category")], []], F.col("category")).agg(F.max("modified").alias("modified"))
