"""Source trees as ownership tables: which classes, resources, assets and manifests a build consumes."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred import config
from kindred.functions import columns as C
from kindred.sources import manifests, parsers

# --- fixed values ---
RESOURCE_FOLDERS = ("anim", "animator", "color", "drawable", "font", "interpolator", "layout", "menu", "mipmap", "navigation", "raw", "transition", "values", "xml")
TEST_SETS = ("test", "androidtest", "testfixtures")
# --- end of the fixed values ---


def source_sets(variant: str) -> list[str]:
    """Names, in lower case, of the source sets that a variant consumes."""
    flavor = re.sub("(Release|Debug)$", "", variant)
    return sorted({"main", "release", variant.lower(), flavor.lower()} - set(TEST_SETS))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified, content) of every file under root; path is relative to it."""
    base = root.rstrip("/")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = re.sub(r"^\w+:/*", "/", base)
    return found.select(F.regexp_replace("path", f"^.*?{re.escape(plain)}/", "").alias("path"), F.unix_seconds("modificationTime").alias("modified"), "content")


def consumed(files: DataFrame, variant: str, *, source_roots: list[str], generated_roots: list[str] = ()) -> DataFrame:
    """The files that a build of the variant consumes, with their origin and category.

    files: path relative to the project, modified, content.  A source root holds source sets, one a folder.
    """
    path = F.col("path")
    under = lambda roots: C.starts_with_any(path, [r.rstrip("/") + "/" for r in roots])
    active = F.lit(False)
    for r in source_roots:
        depth = r.rstrip("/").count("/") + 2
        active = active | (path.startswith(r.rstrip("/") + "/") & F.lower(F.split_part(path, F.lit("/"), F.lit(depth))).isin(source_sets(variant)))
    origin = F.when(under(list(generated_roots)), "OWNED_GENERATED").when(active, "OWNED_SOURCE")
    at, folders = _places(path)
    code = C.suffix(path).isin(".java", ".kt")
    image = C.suffix(path).isin(*config.IMAGE_SUFFIXES)
    name = F.element_at(F.split(path, "/"), -1)
    kind = F.when(code, "code").when(name == "AndroidManifest.xml", "manifest").when((at > 0) & (at < F.size(F.split(path, "/"))), "asset").when(F.size(folders) > 0, F.when(image, "image").otherwise("resource"))
    return files.select("path", "modified", "content", origin.alias("origin"), kind.alias("category")).where("origin is not null and category is not null")


def _places(path: F.Column) -> tuple[F.Column, F.Column]:
    """Where the assets folder is among a path's parts, and its resource folders."""
    s = F.split(path, "/")
    return F.array_position(s, "assets"), F.filter(F.slice(s, 1, F.size(s) - 1), lambda x: F.split_part(x, F.lit("-"), F.lit(1)).isin(*RESOURCE_FOLDERS))


def owners(files: DataFrame, variant: str, *, source_roots: list[str], generated_roots: list[str] = ()) -> DataFrame:
    """(identifier, category, origin, source_path, module, sha256, modified) of what is consumed, in canonical order."""
    rows = consumed(files, variant, source_roots=source_roots, generated_roots=generated_roots)
    path = F.col("path")
    s, base = F.split(path, "/"), C.base_name(path)
    at, folders = _places(path)
    text = C.text(F.col("content"))
    names = (
        F.when(F.col("category") == "manifest", F.array(F.concat(F.lit("manifest:"), path)))
        .when(F.col("category") == "asset", F.array(F.concat(F.lit("asset:"), F.array_join(F.slice(s, at + 1, F.size(s)), "/"))))
        .otherwise(F.array(F.concat(F.element_at(folders, -1), F.lit(":"), base)))
    )
    other = rows.where("category <> 'code'").select("*", F.explode(names).alias("identifier"))
    classes = rows.where("category = 'code'").select("*", F.explode(parsers.declared_classes_udf("path", text)).alias("identifier"))
    every = other.unionByName(classes)
    module = F.concat(F.lit(":"), F.split_part("path", F.lit("/"), F.lit(1)))
    return every.select("identifier", "category", "origin", F.col("path").alias("source_path"), module.alias("module"), F.sha2("content", 256).alias("sha256"), "modified").orderBy("category", "identifier", "source_path")


def manifest_entries(files: DataFrame, owned: DataFrame) -> DataFrame:
    """(value, origin, source_path) of every element of owned manifests but the outer two; broken files give none."""
    mine = owned.where("category = 'manifest'").select("source_path", "origin").distinct()
    return files.withColumnRenamed("path", "source_path").join(mine, "source_path").select(F.explode(manifests.owned_values(manifests.elements_udf("content"))).alias("value"), "origin", "source_path")
