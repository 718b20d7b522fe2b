"""A store of fingerprints: what was read of archives, kept by content and settings.

One table each for entries, files, methods and so on, partitioned by a key of an archive's SHA-256, the settings and the
version.  Archives come in batches, from a folder or from the inbox stream: those whose key the store has are not read again; of the others
all tables are written by dynamic partition overwrite, the list of keys last.  So a batch that comes twice changes nothing, and
one that broke off is written again over what it left.
"""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kindred.config import Config
from kindred.functions import columns as C
from kindred.sources import files
from kindred.storage import materialise

#: Changes whenever the meaning of a table does.
VERSION = "4"
DONE = "sha256 string, problem string, schemas string, key string"


def keys(spark: SparkSession, path: str, config: Config) -> DataFrame:
    """(archive, sha256, key) of the archives under path, each hashed by a task in a stream."""
    text = lambda x: F.lit(json.dumps(x, sort_keys=True, ensure_ascii=False))
    key = C.cache_key(F.col("sha256"), text(asdict(config)), F.lit(VERSION), text({}))
    return files.digests(spark, path).select(F.col("path").alias("archive"), "sha256", key.alias("key"))


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table of the store; without rows where nothing was written, or nothing that can be read."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def done(spark: SparkSession, store: str) -> DataFrame:
    """What the store holds whole, with the schemas of its tables."""
    return _read(spark, f"{store}/done", DONE).where("sha256 is not null and schemas is not null")


def _put(df: DataFrame, store: str, name: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("key").parquet(f"{store}/{name}")


def fill(spark: SparkSession, path: str, config: Config, store: str) -> DataFrame:
    """keys() of path, after all of them are in the store."""
    from kindred.plans import compare

    found = materialise(keys(spark, path, config), "keys")
    fresh = found.join(done(spark, store), "key", "left_anti").groupBy("key", "sha256").agg(F.min("archive").alias("archive"))
    fresh = materialise(fresh, "fresh")  # equal archives are read once
    wanted = {r.archive for r in fresh.select("archive").collect()}  # of those that the driver lists anyway
    if wanted:
        skip = [a for a, _ in files.listed(path) if a not in wanted]
        tables = compare.fingerprints(spark, path, config, skip)
        named = fresh.select("archive", "key")
        schemas = {}
        for name in compare.TABLES:
            rows = tables[name].join(named, "archive")
            schemas[name] = rows.schema.jsonValue()
            _put(rows, store, name)
        last = fresh.join(tables["problems"], "archive", "left").select("sha256", "problem", F.lit(json.dumps(schemas)).alias("schemas"), "key")
        _put(last, store, "done")
    return found


def profile(spark: SparkSession, path: str, config: Config, store: str):
    """The profile of one archive, read now if the store has not got it."""
    from kindred.plans import compare

    row = fill(spark, path, config, store).first()
    held = done(spark, store).where(F.col("key") == row.key).first()
    if held.problem:
        raise ValueError(f"{row.archive}: {held.problem}")
    schemas = {name: StructType.fromJson(x) for name, x in json.loads(held.schemas).items()}
    tables = {name: _read(spark, f"{store}/{name}", schemas[name]).where(F.col("key") == row.key).drop("key") for name in compare.TABLES}
    return compare.assemble(spark, tables, path, row.sha256, config)
