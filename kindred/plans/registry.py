"""Registry and lock state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_key(left: F.Column, right: F.Column) -> F.Column:
    """Of an ordered pair of paths."""
    return F.sha2(F.concat(left, F.lit("\0"), right).cast("binary"), 256)


#: The ladder of a pair's status: the first of these that applies.
SAID = {"missing": "the pair is not registered", "invalid": "the record cannot be used for this pair", "stale": "what the record names has changed or gone", "matched": "the pair is registered"}


def status(recorded: bool, valid: bool, holds: bool) -> str:
    return next(name for name, applies in zip(SAID, (not recorded, not valid, not holds, True), strict=True) if applies)


def pair_status(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with status(): whether there is a record, is valid, and holds the contents of both sides."""
    keyed = records.select(pair_key(F.col("left_path"), F.col("right_path")).alias("_key"), F.col("left_sha").alias("_l"), F.col("right_sha").alias("_r"))
    out = pairs.withColumn("_key", pair_key(F.col("left_path"), F.col("right_path"))).join(keyed, "_key", "left")
    facts = (F.col("_l").isNotNull(), F.col("valid"), (F.lower("_l") == F.lower("left_sha")) & (F.lower("_r") == F.lower("right_sha")))
    ladder = F.coalesce(*[F.when(~fact, F.lit(name)) for name, fact in zip(SAID, facts, strict=False)], F.lit("matched"))
    return out.withColumn("status", ladder).drop("_key", "_l", "_r")


def state_differences(now: DataFrame, locked: DataFrame) -> DataFrame:
    """(change, role, path, sha256) between two states of evidence; none if the lock holds.  Order counts where it is a column."""
    cols = now.columns
    gone, new = locked.select(*cols).exceptAll(now), now.exceptAll(locked.select(*cols))
    return gone.withColumn("change", F.lit("missing")).unionByName(new.withColumn("change", F.lit("added")))


def stale(artifacts: DataFrame, inputs: DataFrame, evidence: DataFrame, *, gap_seconds: int = 6 * 3600) -> DataFrame:
    """(side, problem): an input newer than the artifact; evidence far older than it or older than its inputs.

    artifacts: side, modified; inputs: side, category, modified; evidence: side, role, category, modified (seconds).
    """
    newest = inputs.groupBy("side").agg(F.max("modified").alias("newest"))
    a = artifacts.join(newest, "side").where("newest > modified").select("side", F.lit("artifact is older than its inputs").alias("problem"))
    by = inputs.groupBy("side", "category").agg(F.max("modified").alias("newest"))
    e = evidence.withColumnRenamed("modified", "at").join(artifacts, "side").join(by, ["side", "category"], "left")
    old = (F.col("modified") - F.col("at") > gap_seconds) | (F.coalesce("newest", F.lit(0)) > F.col("at"))
    return a.unionByName(e.where(old).select("side", F.concat("role", F.lit(" is stale")).alias("problem")))
