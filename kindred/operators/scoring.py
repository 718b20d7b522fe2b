"""Scores of dimensions, and their weighted total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.config import Config


def round2(x: Column) -> Column:
    """To two decimals, the same in every engine."""
    return F.floor(x * 100 + 0.5) / 100


def mass(pairs: DataFrame, left: DataFrame, right: DataFrame, weight: str, sim: str = "sim") -> DataFrame:
    """One row: matched mass, the masses and numbers of both sides; pairs has l_<weight>, r_<weight> and sim."""
    m = pairs.agg(F.coalesce(F.sum(F.least(f"l_{weight}", f"r_{weight}") * F.col(sim)), F.lit(0.0)).alias("matched"), F.count("*").alias("n_matched"))
    of = lambda df, p: df.agg(F.coalesce(F.sum(weight), F.lit(0)).cast("double").alias(f"{p}_mass"), F.count("*").alias(f"{p}_n"))
    return m.crossJoin(of(left, "l")).crossJoin(of(right, "r"))  # three one-row tables


#: What an empty side means: (both empty: score, coverage; coverage of a side without mass; missing if both or one is empty).
POLICIES = {
    "methods": {"both": (None, 0.0), "empty_side": 0.0, "one_empty_zero": True},
    "files": {"both": (100.0, 1.0), "empty_side": 1.0, "one_empty_zero": False},
    "owned": {"both": (None, 0.0), "empty_side": 0.0, "one_empty_null": True},
}


def finalize(row: DataFrame, policy: str) -> DataFrame:
    """A one-row mass table with score (unrounded, at most 100), left_coverage, right_coverage and confidence."""
    p = POLICIES[policy]
    both_empty = (F.col("l_n") == 0) & (F.col("r_n") == 0)
    one_empty = (F.col("l_n") == 0) | (F.col("r_n") == 0)
    total = F.col("l_mass") + F.col("r_mass")
    score = F.when(total > 0, F.least(F.col("matched") * 200 / total, F.lit(100.0))).otherwise(0.0)
    cover = lambda s: F.when(F.col(f"{s}_mass") > 0, F.least(F.col("matched") / F.col(f"{s}_mass"), F.lit(1.0))).otherwise(p["empty_side"])
    score = F.when(both_empty, F.lit(p["both"][0]).cast("double")).otherwise(score)
    left, right = (F.when(both_empty, p["both"][1]).otherwise(cover(s)) for s in "lr")
    if p.get("one_empty_zero"):
        left, right = (F.when(one_empty, 0.0).otherwise(x) for x in (left, right))
    confidence = F.lit(1.0)
    if p.get("one_empty_null"):
        score, left, right = F.when(~one_empty, score), F.when(one_empty, 0.0).otherwise(left), F.when(one_empty, 0.0).otherwise(right)
        confidence = F.when(one_empty, 0.0).otherwise(1.0)
    return row.select("*", score.alias("score"), left.alias("left_coverage"), right.alias("right_coverage"), confidence.alias("confidence"))


def set_score(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dice score and coverages of the distinct values of two one-column tables; an empty side's coverage is 1."""
    a, b = left.toDF("value").distinct().withColumn("in_l", F.lit(1)), right.toDF("value").distinct().withColumn("in_r", F.lit(1))
    both = a.join(b, "value", "full_outer")
    row = both.agg(F.count("in_l").alias("l_n"), F.count("in_r").alias("r_n"), F.count(F.col("in_l") + F.col("in_r")).alias("n_matched"))
    total = F.col("l_n") + F.col("r_n")
    cover = lambda s: F.when(F.col(f"{s}_n") == 0, 1.0).otherwise(F.col("n_matched") / F.col(f"{s}_n"))
    return row.select("*", F.when(total == 0, 100.0).otherwise(F.col("n_matched") * 200 / total).alias("score"), cover("l").alias("left_coverage"), cover("r").alias("right_coverage"))


def multiset_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(value, occurrences, left and right source paths) of the multiset intersection; tables: value, source_path."""
    of = lambda df, p: df.groupBy("value").agg(F.count("*").alias(f"{p}_n"), F.array_sort(F.collect_set("source_path")).alias(f"{p}_paths"))
    return of(left, "l").join(of(right, "r"), "value").select("value", F.least("l_n", "r_n").alias("occurrences"), F.col("l_paths").alias("left_source_paths"), F.col("r_paths").alias("right_source_paths"))


def multiset_score(left: DataFrame, right: DataFrame) -> DataFrame:
    m = multiset_matches(left, right).agg(F.coalesce(F.sum("occurrences"), F.lit(0)).cast("double").alias("matched"), F.count("*").alias("n_matched"))
    of = lambda df, p: df.agg(F.count("*").cast("double").alias(f"{p}_mass"), F.count("*").alias(f"{p}_n"))
    return finalize(m.crossJoin(of(left, "l")).crossJoin(of(right, "r")), "owned")


def aggregate(dimensions: DataFrame, config: Config = Config()) -> DataFrame:
    """Weighted total of (key, score): score is null if a dimension is missing, then minimum and maximum still hold."""
    spark = dimensions.sparkSession
    weights = spark.createDataFrame(list(config.weights.items()), "key string, weight int")
    levels = spark.createDataFrame(list(config.levels.items()), "level string, threshold int")
    d = weights.join(dimensions.select("key", "score"), "key", "left")
    known = F.col("score").isNotNull()
    row = d.agg(F.coalesce(F.sum(F.when(known, F.col("weight") * F.col("score") / 100)), F.lit(0.0)).alias("minimum"), F.coalesce(F.sum(F.when(known, F.col("weight"))), F.lit(0)).alias("analyzed_weight"), F.coalesce(F.sum(F.when(~known, F.col("weight"))), F.lit(0)).alias("missing"))
    row = row.select(round2(F.col("minimum")).alias("minimum"), round2(round2(F.col("minimum")) + F.col("missing")).alias("maximum"), "analyzed_weight", F.when(F.col("missing") == 0, round2(F.col("minimum"))).alias("score"))
    best = row.crossJoin(levels).groupBy("minimum", "maximum", "analyzed_weight", "score").agg(F.max_by("level", F.struct(F.col("threshold") <= F.col("score"), "threshold")).alias("level"))
    return best.select("score", "minimum", "maximum", "analyzed_weight", F.when(F.col("score").isNotNull(), F.col("level")).alias("level"))


def attribution_summary(rows: DataFrame, kinds) -> DataFrame:
    """One row: how many of each origin, zero where none; a null origin is unresolved."""
    return rows.agg(*[F.count_if(F.coalesce("origin", F.lit("UNRESOLVED")) == k).alias(k.lower()) for k in kinds])


def origin_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("origin", F.lit("UNRESOLVED")).alias("origin")).agg(F.count("*").alias("n"))


def source_counts(rows: DataFrame) -> DataFrame:
    """How many rows each source file has; rows without one do not count."""
    return rows.where("source_path is not null").groupBy("source_path").agg(F.count("*").alias("n"))


def method_counts(methods: DataFrame, config: Config = Config()) -> DataFrame:
    """One row: methods, those that are no third party's, and the long ones of these."""
    own = ~F.col("third_party")
    return methods.agg(F.count("*").alias("candidate_methods"), F.count_if(own).alias("methods"), F.count_if(own & (F.col("instruction_count") >= config.long_method_min_instructions)).alias("long_methods"))


def resource_confidence(expected: Column, covered: Column) -> Column:
    return F.when(expected <= 0, 1.0).otherwise(F.least(F.greatest(covered / expected, F.lit(0.0)), F.lit(1.0)))
