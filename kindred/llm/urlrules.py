"""URL rules by a sort-merge range join.

Every host is turned round label by label (`com.example.www.`), so a rule's host and all its subdomains are one interval
of keys: from the rule's key to the same key with its last byte raised.  Pages and rules are dealt to the same ranges of
sorted keys - a rule to every range that its interval meets - and each range is swept once in order: a rule is pushed
when the sweep reaches it and popped once the key leaves its interval, so the stack holds the active rules, nested inside
one another.  Those whose path starts the page's path fit; the longest wins.  Between two changes of the stack pages are
judged together, one active rule at a time.

Range bounds come from a bounded sample of keys (those with the smallest hash); every range is one task.  A hot host is cut
across ranges, since path, page_id and a hash of the url follow the host in the sort key.  Rules are never broadcast.

Cases: a null url, or one without `://`, has an empty host and path and fits no rule; rules that are equal count once, of
those with equal host and path `block` wins; of rules of equal length the longer host wins; a rule with a null or empty
host is ignored; repeated pages are judged each; empty tables are fine; more columns of pages are kept.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import lean, partitions, sampled

SAMPLE = 4000


def _lower(x: F.Column) -> F.Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def turned(host: F.Column) -> F.Column:
    """`www.example.com` to `com.example.www.`."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def host_and_path(pages: DataFrame) -> DataFrame:
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substr("url", at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    out = pages.withColumn("_rest", rest)
    out = out.withColumn("host", _lower(F.regexp_extract("_rest", r"^(?s)([^/?#]*)", 1)))
    return out.withColumn("path", F.regexp_extract("_rest", r"^(?s)[^/?#]*([^?#]*)", 1)).drop("_rest")


def judge(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", default: str = "allow") -> DataFrame:
    """pages (url and page_id) with host, path, rule and verdict; rules: host, path, verdict."""
    n = partitions(pages.sparkSession)
    base = pages.drop("host", "path", "rule", "verdict")
    number = F.coalesce(F.col(page_id).cast("string"), F.lit(""))
    found = host_and_path(base).withColumn("_key", turned(F.col("host")))
    # what a page is sorted by; a host and its subdomains lie between its key and that with its last character raised
    sort = F.concat("_key", F.lit("\0"), "path", F.lit("\0"), number, F.lit("\0"), F.hex(F.xxhash64("url")))
    sample = sampled(found.select(sort.alias("k"), F.struct(page_id, "url").alias("i")), "i", SAMPLE).select("k")
    keys = sorted(r.k for r in sample.collect())  # at most SAMPLE keys
    bounds = np.array(sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else [], object)

    @F.pandas_udf("int")
    def place(key):
        return pd.Series(np.searchsorted(bounds, key.to_numpy(object), "right").astype(np.int32))

    @F.pandas_udf("array<int>")
    def places(low):
        first = np.searchsorted(bounds, low.to_numpy(object), "right")
        last = np.searchsorted(bounds, np.array([x[:-1] + chr(ord(x[-1]) + 1) for x in low], object), "left")
        return pd.Series([list(range(a, b + 1)) for a, b in zip(first, last, strict=True)])

    own = rules.where("host is not null and host <> '' and path is not null").select(_lower(F.col("host")).alias("host"), "path", "verdict")
    own = own.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("_key", turned(F.col("host")))
    own = own.withColumn("_part", F.explode(places("_key")))
    rule = F.struct("host", "path", "verdict")
    page = F.struct(*[F.col(f"`{c}`") for c in found.columns if c != "_key"])
    left = found.select(place(sort).alias("_part"), "_key", F.lit(1).alias("_kind"), F.col("path").alias("_path"), number.alias("_id"), page.alias("page"), F.lit(None).cast(own.select(rule.alias("r")).schema["r"].dataType).alias("rule"))
    right = own.select("_part", "_key", F.lit(0).alias("_kind"), F.col("path").alias("_path"), F.lit("").alias("_id"), F.lit(None).cast(left.schema["page"].dataType).alias("page"), rule.alias("rule"))
    both = left.unionByName(right).repartitionById(n, "_part").sortWithinPartitions("_part", "_key", "_kind", "_path", "_id")
    names = [c for c in found.columns if c != "_key"]
    page_type = left.schema["page"].dataType

    def sweep(batches):
        part, stack = None, []
        for batch in batches:
            parts, keys, paths, rule = batch.column(0).to_numpy(), batch.column(1), batch.column(3), batch.column(6)
            is_page = batch.column(2).to_numpy() == 1
            best, met = np.full(len(parts), -1), []
            at_rule = np.flatnonzero(~is_page)
            turns = np.flatnonzero(np.diff(parts)) + 1
            cuts = np.unique(np.concatenate([[0, len(parts)], turns, at_rule, at_rule + 1])).tolist()
            for low, high in pairwise(cuts):  # one rule, or pages of one range without a rule between them
                if parts[low] != part:
                    part, stack = parts[low], []
                if not is_page[low]:
                    key = keys[low].as_py()
                    while stack and not key.startswith(stack[-1][0]):
                        stack.pop()
                    stack.append((key, rule[low].as_py()))
                    continue
                while stack and low < high:
                    # keys are sorted, so those inside the innermost interval come first
                    end = low + pc.starts_with(keys.slice(low, high - low), stack[-1][0]).true_count
                    for _, x in sorted(stack, key=lambda s: (len(s[1]["host"]) + len(s[1]["path"]), len(s[1]["host"]))) if end > low else ():
                        fits = pc.starts_with(paths.slice(low, end - low), x["path"]).to_numpy(zero_copy_only=False)
                        best[low:end][fits] = len(met)
                        met.append(x)
                    if end < high:
                        stack.pop()
                    low = end
            chosen = pa.array(np.where(best[is_page] < 0, len(met), best[is_page]))
            rules_ = pa.array([x["host"] + x["path"] for x in met] + [None], pa.string()).take(chosen)
            verdicts = pa.array([x["verdict"] for x in met] + [default], pa.string()).take(chosen)
            page = batch.column(5).filter(pa.array(is_page))
            yield pa.RecordBatch.from_arrays([*page.flatten(), rules_, verdicts], [*names, "rule", "verdict"])

    from pyspark.sql.types import StringType, StructField, StructType

    return both.mapInArrow(lean(sweep), StructType([*page_type.fields, StructField("rule", StringType()), StructField("verdict", StringType())]))
