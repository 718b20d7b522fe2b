"""A corpus pipeline of training-data stages over `documents`: from raw texts to packed token sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and rereads as the docs of
the next.  All stages but the last return the columns of `documents`; each decides about the rows it is given only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, ngram_join, packing, substring_dedup, toxicity
from kindred.llm.common import discard, materialise, settle, table, workshop
from kindred.llm.queries import remainder, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of 0.5 or more go; learnt from the labelled ones that are not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(5) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.where("toxicity < 0.5").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingle sets the one with the smallest doc_id stays; texts that share a
    doc_id, or have none, are documents of their own here."""
    settle(spark)
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words that an earlier document has go; a document that loses nothing stays as it is, one that loses
    every word goes."""
    settle(spark)
    found = substring_dedup.dedup(docs)
    cut = F.col("n_removed") > 0
    found = found.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.when(cut, F.col("kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words running of a benchmark item, or a whole shorter item, go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where("not contaminated").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 4096: a row per piece of a document.  Workers forget the tokenizer afterwards: other stages share the executors."""
    settle(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end=1, spaced=False, capacity=4096, forget=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

#: A classifier, connected components and a packing have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables, and the documents that it was given, go once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        kept: list[str] = []
        with workshop(spark, kept):
            docs = materialise(stage(spark, docs, sf_dir), name)
            kept.append(docs._kindred_path)
        if before is not None:
            discard(before)
        before = docs
    return docs
