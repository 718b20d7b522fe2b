"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

1. Postings (term, document, position) of every word of the corpus that any test item uses are stored as a table.
2. Every distinct window of test words is ordered by how often its terms occur in the whole corpus, rarest first; a window
   with a term that never occurs is done with.
3. The postings of a window's rarest term, shifted by its offset, are the candidate starts.  They are intersected with
   the shifted postings of the second rarest term, then of all others.  The joins are by (document, term, position),
   so no term, however common, is ever gathered in one place.
4. `slop` > 0 asks for proximity matches: every term may be that many words off its place.

Cases: null text has no words; an item of fewer words than a window is one window, one without words none; null item_id is
not reported; equal windows of several items are searched once; documents with equal doc_id and text are the same to the
index and both reported; a null doc_id is searched and reported like any other; a very long text is searched whole; with no items every document is clean; more columns of
documents are kept (those named as the results are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import BROADCAST_ROWS, materialise, small

#: Terms are broadcast up to so many bytes.
BROADCAST_BYTES = 32 << 20
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> F.Column:
    x = F.coalesce(F.col(text), F.lit(""))
    plain = F.octet_length(x) == F.length(x)
    low = F.when(plain, F.lower(x)).otherwise(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, APART), "")  # far cheaper than extracting each match


def few(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a column term, to be broadcast if it has few rows and its terms, which may be of any length, few bytes."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= size else df


def _document(documents: DataFrame) -> list:
    """A null doc_id is taken as 0: whether rows of equal text are told apart does not change what is found in them."""
    known = F.coalesce("doc_id", F.lit(0).cast(documents.schema["doc_id"].dataType))
    return [known.alias("doc"), F.xxhash64("text").alias("version")]


def windows(items: DataFrame, length: int) -> DataFrame:
    """(item_id, terms) for every window of every item."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, length))).alias("terms"))


def postings(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc, version, pos, term) of all words of documents that are in terms (one column, distinct)."""
    flat = documents.select(*_document(documents), F.posexplode(words("text")).alias("pos", "term"))
    return flat.join(few(terms), "term", "left_semi").select("doc", "version", "pos", "term")


def matches(documents: DataFrame, items: DataFrame, *, length: int = 10, slop: int = 0) -> DataFrame:
    """(doc, version, start, size, item_id) for every occurrence of a window of an item."""
    found = materialise(windows(items, length).distinct(), "windows")
    distinct = found.select("terms").distinct().select(F.xxhash64("terms", F.lit(1)).alias("wid"), "terms")
    index = materialise(postings(documents, found.select(F.explode("terms").alias("term")).distinct()), "postings")
    count = index.groupBy("term").agg(F.count("*").alias("n"))
    parts = distinct.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("offset", "term"))
    ranked = parts.join(count, "term", "left").groupBy("wid", "size").agg(F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("order"))
    ranked = materialise(ranked.where(~F.exists("order", lambda x: x.n.isNull())), "ranked", found.count())
    rarest = ranked.select("wid", "size", F.col("order")[0].term.alias("term"), F.col("order")[0].offset.alias("offset"))
    start = (F.col("pos") - F.col("offset")).alias("start")
    candidates = index.join(few(rarest), "term").select("doc", "version", start, "wid", "size").where("start >= 0")
    candidates = materialise(candidates, "candidates")
    near = small(candidates.select("doc", "version").distinct())
    local = index.join(near, ["doc", "version"], "left_semi")
    rest = ranked.select("wid", F.posexplode(F.slice("order", 2, length)).alias("rank", "x")).select("wid", "rank", F.col("x.term").alias("term"), F.col("x.offset").alias("offset"))

    def intersect(cand: DataFrame, which: F.Column) -> DataFrame:
        """Candidates with, for every such term of their window, a posting in its place."""
        need = rest.where(which)
        wanted = cand.join(few(need), "wid").select("doc", "version", "start", "wid", "size", "term", (F.col("start") + F.col("offset")).alias("pos"))
        if slop:
            p = local.withColumnRenamed("pos", "at")
            met = wanted.join(p, ["doc", "version", "term"]).where(F.abs(F.col("at") - F.col("pos")) <= slop).drop("at")
        else:
            met = wanted.join(local, ["doc", "version", "term", "pos"], "left_semi")
        # equal rows of documents have their postings each, and count once
        met = met.distinct().groupBy("doc", "version", "start", "wid", "size").agg(F.count("*").alias("met"))
        total = need.groupBy("wid").agg(F.count("*").alias("need"))
        return met.join(total, "wid").where("met = need").select("doc", "version", "start", "wid", "size")

    lone = candidates.where("size = 1").distinct()
    second = intersect(candidates, F.col("rank") == 0)
    both = second.where("size = 2")
    full = lone.unionByName(both).unionByName(intersect(second.where("size > 2"), F.col("rank") > 0))
    of = found.select(F.xxhash64("terms", F.lit(1)).alias("wid"), "item_id").distinct()
    return full.join(of, "wid").select("doc", "version", "start", "size", "item_id")


def decontaminate(documents: DataFrame, items: DataFrame, *, length: int = 10, slop: int = 0) -> DataFrame:
    """documents with n_words, n_hit (words inside an occurrence), item_ids (sorted as strings), contaminated."""
    found = materialise(matches(documents, items, length=length, slop=slop), "matches")
    places = found.select("doc", "version", "start", "size").distinct()
    # runs of touching or overlapping occurrences are merged; a document's own occurrences only are in a window
    w = Window.partitionBy("doc", "version").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gain = F.greatest(F.col("start") + F.col("size") - F.greatest("start", F.coalesce("reach", F.lit(0))), F.lit(0))
    hit = places.withColumn("reach", reach).groupBy("doc", "version").agg(F.sum(gain).alias("n_hit"))
    which = found.where("item_id is not null").groupBy("doc", "version").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    each = hit.join(which, ["doc", "version"], "left")
    kept = documents.drop("n_words", "n_hit", "item_ids", "contaminated")
    own = kept.withColumn("n_words", F.size(words("text")).cast("long")).withColumns({"_i": _document(documents)[0], "_v": F.xxhash64("text")})
    out = own.join(each.select(F.col("doc").alias("_d"), F.col("version").alias("_w"), "n_hit", "item_ids"), (F.col("_i") == F.col("_d")) & (F.col("_v") == F.col("_w")), "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long")).withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop("_d", "_i", "_v", "_w")
