"""Language identification: word first, then ever shorter character n-grams.

A known word adds its log frequency in each language.  A word never seen adds the mean log frequency of its longest
character n-grams that were seen (5 characters down to 1, word ends included).  The prediction is the language with the
largest sum, the score its posterior under equal priors.

Training reads a bounded, documented sample (`rows` labelled rows, those with the smallest hash of doc_id) and
keeps at most `words` words and `grams` n-grams of each length that occur twice or more, the most frequent ones, each by
its whole 64-bit hash; so the model that is broadcast has a fixed bound for each language.

Cases: a null text, or one without any letter, is `und` with score 0; with nothing to learn from every text is `und`; ties
go to the language that sorts first; repeated rows are judged alike, each once, and rows of one doc_id learnt from as long
as the sample has room; rows without doc_id, text or lang are not learnt from; columns named lang_pred or lang_score are
replaced, others pass; a very long text is judged whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from kindred.llm.common import LOWER, lean, materialise, sampled, slice_hashes, slices, text_bytes, word_bounds

LONGEST = 5
_APART = np.ones(256, bool)
_APART[[39, *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LETTER = re.compile(r"[^\W\d_]")


def _grams(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the n-character pieces of the words, each word with a blank before and after."""
    size = stop - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    flat = np.full(at[-1], 32, np.uint8)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    flat[inner] = raw[np.repeat(start - at[:-1] - 1, size)[inner] + np.flatnonzero(inner)]
    begin = np.flatnonzero((flat & 0xC0) != 0x80)  # of characters
    word = np.searchsorted(at, begin, "right") - 1
    end = np.append(begin, len(flat))[n:]
    begin, last = begin[: len(end)], word[n - 1 :][: len(end)]
    ok = word[: len(end)] == last
    if n == 1:
        ok &= inner[begin]
    return last[ok], slice_hashes(flat, begin[ok], end[ok], n)


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of texts in lower case: start, stop, text, hash."""
    start, stop = word_bounds(raw, offsets[1:], _APART)
    return start, stop, np.searchsorted(offsets, start, "right") - 1, slice_hashes(raw, start, stop)


def _counts(batches):
    """(lang, text) to counts of words (n = 0) and n-grams by language."""
    for batch in batches:
        langs, code = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        raw, offsets = text_bytes(batch.column(1))
        for i, j in slices(offsets):
            part, own = LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            start, stop, row, h = _words(part, own)
            lang = code[i:j][row]
            for one in np.unique(lang):
                mine = np.flatnonzero(lang == one)
                keys, first, count = np.unique(h[mine], return_index=True, return_counts=True)
                of = mine[first]
                for n in range(LONGEST + 1):
                    if n:
                        word, g = _grams(part, start[of], stop[of], n)
                        keys, back = np.unique(g, return_inverse=True)
                        c = np.bincount(back, count[word], len(keys)).astype(np.int64)
                    else:
                        c = count
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), n, np.int32)), pa.array(keys.view(np.int64)), pa.array([langs[one]] * len(keys), pa.string()), pa.array(c)], ["n", "key", "lang", "c"])


def fit(documents: DataFrame, *, rows: int = 6000, words: int = 100_000, grams: int = 50_000) -> dict:
    """Learns from doc_id, text and lang of the given documents, a sample of at most `rows` of them.

    By n: the languages, the hashes of words (n = 0) or n-grams, sorted, and their log frequencies in each language.
    """
    own = documents.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    counted = sampled(own, "doc_id", rows).select("lang", "text").mapInArrow(lean(_counts), "n int, key long, lang string, c long")
    counted = materialise(counted.groupBy("n", "key", "lang").agg(F.sum("c").alias("c")), "counts")
    total = {(r.n, r.lang): r.c for r in counted.groupBy("n", "lang").agg(F.sum("c").alias("c")).collect()}
    kinds = {r.n: r.k for r in counted.groupBy("n").agg(F.count_distinct("key").alias("k")).collect()}
    langs = sorted({lang for _, lang in total})
    model = {}
    for n in sorted(kinds):
        each = counted.where(F.col("n") == n).groupBy("key").agg(F.sum("c").alias("t"), *[F.sum(F.when(F.col("lang") == x, F.col("c")).otherwise(0)).alias(f"c{k}") for k, x in enumerate(langs)])
        best = each.where("t > 1").orderBy(F.desc("t"), "key").limit(grams if n else words).toArrow()
        keys = best.column("key").to_numpy().view(np.uint64)
        table = np.stack([best.column(f"c{k}").to_numpy() for k in range(len(langs))], 1)
        log = np.log((table + 0.25) / (np.array([total.get((n, x), 0) for x in langs]) + 0.25 * kinds[n]))
        order = np.argsort(keys)
        model[n] = (langs, keys[order], log[order])
    return model


def predict(documents: DataFrame, model: dict) -> DataFrame:
    """documents with lang_pred and lang_score; columns of these names are replaced."""
    kept = documents.drop("lang_pred", "lang_score")
    names = kept.columns
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())])
    langs = model[0][0] if model else []

    def look(n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys among those known, and which of them are known."""
        ids = model[n][1]
        at = np.minimum(np.searchsorted(ids, keys), max(len(ids) - 1, 0))
        return at, ids[at] == keys if len(ids) else np.zeros(len(keys), bool)

    def run(batches):
        for batch in batches:
            column = batch.column(names.index("text"))
            raw, offsets = text_bytes(column)
            pred, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            for i, j in slices(offsets) if langs else ():
                part = LOWER[raw[offsets[i] : offsets[j]]]
                start, stop, row, h = _words(part, offsets[i : j + 1] - offsets[i])
                h, first, word = np.unique(h, return_index=True, return_inverse=True)
                value = np.zeros((len(h), len(langs)))
                at, known = look(0, h)
                value[known] = model[0][2][at[known]]
                left = np.flatnonzero(~known)
                for n in range(LONGEST, 0, -1):
                    if not len(left) or n not in model:
                        continue
                    w, g = _grams(part, start[first[left]], stop[first[left]], n)
                    at, seen = look(n, g)
                    count = np.bincount(w[seen], minlength=len(left))
                    done = count > 0
                    for k in range(len(langs)):
                        value[left[done], k] = np.bincount(w[seen], model[n][2][at[seen], k], len(left))[done] / count[done]
                    left = left[~done]
                sums = np.stack([np.bincount(row, value[word, k], j - i) for k in range(len(langs))], 1)
                best = sums.argmax(1)
                posterior = 1 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
                for r in range(j - i):
                    text = column[i + r].as_py()
                    if text and _LETTER.search(text):
                        pred[i + r], score[i + r] = langs[best[r]], posterior[r]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "lang_score"])

    return kept.mapInArrow(lean(run), schema)
