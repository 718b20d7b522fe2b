"""Toxicity scores: logistic regression, fitted by FTRL-proximal, over hashed word n-grams and skip-grams.

Features of a text are the hashes of its ASCII-lower-cased words, of two and three words running and of pairs with one or
two words between, each present or not.  FTRL-proximal keeps a learning rate for every coordinate and an L1 term that
leaves most weights at exactly zero, so the model is a short list of (hash, weight) that is broadcast whatever the corpus.

Training reads a bounded, documented sample: `rows` labelled documents, those with the smallest hash of doc_id, with the
first of their texts where a doc_id has several.  A feature that fewer than `seen` of the sampled texts have is not learnt:
it could not be told from chance; so with fewer labelled rows than that the model is the share of toxic ones alone.
Texts are never cut.  Every document is scored, without a shuffle.

Cases: a null or empty text has no feature and gets the model's prior; null labels are not learnt from; if a
document has several labels the highest counts; with no labelled row every score is 0.5 and predicted is 1;
repeated rows and ties are scored alike, each once; a null doc_id is scored and not learnt from; an empty table gives an
empty result; a column named toxicity is replaced, other columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kindred.llm.common import chain, lean, sampled, slices, text_bytes, word_bounds, word_hashes

BITS = 24
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


#: The words that belong to a first one: two and three running, pairs with one and with two between.
GRAMS = ((1,), (1, 2), (2,), (3,))


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every feature that occurs in the texts, repeats included."""
    start, stop = word_bounds(raw, offsets[1:], _APART)
    h = word_hashes(raw, start, stop, lower=True)
    row = np.searchsorted(offsets, start, "right") - 1
    rows, hashes = [row], [h]
    for others in GRAMS:
        n = max(len(h) - others[-1], 0)
        one = row[:n] == row[others[-1] :]
        rows.append(row[:n][one])
        hashes.append(chain([h[k : n + k][one] for k in (0, *others)], others[-1]))
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _feature_rows(batches):
    """(key, y, text) to (key, y, features)."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(2))
        for i, j in slices(offsets):
            row, at = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            pair = np.unique(row << BITS | at)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair >> BITS, np.arange(j - i + 1)), pa.int32()), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["key", "y", "f"])


def ftrl(labels: np.ndarray, offsets: np.ndarray, flat: np.ndarray, *, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[float, np.ndarray]:
    """Bias and weights; features of example i: flat[offsets[i]:offsets[i+1]], numbered from 0 without gaps."""
    size = int(flat.max()) + 1 if len(flat) else 0
    z, n, zb, nb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for _ in range(epochs):
        for i, y in enumerate(labels):
            at = flat[offsets[i] : offsets[i + 1]]
            za, na = z[at], n[at]
            root = np.sqrt(na)
            w = np.where(np.abs(za) > l1, (np.sign(za) * l1 - za) / ((beta + root) / alpha + l2), 0.0)
            wb = -zb / ((beta + nb**0.5) / alpha)
            g = 1 / (1 + np.exp(-np.clip(wb + w.sum(), -30, 30))) - y
            sigma = (np.sqrt(na + g * g) - root) / alpha
            z[at] = za + g - sigma * w
            n[at] = na + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * wb
            nb += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return -zb / ((beta + nb**0.5) / alpha), w


def _trainer(options: dict):
    def train(batches):
        held = [(batch, r) for batch in batches for r in range(batch.num_rows)]
        if not held:
            return
        held.sort(key=lambda x: (x[0].column(0)[x[1]].as_py(), x[0].column(1)[x[1]].as_py()))
        seen = np.zeros(1 << BITS, np.uint16 if len(held) < 1 << 16 else np.uint32)
        for batch, r in held:  # a text has a feature once
            seen[batch.column(2)[r].values.to_numpy()] += 1
        common = seen >= options["seen"]  # what a few documents have cannot generalise
        lists = [(x := batch.column(2)[r].values.to_numpy())[common[x]] for batch, r in held]
        labels = np.array([batch.column(1)[r].as_py() for batch, r in held])
        held, seen = [], None
        ids = np.flatnonzero(common)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
        flat = np.searchsorted(ids, np.concatenate(lists))
        params = {k: options[k] for k in ("alpha", "beta", "l1", "l2", "epochs")}
        bias, w = ftrl(labels, offsets, flat, **params)
        at = np.flatnonzero(w) if len(w) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], ids[at]]).astype(np.int64)), pa.array(np.concatenate([[bias], w[at]]))], ["f", "w"])

    return train


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = 8000, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0, epochs: int = 5, seen: int = 10) -> tuple[float, np.ndarray, np.ndarray]:
    """labels: doc_id and toxic (0/1) of the documents to learn from.  Returns bias, feature hashes (sorted), weights."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    sample = sampled(own, "doc_id", rows).select("doc_id", "y", F.xxhash64("doc_id").alias("key"))  # at most `rows` rows: safe to broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "key", "y").agg(F.min("text").alias("text")).select("key", F.col("y").cast("double"), "text")
    options = {"alpha": alpha, "beta": beta, "l1": l1, "l2": l2, "epochs": epochs, "seen": seen}
    found = texts.mapInArrow(lean(_feature_rows), "key long, y double, f array<int>").repartition(1).mapInArrow(lean(_trainer(options)), "f long, w double").orderBy("f").collect()
    if not found:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    return found[0].w, np.array([r.f for r in found[1:]], np.int64), np.array([r.w for r in found[1:]])


def score(documents: DataFrame, model: tuple[float, np.ndarray, np.ndarray]) -> DataFrame:
    """documents (doc_id, text, any more columns) with a column toxicity from 0 to 1."""
    bias, ids, weights = model
    documents = documents.drop("toxicity")
    names = documents.columns
    schema = StructType([*documents.schema.fields, StructField("toxicity", DoubleType())])
    place = names.index("text")

    def run(batches):
        known = np.zeros(1 << BITS, bool)
        known[ids] = True
        for batch in batches:
            raw, offsets = text_bytes(batch.column(place))
            total = np.full(batch.num_rows, bias)
            for i, j in slices(offsets):
                row, at = features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                hit = known[at]
                pair = np.unique(row[hit] << BITS | at[hit])
                total[i:j] += np.bincount(pair >> BITS, weights[np.searchsorted(ids, pair & ((1 << BITS) - 1))], j - i) if len(pair) else 0
            p = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*names, "toxicity"])

    return documents.mapInArrow(lean(run), schema)
