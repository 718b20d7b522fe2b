"""Text quality by nearest neighbours in a latent-semantic space.

A text is counted in two blocks of hashed features: its ASCII-lower-cased words, and its shape - runs of upper case, lower
case, digits, blanks, line ends and each kind of punctuation, one to four running, and how often its words come back.  Counts
are damped and weighted by inverse document frequency, each block to unit length; the leading singular vectors of the labelled
sample span the latent space.  The labelled vectors are broadcast, every document is compared with all of them in blocks
(exact cosines, no index), and the labels of its `k` nearest vote, weighted by a power of the similarity.  No shuffle.

Training reads a bounded, documented sample: `rows` labelled documents, those with the smallest hash of doc_id, with the
first of their texts where a doc_id has several.  A text has at most SIZE features however long it is, so the one training task
holds rows * SIZE floats (128 MB), and the model at most (rows + SIZE) * rank floats (3 MB).  Texts are never cut.

Cases: a null or empty text has no feature and gets the share of good ones in the sample, as does a text at right angles to
all labelled ones; null labels are not learnt from; if a document has several labels the lowest counts; with no labelled row
every score is 0.5; repeated rows and ties are scored alike, each once (of equally near neighbours those of the smaller hash of
doc_id come first); a null doc_id is scored and not learnt from; an empty table gives an empty result; a column named quality
is replaced, other columns pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kindred.llm.common import chain, lean, mix, sampled, slices, text_bytes, word_bounds, word_hashes

SIZE = 1 << 13
_HALF = SIZE // 2  # words below, shape above
#: Documents compared at once.
BLOCK = 512

_WORD = np.ones(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Classes of bytes: letters of either case, digits, blanks, line ends, and every other byte its own.
_CLASS = np.arange(256, dtype=np.uint64) + np.uint64(16)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:256], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[32, 9]], _CLASS[[10, 13]] = 4, 5


def _places(row: np.ndarray, h: np.ndarray, base: int) -> np.ndarray:
    """row * SIZE + feature of the hashes, features from base on."""
    return row * SIZE + base + (mix(h) >> np.uint64(64 - 12)).astype(np.int64)


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A dense row of damped counts for each of the texts."""
    n = len(offsets) - 1
    start, stop = word_bounds(raw, offsets[1:], _WORD)
    row = np.searchsorted(offsets, start, "right") - 1
    h = word_hashes(raw, start, stop, lower=True)
    places = [_places(row, h, 0)]
    # shape: runs of one class, ended by the text's end as well
    kind = _CLASS[raw]
    edge = np.ones(len(raw), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    first = np.flatnonzero(edge)
    kind, of = kind[first], np.searchsorted(offsets, first, "right") - 1
    for k in range(1, 5):
        m = max(len(kind) - k + 1, 0)
        one = of[:m] == of[k - 1 :]
        places.append(_places(of[:m][one], chain([kind[i : m + i][one] for i in range(k)], 100 + k), _HALF))
    # how often a word comes back, and whether at once
    _, back, times = np.unique(mix(row.astype(np.uint64)) ^ h, return_inverse=True, return_counts=True)
    share = np.log2(np.maximum(times[back] * 64 / np.bincount(row, minlength=n)[row], 1)).astype(np.uint64)
    places.append(_places(row, share + np.uint64(1 << 40) + (np.minimum(times[back], 7).astype(np.uint64) << np.uint64(8)), _HALF))
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    places.append(_places(row[again], np.full(len(again), 1 << 41, np.uint64), _HALF))
    count = np.bincount(np.concatenate(places), minlength=n * SIZE)
    out, some = np.zeros(n * SIZE, np.float32), np.flatnonzero(count)
    out[some] = np.log1p(count[some])
    return out.reshape(n, SIZE)


def _weighted(x: np.ndarray, idf: np.ndarray, words: float) -> np.ndarray:
    """Rows times idf; words have this share of a row's squared length."""
    x = x * idf
    for part, share in ((slice(0, _HALF), words), (slice(_HALF, SIZE), 1 - words)):
        size = np.sqrt((x[:, part] ** 2).sum(1, keepdims=True))
        x[:, part] *= np.sqrt(share) / np.maximum(size, 1e-12)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(1, keepdims=True))
    return np.where(size > 1e-6, x / np.maximum(size, 1e-12), 0).astype(np.float32)


def _sparse_rows(batches):
    """(key, y, text) to (key, y, places and values of its features)."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(2))
        for i, j in slices(offsets):
            for low in range(i, j, BLOCK):
                high = min(low + BLOCK, j)
                x = features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                r, at = np.nonzero(x)
                ends = pa.array(np.searchsorted(r, np.arange(high - low + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int32), x[r, at])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), *lists], ["key", "y", "at", "value"])


def singular(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x as columns, by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(rank + 16, x.shape[1]))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :rank].astype(np.float32)


def _trainer(rows: int, rank: int, words: float):
    def train(batches):
        keys, labels, x, n = [], [], np.zeros((rows, SIZE), np.float32), 0
        for batch in batches:
            keys += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            for at, value in zip(batch.column(2), batch.column(3), strict=True):
                x[n, at.values.to_numpy()] = value.values.to_numpy()
                n += 1
        if not n:
            return
        order = np.argsort(np.array(keys), kind="stable")
        x, y = x[:n][order], np.array(labels)[order]
        idf = np.log((n + 1) / ((x > 0).sum(0) + 0.5)).astype(np.float32)
        x = _weighted(x, idf, words)
        v = singular(x, rank)
        z = _unit(x @ v)
        parts = [("idf", 0, idf), *(("axes", k, r) for k, r in enumerate(v)), *(("known", k, r) for k, r in enumerate(z)), ("y", 0, y)]
        for low in range(0, len(parts), 1000):
            some = parts[low : low + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in some]), pa.array([p[1] for p in some], pa.int32()), pa.array([p[2].astype(np.float32) for p in some], pa.list_(pa.float32()))], ["what", "k", "x"])

    return train


def fit(documents: DataFrame, labels: DataFrame, *, rows: int = 4096, rank: int = 64, words: float = 0.1) -> dict[str, np.ndarray]:
    """labels: doc_id and quality (0/1) of the documents to learn from.  Weights, axes, and the labelled vectors; empty if there are none."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("y"))
    sample = sampled(own, "doc_id", rows).select("doc_id", "y", F.xxhash64("doc_id").alias("key"))  # at most `rows` rows: safe to broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "key", "y").agg(F.min("text").alias("text")).select("key", F.col("y").cast("double"), "text")
    found = texts.mapInArrow(lean(_sparse_rows), "key long, y double, at array<int>, value array<float>").repartition(1)
    parts = found.mapInArrow(lean(_trainer(rows, rank, words)), "what string, k int, x array<float>").toArrow()  # bounded by rows and SIZE
    what = np.array(parts.column("what").to_pylist())
    model = {}
    for name in ("idf", "axes", "known", "y"):
        mine = np.flatnonzero(what == name)
        if len(mine):
            k = parts.column("k").to_numpy()[mine]
            model[name] = np.stack([parts.column("x")[int(i)].values.to_numpy() for i in mine[np.argsort(k)]])
    return {n: v[0] if n in ("idf", "y") else v for n, v in model.items()}


def votes(z: np.ndarray, known: np.ndarray, y: np.ndarray, k: int, power: float) -> np.ndarray:
    """For rows of z the labels of the k nearest known vectors, weighted by a power of the cosine."""
    prior, k = float(y.mean()), min(k, len(y))
    near = z @ known.T
    at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(y) else np.broadcast_to(np.arange(k), near.shape)
    weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(float) ** power
    total = weight.sum(1)
    return np.where(total > 0, (weight * y[at]).sum(1) / np.where(total > 0, total, 1), prior)


def score(documents: DataFrame, model: dict[str, np.ndarray], *, words: float = 0.1, k: int = 31, power: float = 8.0) -> DataFrame:
    """documents (doc_id, text, any more columns) with a column quality from 0 to 1; `words` as in fit."""
    documents = documents.drop("quality")
    names = documents.columns
    schema = StructType([*documents.schema.fields, StructField("quality", DoubleType())])
    place = names.index("text")
    held = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            raw, offsets = text_bytes(batch.column(place))
            out = np.full(batch.num_rows, 0.5)
            for i, j in slices(offsets) if m else ():
                for low in range(i, j, BLOCK):
                    high = min(low + BLOCK, j)
                    x = features(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    out[low:high] = votes(_unit(_weighted(x, m["idf"], words) @ m["axes"]), m["known"], m["y"], k, power)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.clip(out, 0, 1))], [*names, "quality"])

    return documents.mapInArrow(lean(run), schema)
