"""Substring dedup over words: seeds are extended both ways to maximal repeats.

Seeds are winnowed anchors: of every `length` words the k-gram with the least hash.  Documents are joined on them; what is
around an occurrence of a seed is its block (see blocks.py): all windows of `length` words with that anchor.  All
occurrences of a seed are extended together, word by word, to the left and to the right: at every step those that still
agree stay in one class.  Occurrences that agree in a words to the left and b to the right share a repeat of a + k + b
words; where that reaches `length`, the words of it that an earlier document has too are removed, so one document keeps
them, that with the smallest doc_id.  Runs of such windows that touch, across blocks too, are one maximal repeat.
No pair of occurrences is listed: a step is one sort of the occurrences' classes.

A seed with more than HOT occurrences is made longer, as long as a window: nothing is left to extend, and the windows
are counted by content where they are.  Words count as equal if their 64-bit hashes are.

Cases: null text has no words; fewer words than `length` lose nothing; a passage twice in one document alone is kept;
windows are judged on the input; rows with equal doc_id count as one document; a null doc_id is smaller than any other;
more columns of documents are kept (those named as the results are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kindred.llm import blocks
from kindred.llm.common import lean, text_bytes, word_bounds, word_hashes

#: Occurrences of a seed that are extended together at most.
HOT = 100_000


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, stop = word_bounds(raw, offsets[1:])
    values = word_hashes(raw, start, stop)
    return values, np.searchsorted(start, offsets), values.view(np.uint8)


def _finer(classes: np.ndarray, token: np.ndarray) -> np.ndarray:
    """Classes of those that were in one class and have the same token now; both are small numbers."""
    return np.unique(classes << 32 | token, return_inverse=True)[1]


def extender(length: int, k: int):
    def extend(held: list[blocks.Block]) -> list[np.ndarray]:
        """Per occurrence of a seed, which windows around it an occurrence in an earlier document shares."""
        size = np.array([len(x.data) // 8 for x in held])
        base = np.cumsum(size) - size
        token = np.unique(np.frombuffer(b"".join(x.data for x in held), np.uint64), return_inverse=True)[1]
        place, first = np.array([x.place for x in held]), np.array([x.first for x in held])
        seed = np.unique(np.array([x.anchor for x in held]), return_inverse=True)[1]
        for i in range(k):  # the seeds' own words: anchors are equal by hash only
            seed = _finer(seed, token[base + place + i])
        # which[b], right[b]: the occurrences with b more words to the right, and their classes
        which, right = [np.arange(len(held))], [seed]
        after = size - place - k
        for b in range(1, length - k + 1):
            more = after[which[-1]] >= b
            which.append(which[-1][more])
            right.append(_finer(right[-1][more], token[base[which[-1]] + place[which[-1]] + k - 1 + b]))
        flagged = np.zeros(len(token), bool)  # by the window's first word
        own, left, at = np.arange(len(held)), seed, np.full(len(held), -1)
        for a in range(length - k + 1):
            if a:
                more = place[own] >= a
                own, left = own[more], left[more]
                left = _finer(left, token[base[own] + place[own] - a])
            b = length - k - a
            at[:] = -1
            at[which[b]] = right[b]
            both = at[own] >= 0
            some = own[both]
            if not len(some):
                continue
            pair = _finer(left[both], at[some])
            least = np.full(pair.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, pair, first[some])
            late = some[least[pair] < first[some]]
            flagged[base[late] + place[late] - a] = True
        return [flagged[i : i + n - length + 1] for i, n in zip(base, size, strict=True)]

    return extend


def repeats(documents: DataFrame, length: int = 50) -> DataFrame:
    """(doc, version, spans) of the windows of length words that also start in a document with a smaller doc_id."""
    k = max(1, length // 4)
    kind = blocks.Kind(_words, length, k, 1 << 17, HOT, 8)
    return blocks.repeats(documents, kind, extender(length, k), earlier=True, most=1 << 21)


def dedup(documents: DataFrame, length: int = 50) -> DataFrame:
    """documents with n_words, n_removed and kept (the remaining words, joined by one blank)."""
    found = repeats(documents, length)
    kept = documents.drop("n_words", "n_removed", "kept")
    names = kept.columns
    keyed = kept.withColumns({"_doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "_version": F.xxhash64("text")})
    joined = keyed.join(found.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "spans"), ["_doc", "_version"], "left")

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(names.index("text")))
            total, lost, left = [], [], []
            for r in range(batch.num_rows):
                text, marks = raw[offsets[r] : offsets[r + 1]], batch.column(len(names))[r]
                start, stop = word_bounds(text, np.array([len(text)]))
                data = text.tobytes()
                gone = blocks.covered(marks.values.to_numpy(), length, len(start)) if marks.is_valid else np.zeros(len(start), bool)
                total.append(len(start))
                lost.append(int(gone.sum()))
                left.append(b" ".join([data[a:b] for a, b in zip(start[~gone].tolist(), stop[~gone].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(left, pa.string())], [*names, "n_words", "n_removed", "kept"])

    fields = [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())]
    return joined.select(*names, "spans").mapInArrow(lean(run), StructType([*kept.schema.fields, *fields]))
