"""Exact substring dedup over bytes: every byte of a `length`-byte string that also starts elsewhere is removed.

Which strings repeat is read off a Burrows-Wheeler transform by threshold-bounded interval expansion: breadth first,
the interval of every string is extended to the left by each character before it (backward extension), and the first
interval that ends at a suffix fixes the common prefix of that suffix and the next, so common prefixes come out in
increasing order of value.  The search stops at `length`: what has no value by then shares at least so much.

A transform is built for each bounded set of blocks (see blocks.py): those that share an anchor but differ.  Equal blocks
are counted before, each is in a transform at most once.

Cases: null text is empty; texts shorter than `length` lose nothing; overlaps and repeats within one document count;
strings are judged on the input; repeated rows lose all that is long enough, both; rows without doc_id are documents like
any other, told apart by a 64-bit hash of their texts; more columns of documents are kept
(those named as the results are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from kindred.llm import blocks
from kindred.llm.common import BYTE_VALUES, SLICE_BYTES, lean, text_bytes

#: Blocks of an anchor that share a transform: some 6 MB of text.
HOT = 20_000


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse by prefix doubling; text: small integers, each separator unique and below all bytes."""
    n = len(text)
    base = int(text.max()) + 2
    step = max(1, min(4, int(62 / np.log2(base))))
    key = np.zeros(n, np.int64)
    for k in range(step):  # the first few symbols at once
        key *= base
        key[: n - k] += text[k:]
        key[: n - k] += 1
    while True:
        order = np.argsort(key).astype(np.int32)
        ordered = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1], dtype=np.int32)])
        if rank[order[-1]] == n - 1:
            return order, rank
        key = rank * np.int64(n + 1)
        key[: n - step] += rank[step:]
        key[: n - step] += 1
        step *= 2


def unset_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and for each of its places whether the suffix shares at least length with the one before it."""
    n = len(text)
    order, inverse = suffix_order(text)
    step_left = inverse[order - 1]  # place of the suffix that is one longer, the first wraps round to a separator
    # the transform's places by character and then by place are where step_left comes from
    by = np.empty(n, np.int32)
    by[step_left] = np.arange(n, dtype=np.int32)
    head = text[order]
    same = head[1:] == head[:-1]
    previous, following = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    previous[by[1:][same]] = by[:-1][same]
    following[by[:-1][same]] = by[1:][same]
    del by, head, same, inverse
    unset = np.ones(n + 1, bool)
    unset[[0, n]] = False
    low, high = np.array([0], np.int32), np.array([n - 1], np.int32)
    for _ in range(length):
        # every member of every interval; of its character the first and the last bound the extended interval
        size = high - low + 1
        member = np.arange(size.sum(), dtype=np.int32) + np.repeat(low - (np.cumsum(size, dtype=np.int32) - size), size)
        first = step_left[member[previous[member] < np.repeat(low, size)]]
        last = step_left[member[following[member] > np.repeat(high, size)]]
        first.sort()
        last.sort()  # extended intervals do not overlap: sorted, their ends belong together
        new = unset[last + 1]
        low, high = first[new], last[new]
        unset[high + 1] = False
        if not len(low):
            break
    return order, unset[:n]


def solver(length: int):
    def solve(held: list[blocks.Block]) -> list[np.ndarray]:
        """Per block, which windows also are in another of the blocks."""
        parts = [np.frombuffer(x.data, np.uint8) for x in held]
        n = len(parts)
        size = np.array([len(p) + 1 for p in parts])
        start = np.cumsum(size) - size
        text = np.empty(size.sum(), np.int32)
        for k, p in enumerate(parts):
            text[start[k] : start[k] + len(p)] = p.astype(np.int32) + n
            text[start[k] + len(p)] = k
        order, shares = unset_prefixes(text, length)
        flagged = np.zeros(len(text), bool)
        flagged[order[shares]] = True
        flagged[order[np.flatnonzero(shares) - 1]] = True
        return [flagged[a : a + s - length] for a, s in zip(start, size, strict=True)]

    return solve


def _bytes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return BYTE_VALUES[raw], offsets, raw


def repeats(documents: DataFrame, length: int = 200) -> DataFrame:
    """(doc, version, spans) of the windows of length bytes that occur more than once; see blocks.repeats."""
    kind = blocks.Kind(_bytes, length, max(1, length // 4), SLICE_BYTES, HOT, 1)
    return blocks.repeats(documents, kind, solver(length), earlier=False, most=1 << 20)


def dedup(documents: DataFrame, length: int = 200) -> DataFrame:
    """documents with n_bytes, n_removed, n_spans and kept (the bytes that remain)."""
    found = repeats(documents, length)
    kept = documents.drop("n_bytes", "n_removed", "n_spans", "kept")
    names = kept.columns
    keyed = kept.withColumns({"_doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "_version": F.xxhash64("text")})
    joined = keyed.join(found.select(F.col("doc").alias("_doc"), F.col("version").alias("_version"), "spans"), ["_doc", "_version"], "left")
    fields = [StructField(x, LongType()) for x in ("n_bytes", "n_removed", "n_spans")]

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(names.index("text")))
            total, lost, runs, left = [], [], [], []
            for r in range(batch.num_rows):
                text, marks = raw[offsets[r] : offsets[r + 1]], batch.column(len(names))[r]
                total.append(len(text))
                if not marks.is_valid:
                    lost.append(0)
                    runs.append(0)
                    left.append(text.tobytes())
                    continue
                gone = blocks.covered(marks.values.to_numpy(), length, len(text))
                lost.append(int(gone.sum()))
                runs.append(int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0]))
                left.append(text[~gone].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in (total, lost, runs)), pa.array(left, pa.binary())], [*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select(*names, "spans").mapInArrow(lean(run), StructType([*kept.schema.fields, *fields, StructField("kept", BinaryType())]))
