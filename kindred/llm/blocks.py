"""Long repeats across a corpus, by blocks: the engine of suffix-array and substring dedup.

A window is `length` consecutive tokens (bytes or words) of one text.  Its anchor is the k-gram with the least hash in it,
the leftmost of equals, so equal windows have equal anchors at equal places, wherever they are.  A block is a longest run
of windows that share one occurrence of an anchor; every window is in exactly one block.  Hence
  - blocks that are equal repeat in all their windows: (anchor, block) is counted, pre-aggregated on the map side;
  - windows of blocks that differ can only be equal if the blocks have the same anchor: such contested anchors are
    resolved by the operator's own method, each distinct block once;
  - all other windows, most of a clean corpus, occur once.
An anchor with more than `hot` occurrences is not brought together: its windows become anchors themselves, with nothing
around them left to compare, and are counted by content, so no group is ever gathered.
Rows travel as 128-bit hashes (anchor, block); text is only shuffled by document.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import SLICE_BYTES, Roller, discard, hot_join, lean, materialise, mix, partitions, slice_hashes, slices, small, text_bytes

_U = np.uint64
ROWS = "doc long, version long, loc long, anchor long, block long"
#: Bits of a gram's hash that give way to its place: more than any slice has tokens.
_PLACE = _U(22)


class Blocks(NamedTuple):
    row: np.ndarray
    start: np.ndarray  # of the first window, in tokens of the text
    count: np.ndarray  # windows
    place: np.ndarray  # of the anchor, in tokens after the start
    anchor: np.ndarray
    block: np.ndarray


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    m = len(x) - w + 1
    if m <= 0:
        return x[:0]
    y = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    y[: len(x)] = x
    y = y.reshape(-1, w)
    before = np.minimum.accumulate(y, 1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:m], before[w - 1 : w - 1 + m])


def _blocks(values: np.ndarray, offsets: np.ndarray, raw: np.ndarray, length: int, k: int) -> Blocks:
    n, unit = len(values), len(raw) // max(len(values), 1)
    size = np.diff(offsets)
    long = size >= length
    if not long.any():
        none = np.zeros(0, np.int64)
        return Blocks(none, none, none, none, none.astype(_U), none.astype(_U))
    grams = mix(Roller(values).fixed(k))
    low = (_U(1) << _PLACE) - _U(1)
    assert n < low
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=_U), length - k + 1)
    step = np.zeros(n + 1, np.int8)
    step[offsets[:-1][long]] += 1
    step[offsets[1:][long] - length + 1] -= 1
    at = np.flatnonzero(np.cumsum(step[:n], dtype=np.int8))
    anchor = (least[at] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(at)))
    start = at[first]
    row = np.searchsorted(offsets, start, "right") - 1
    block = slice_hashes(raw, start * unit, (start + count - 1 + length) * unit)
    return Blocks(row, start - offsets[row], count, anchor[first] - start, mix(grams[anchor[first]] ^ _U(0x5851F42D4C957F2D)), block)


def blocks(values: np.ndarray, offsets: np.ndarray, raw: np.ndarray, length: int, k: int, limit: int = SLICE_BYTES) -> Blocks:
    """Of several texts, given as token values, where each text starts and the tokens' own bytes, the same number each; a
    long text is taken by overlapping parts."""
    out, unit = [], len(raw) // max(len(values), 1)
    for i, j in slices(offsets, limit):
        a, b = offsets[i], offsets[j]
        if j - i > 1 or b - a <= 2 * limit:
            x = _blocks(values[a:b], offsets[i : j + 1] - a, raw[a * unit : b * unit], length, k)
            out.append(x._replace(row=x.row + i))
            continue
        for c in range(a, b, limit):
            d = min(c + limit + length - 1, b)
            x = _blocks(values[c:d], np.array([0, d - c]), raw[c * unit : d * unit], length, k)
            out.append(x._replace(row=x.row + i, start=x.start + (c - a)))
    return Blocks(*(np.concatenate(c) for c in zip(*out, strict=True))) if out else _blocks(values, offsets, raw, length, k)


class Kind(NamedTuple):
    """tokens(raw, offsets): token values of the texts, where each text starts among them, and the tokens' own bytes, the
    same number each.  limit: tokens to a slice; hot: see above, so many blocks at most are resolved together."""

    tokens: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
    length: int
    k: int
    limit: int
    hot: int
    unit: int  # bytes of a token


def _find(kind: Kind):
    """loc: start << 16 | place of the anchor << 8 | number of windows."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets):
                x = blocks(*kind.tokens(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), kind.length, kind.k, kind.limit)
                if len(x.row):
                    where = pa.array(x.row + i)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(x.start << 16 | x.place << 8 | x.count), pa.array(x.anchor.view(np.int64)), pa.array(x.block.view(np.int64))], ["doc", "version", "loc", "anchor", "block"])

    return run


def identified(documents: DataFrame) -> DataFrame:
    """doc, version, text: a null doc_id counts as the smallest; version tells texts of one doc_id apart."""
    return documents.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("version"), "text")


PARTS = ["anchor", "block", "first", "state", "place", "data"]


def _extract(kind: Kind):
    """(text, list of (loc, anchor, block, first, state)) to the blocks' own bytes."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            lists = batch.column(1)
            at, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            loc, anchor, block, first, state = (flat.field(n).to_numpy() for n in ("loc", "anchor", "block", "first", "state"))
            for r in range(batch.num_rows):
                mine = slice(at[r], at[r + 1])
                own, unit = kind.tokens(raw[offsets[r] : offsets[r + 1]], np.array([0, offsets[r + 1] - offsets[r]]))[2], kind.unit
                start, place, count = loc[mine] >> 16, loc[mine] >> 8 & 255, loc[mine] & 255
                data = [own[a * unit : b * unit].tobytes() for a, b in zip(start, start + count - 1 + kind.length, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[mine]), pa.array(block[mine]), pa.array(first[mine]), pa.array(state[mine]), pa.array(place), pa.array(data, pa.binary())], PARTS)

    return run


def spans(flagged: np.ndarray) -> np.ndarray:
    """Runs of True, as first * 256 + number."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flagged, [False]]).astype(np.int8)))
    return edge[0::2] * 256 + (edge[1::2] - edge[0::2])


class Block(NamedTuple):
    """Of blocks with one anchor each text once: the smallest doc that has it, where the anchor is, and its bytes."""

    anchor: int
    block: int
    first: int
    place: int
    data: bytes


def _resolve(solve, most: int):
    """Rows sorted by anchor; solve(list of Blocks) gives a boolean array of flagged windows for each."""

    def flush(held: list[Block]):
        found = [(x.anchor, x.block, spans(f)) for x, f in zip(held, solve(held), strict=True) if f.any()]
        a, b, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(list(s), pa.list_(pa.int64()))], ["anchor", "block", "spans"])

    def run(batches):
        held: list[Block] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most and row[0] != held[-1].anchor:
                    yield flush(held)
                    held, size = [], 0
                if held and row[:2] == held[-1][:2]:
                    continue  # the same block of a repeated row
                held.append(Block(*row))
                size += len(held[-1].data)
        if held:
            yield flush(held)

    return run


def repeats(documents: DataFrame, kind: Kind, solve, *, earlier: bool, most: int) -> DataFrame:
    """(doc, version, spans): per document all windows that repeat, as runs start * 256 + number (at most 255 a run).

    earlier: a window counts only where a smaller doc has it too; else wherever it occurs twice.
    most: bytes of blocks that solve gets at once, but for the last anchor's.
    """
    if kind.length - kind.k >= 255:
        raise ValueError("a block has at most 255 windows: take longer grams")
    spark = documents.sparkSession
    own = identified(documents)
    every = materialise(own.mapInArrow(lean(_find(kind)), ROWS), "blocks")
    anchors = every.groupBy("anchor").agg(F.min("block").alias("lo"), F.max("block").alias("hi"), F.count("*").alias("n")).where("n > 1")
    state = F.when(F.col("lo") == F.col("hi"), 0).when(F.col("n") <= kind.hot, 1).otherwise(2).cast("byte").alias("state")
    rows = every.count()
    anchors = materialise(anchors.select("anchor", "n", state), "anchors", rows // 2)
    shared = materialise(hot_join(every, anchors, ["anchor"], "n").drop("n"), "shared", rows)
    discard(every)
    discard(anchors)
    r = F.xxhash64("doc", "version", "loc")
    distinct = shared.groupBy("anchor", "block").agg(F.max("state").alias("state"), F.count("*").alias("n"), F.min("doc").alias("first"), F.min_by("doc", r).alias("doc"), F.min_by("version", r).alias("version"), F.min_by("loc", r).alias("loc"))
    distinct = materialise(distinct, "distinct", shared.count())
    contested = distinct.where("state > 0")
    lists = contested.groupBy("doc", "version").agg(F.collect_list(F.struct("loc", "anchor", "block", "first", "state")).alias("list"))
    # where these documents are few, the others' texts need not move
    texts = own.join(small(contested.select("doc", "version").distinct()), ["doc", "version"], "left_semi")
    parts = texts.join(lists, ["doc", "version"]).select("text", "list").mapInArrow(lean(_extract(kind)), "anchor long, block long, first long, state byte, place long, data binary")
    parts = materialise(parts, "contested")
    cold = parts.where("state = 1").select(*Block._fields).repartition(partitions(spark), "anchor").sortWithinPartitions("anchor", "block")
    solved = cold.mapInArrow(lean(_resolve(solve, most)), "anchor long, block long, spans array<bigint>")
    warm = parts.where("state = 2").select("anchor", "block", "first", "data").mapInArrow(lean(_windows(kind)), "anchor long, block long, first long, hashes array<bigint>")
    single = warm.select("anchor", "block", "first", F.posexplode("hashes").alias("i", "h"))
    seen = single.groupBy("anchor", "h").agg(F.min("first").alias("least"), F.min("block").alias("lo"), F.max("block").alias("hi"))
    met = single.join(seen, ["anchor", "h"]).where(F.col("least") < F.col("first") if earlier else F.col("lo") != F.col("hi"))
    warmed = met.groupBy("anchor", "block").agg(F.transform(F.array_sort(F.collect_set("i")), lambda i: i.cast("long") * 256 + 1).alias("spans"))
    part = solved.unionByName(warmed)
    found = distinct.join(part, ["anchor", "block"], "left").where("n > 1 or spans is not null").select("anchor", "block", "first", "n", "spans")
    found = materialise(found, "found", distinct.count())
    discard(parts)
    discard(distinct)
    begin = F.expr("(loc >> 16) * 256")
    some = F.transform(F.coalesce("spans", F.array().cast("array<bigint>")), lambda x: x + begin)
    whole = F.col("doc") > F.col("first") if earlier else F.col("n") > 1
    located = hot_join(shared.select("doc", "version", "loc", "anchor", "block"), found, ["anchor", "block"], "n")
    flat = located.select("doc", "version", F.explode(F.when(whole, F.array(begin + F.col("loc").bitwiseAND(F.lit(255)))).otherwise(some)).alias("span"))
    return flat.groupBy("doc", "version").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def _windows(kind: Kind):
    """(anchor, block, first, data) to the hashes of the block's windows."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(3))
            lists = []
            for r in range(batch.num_rows):
                own = raw[offsets[r] : offsets[r + 1]]
                start = np.arange(0, len(own) - kind.length * kind.unit + 1, kind.unit)
                lists.append(slice_hashes(own, start, start + kind.length * kind.unit).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(lists, pa.list_(pa.int64()))], ["anchor", "block", "first", "hashes"])

    return run


def covered(spans_: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a flagged window."""
    step = np.zeros(n + 1, np.int64)
    start = spans_ >> 8
    np.add.at(step, start, 1)
    np.add.at(step, start + (spans_ & 255) - 1 + length, -1)
    return np.cumsum(step[:n]) > 0
