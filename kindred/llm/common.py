"""What the training-data operators share: sessions' folders, hashing in numpy, Arrow access to texts, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are worked on in slices of about so many bytes, so a batch of any size needs bounded memory.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return settle(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own only in local mode, where it is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = sc._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[[^,]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kindred-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this driver has named, in order.
_made: list[str] = []


def fresh_path(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/kindred/{what}-{uuid.uuid4().hex}")
    return _made[-1]


@contextlib.contextmanager
def workshop(spark: SparkSession, keep):
    """Deletes in the end what was written meanwhile, but for the folders in the list keep: for steps whose result is written."""
    before = len(_made)
    try:
        yield
    finally:
        for path in _made[before:]:
            if path not in keep:
                delete(spark, path)
        _made[before:] = [p for p in _made[before:] if p in keep]


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Tables whose number of rows is known are written to a file for so many: small ones need not be as many files as a
#: shuffle has partitions.
FILE_ROWS = 250_000


def materialise(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it: lineage is cut, lost executors cost nothing.

    rows: a bound on the number of rows, where one is known.
    """
    path = fresh_path(df.sparkSession, what)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kindred_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what materialise wrote, once nothing reads it any more."""
    delete(df.sparkSession, df._kindred_path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files that no DataFrame needs any more now, not when the driver next collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


def settle(spark: SparkSession) -> SparkSession:
    """Arrow batches of a few MB: each is held by the executor and its Python worker at once, several times over.

    Python workers also find this package where the driver has it, as in local mode from another folder.
    """
    root, given = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in given.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, given)))
    given = spark.conf.getAll
    for key, value in (("maxRecordsPerBatch", "2000"), ("maxBytesPerBatch", str(16 << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if key not in given:  # a user's own choice stays
            spark.conf.set(key, value)
    return spark


def lean(run):
    """An Arrow function that gives the memory it freed back to the system when its task ends: workers live on."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return task


#: Rows of at most so many keys are broadcast; beyond it the join is by shuffle.
BROADCAST_ROWS = 200_000
#: Keys that hold more than one row in so many, and more than HOT_ROWS rows, are joined by broadcast: there are at most so many.
HOT_KEYS, HOT_ROWS = 2_000, 10_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with few columns of fixed width, to be broadcast if it is known to have few rows; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_join(big: DataFrame, keys: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """big joined with keys, whose keys are distinct; the column `weight` of keys has the number of rows in big.

    Keys of a large part of big would each land in one task: these few are broadcast, and big's rows stay where they are.
    """
    limit = max(big.count() // HOT_KEYS, HOT_ROWS)
    hot = F.broadcast(keys.where(F.col(weight) > limit))
    rest = big.join(hot.select(*on), on, "left_anti").join(keys.where(F.col(weight) <= limit), on, how)
    return big.join(hot, on).unionByName(rest)


def sampled(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows of df: those with the smallest hash of a column, of equal ones the smallest.  A bound on the hash,
    from a count, keeps what is sorted close to that number, however many partitions there are."""
    share = min(1.0, (rows + 8 * rows**0.5 + 8) / max(df.count(), 1))
    h = F.xxhash64(key)
    near = df.where(F.shiftrightunsigned(h, 32) <= int(share * (1 << 32)))
    return near.orderBy(h, key).limit(rows)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hashing -----------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 modulo 8
_U = np.uint64
_MASK = (1 << 64) - 1
_TAILS = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


class Roller:
    """Hashes of all slices of one sequence from running sums: hash(i, j) is that of values[i:j], in any place.

    64-bit arithmetic modulo 2**64 with an odd base.  Different slices may have equal hashes by construction (long ones made
    of two values in a Thue-Morse order), so these hashes only choose anchors; what is taken for equal is compared by
    slice_hashes or chained.
    """

    _pow: np.ndarray = np.ones(1, _U)
    _inv: np.ndarray = np.ones(1, _U)

    def __init__(self, values: np.ndarray):
        n = len(values)
        if len(Roller._pow) < n + 1:
            size = max(n + 1, 2 * SLICE_BYTES)
            inverse = pow(_BASE, -1, 1 << 64)
            grow = np.full(size, _BASE, _U)
            grow[0] = 1
            Roller._pow = np.multiply.accumulate(grow)
            grow = np.full(size, inverse, _U)
            grow[0] = 1
            Roller._inv = np.multiply.accumulate(grow)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(values * Roller._pow[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * Roller._inv[start]

    def fixed(self, k: int) -> np.ndarray:
        """Of every slice of k values."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * Roller._inv[:n] if n > 0 else np.zeros(0, _U)


BYTE_VALUES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93)) | _U(1)

#: Bytes with A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of UTF-8 text that part words: space and tab to carriage return.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, ends: np.ndarray, apart: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of every word in the bytes of several texts; ends: where each text ends; words end there too."""
    inside = ~apart[raw]
    edge = np.empty(len(raw) + 1, bool)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge[0], edge[-1] = inside[0], inside[-1]
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    cuts = np.unique(ends[(ends > 0) & (ends < len(raw))])  # an empty text ends where the one before does
    cuts = cuts[inside[cuts] & inside[cuts - 1]]  # two texts meet inside what looks like one word
    at = np.flatnonzero(edge)
    if len(cuts):
        at = np.sort(np.concatenate([at, cuts, cuts]))
    return at[0::2], at[1::2]


#: Longer slices are hashed one by one.
_LONG = 4096


def slice_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of raw[start:stop] for many slices: eight bytes a step, each mixed into the state before the next."""
    size = stop - start
    h = mix(size.astype(_U) * _U(0xA24BAED4963EE407) + _U(seed * 0x9FB21C651E98DF25 & _MASK))
    buf = np.zeros(len(raw) + 8, np.uint8)
    buf[: len(raw)] = raw
    at_byte = np.ndarray(len(raw) + 1, "<u8", buf, strides=(1,))
    steps = np.where(size > _LONG, 0, (size + 7) >> 3)
    order = np.argsort(steps, kind="stable")
    first = np.searchsorted(steps[order], np.arange(1, int(steps.max(initial=0)) + 2))
    state, begin, left = h[order], start[order], size[order]
    for k in range(len(first) - 1):
        f = first[k]
        v = at_byte[begin[f:] + 8 * k]
        rest = left[f:] - 8 * k
        v &= _TAILS[np.minimum(rest, 8)]
        state[f:] = mix(state[f:] * _U(0x9E3779B97F4A7C15) + v)
    h[order] = state
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : stop[i]].tobytes(), seed)
    return h


def chain(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """64-bit hashes of the values at equal places of the parts, each mixed into the state before the next."""
    h = np.full(len(parts[0]), seed, _U)
    for x in parts:
        h = mix(h * _U(0x9E3779B97F4A7C15) + x)
    return h


def chained(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of every k consecutive values."""
    n = max(len(values) - k + 1, 0)
    return chain([values[i : n + i] for i in range(k)], k)


def word_hashes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, *, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Of the words raw[start:stop]; lower: A-Z count as a-z."""
    return slice_hashes(LOWER[raw] if lower else raw, start, stop, seed)


# --- Arrow -------------------------------------------------------------------------------------------------------


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts come to about limit bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def long_list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


# --- connected components ----------------------------------------------------------------------------------------


def local_forest(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replaces links by as many as join the same nodes: each node with the smallest of its component."""
    nodes, flat = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = flat[: len(src)], flat[len(src) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        src = np.concatenate([src, batch.column(0).to_numpy(zero_copy_only=False)])
        dst = np.concatenate([dst, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(src) >= 1 << 19:
            src, dst = local_forest(src, dst)
            if len(src) > 1 << 18:  # mostly distinct nodes: pass on, memory stays bounded
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])
                src, dst = np.zeros(0, np.int64), np.zeros(0, np.int64)
    src, dst = local_forest(src, dst)
    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component: the smallest node reachable.  links: two long columns.

    Every task first contracts the links it holds to a forest.  Then large-star and small-star steps alternate
    (Kiveris et al., SoCC 2014) until nothing changes: each is one aggregation and one join by node, whose hot keys
    Spark can split; neighbours of a node are never gathered in one place.
    """
    a, b = links.columns[:2]
    edges = links.select(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst")).where("src <> dst")
    now, before = materialise(edges.mapInArrow(lean(_forest_batches), "src long, dst long").distinct(), "links"), None
    for _ in range(rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst") % 1_000_000_007)).first()
        if state == before or not state[0]:
            return now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before = state
        low = now.groupBy("src").agg(F.min("dst").alias("low"))
        far = now.join(low.withColumnRenamed("src", "dst"), "dst", "left").select("src", F.coalesce("low", "dst").alias("dst")).distinct()
        near = far.join(far.groupBy("src").agg(F.min("dst").alias("low")), "src")
        near = near.select(F.explode(F.when(F.col("dst") == F.col("low"), F.array(F.col("src"))).otherwise(F.array("src", "dst"))).alias("src"), F.col("low").alias("dst"))
        new = materialise(near.distinct(), "links", 2 * state[0])
        discard(now)
        now = new
    raise RuntimeError("components did not converge")
