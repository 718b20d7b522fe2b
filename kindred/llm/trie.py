"""Prefix trie of conversations by an LCP-aware external mergesort.

A turn is a record of RECORD bytes: 16 of the SHA-256 of its role and text, 4 for its number of words.  A conversation is the
string of its turns' records, so equal prefixes of conversations are equal prefixes of strings.  Equal conversations are counted
first; the others are sorted by Spark into runs, one a partition, in which each string carries its longest common prefix (LCP)
with the one before, in turns, and only what follows it.  The runs are cut at bounds taken from a sample of the conversations
themselves.  A task merges all runs of one range with a loser tree: of two strings the one with the longer LCP with the last winner comes
first, and only equal LCPs are compared, from there on, so shared turns are never compared again.  The merged stream keeps
a stack of the nodes on the current path: a node is finished once a string does not share it.

Ranges share nodes: those on the path of a range's first string, and those that the next range's first string, which every task
knows, goes on with.  They are passed on as partial sums, a path a range, and added up; every other node is written once.  All
columns are sums or minima over strings: a node is counted as a child, and its words as kept, by the last range that has it.

Bounds are of at most BOUND turns each, so that at most SAMPLE * BOUND * RECORD bytes (32 MB) go to the driver and the tasks; longer
conversations never are bounds, but may lie between two.  One conversation must fit into a value of 2 GB: 100 million turns.  The
ids of equal conversations are joined in chunks of ids that lie close to one another, and hashed chunk by chunk, in one stream, as a hash has no parts.

Cases: rows without conv_id are no conversation; null role or text is empty; turns of equal number follow in order of their records,
equal rows being turns each; an empty table has no node, not even a root; columns other than the four do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import hot_join, lean, materialise, partitions, sampled

RECORD = 20
KEY = 16
SAMPLE, BOUND = 4000, 409
#: conv_ids of equal conversations are joined in chunks that span so many ids.
SPAN = 4096

NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, tokens long, kept long, ends string, shared boolean"
RUN = "part int, run int, place long, lcp int, rest binary, n long, conv_id long, ends string"


def turn_record() -> F.Column:
    """Hex of a turn's record."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.substr(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(1), F.lit(2 * KEY))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(key, F.lower(F.lpad(F.hex(words.cast("long")), 2 * (RECORD - KEY), "0")))


def rebuilt(conversations: DataFrame, *, every: int = 20, keep: F.Column | None = None) -> DataFrame:
    """(conv_id, turns: hex of records) of conversations rebuilt on the first turns of each group's first one."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4 if keep is None else keep
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_record().alias("r"))
    # null turns sort first in a struct; all conversations of a group lie in one partition, so the join needs no shuffle of its own
    own = rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).repartition("base")
    lists = own.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "r"))).alias("t")).select("base", "conv_id", F.transform("t", lambda x: x.r).alias("t"))
    first = lists.where("base = conv_id").select("base", F.slice("t", 1, 3).alias("b"))
    both = lists.join(first, "base", "left").withColumn("h", h.cast("int"))
    common = F.slice(F.coalesce("b", F.array().cast("array<string>")), 1, F.col("h"))
    after = F.slice("t", F.col("h") + 1, F.greatest(F.size("t"), F.lit(1)))
    return both.select("conv_id", F.array_join(F.concat(common, after), "").alias("turns"))


def _shared(a: bytes, b: bytes, low: int = 0) -> int:
    """Turns that two strings begin with; the first `low` are known to be equal."""
    n, k = min(len(a), len(b)) // RECORD, low
    while k < n:
        step = min(64, n - k)
        if a[k * RECORD : (k + step) * RECORD] == b[k * RECORD : (k + step) * RECORD]:
            k += step
            continue
        while a[k * RECORD : (k + 1) * RECORD] == b[k * RECORD : (k + 1) * RECORD]:
            k += 1
        break
    return k


def _runs(bounds: list[bytes]):
    """Chunks of equal conversations, sorted, to one row each: a sorted run with LCPs, cut at the bounds."""
    from bisect import bisect_right

    def run(batches):
        held, before, part, place, rows = None, None, -1, 0, []

        def closed():
            nonlocal before, part, place
            seq, n, low, digest = held
            to = bisect_right(bounds, seq)
            lcp = _shared(before, seq) if to == part else 0
            rows.append((to, number, place, lcp, seq[lcp * RECORD :], n, low, digest.hexdigest()))
            before, part, place = seq, to, place + 1

        def emitted():
            columns = list(zip(*rows, strict=True))
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in RUN.split(", ")])
            rows.clear()
            return out

        number = 0
        for batch in batches:
            number = batch.column("run")[0].as_py() if batch.num_rows else number
            for seq, n, low, ids in zip(*(batch.column(c).to_pylist() for c in ("seq", "n", "low", "ids")), strict=True):
                if held is not None and held[0] == seq:
                    held[1] += n
                    held[2] = min(held[2], low)
                    held[3].update(b"," + ids.encode())
                else:
                    if held is not None:
                        closed()
                    held = [seq, n, low, hashlib.sha256(ids.encode())]
            if len(rows) >= 2000:
                yield emitted()
        if held is not None:
            closed()
        if rows:
            yield emitted()

    return run


class Run:
    """A sorted run: its current string, and the LCP of that with the last string that left the tree."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.at, self.seq, self.lcp = rows, -1, b"", 0
        self.step()

    def step(self) -> None:
        self.at += 1
        if self.at < len(self.rows):
            self.lcp = self.rows[self.at][0]
            self.seq = self.seq[: self.lcp * RECORD] + self.rows[self.at][1]

    @property
    def over(self) -> bool:
        return self.at >= len(self.rows)


def merged(runs: list[Run]):
    """(string, LCP with the one before, row) of all runs in order, from a loser tree; strings are distinct."""

    def first(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two runs; the loser's LCP becomes that with the winner."""
        x, y = runs[a], runs[b]
        if x.over or y.over:
            return (b, a) if x.over else (a, b)
        if x.lcp != y.lcp:
            return (a, b) if x.lcp > y.lcp else (b, a)
        k = _shared(x.seq, y.seq, x.lcp)
        a, b = (a, b) if x.seq[k * RECORD : (k + 1) * RECORD] <= y.seq[k * RECORD : (k + 1) * RECORD] else (b, a)
        runs[b].lcp = k
        return a, b

    n = len(runs)
    losers = [0] * n

    def play(node: int) -> int:
        """The winner below a node; the leaves are n to 2 n - 1."""
        if node >= n:
            return node - n
        won, losers[node] = first(play(2 * node), play(2 * node + 1))
        return won

    won = play(1) if n > 1 else 0
    while n and not runs[won].over:
        run = runs[won]
        yield run.seq, run.lcp, run.rows[run.at]
        run.step()
        node = (won + n) // 2
        while node:
            won, losers[node] = first(won, losers[node])
            node //= 2


EMPTY = hashlib.sha256(b"").hexdigest()
_ROOT = bytes(16)


def _below(node: bytes, record: bytes) -> bytes:
    return hashlib.blake2b(node + record[:KEY], digest_size=16).digest()


def _nodes(bounds: list[bytes]):
    """The runs of a range to its nodes."""

    def run(batches):
        parts: dict[int, dict[int, list]] = {}
        for batch in batches:
            for part, number, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.setdefault(part, {}).setdefault(number, []).append(row)
        for part in sorted(parts):
            yield from swept(part, [Run(rows) for rows in parts.pop(part).values()])

    def swept(part, runs):
        out, path, begun, last = [], [], 0, b""
        # a node: id, parent, words, smallest id, convs, children, leaves, tokens, kept words, ends, whether it has a child, shared

        def closed(depth: int, goes_on: bool):
            node = path.pop()
            if not goes_on and not node[10]:
                node[6] += 1
            node[7] += node[4] * node[2]
            node[8] += 0 if goes_on else node[2]
            out.append((node[0], node[1], depth, node[3], node[4], node[5], node[6], node[7], node[8], node[9], goes_on or node[11]))
            if path:
                above = path[-1]
                above[3] = min(above[3], node[3])
                above[4] += node[4]
                above[5] += not goes_on
                above[6] += node[6]
                above[7] += node[7]
                above[8] += node[8]

        for seq, lcp, (_, _, n, low, ends) in merged(runs):
            while len(path) > lcp + 1:
                closed(len(path) - 1, False)
            depth = len(seq) // RECORD
            for d in range(len(path), depth + 1):
                record = seq[(d - 1) * RECORD : d * RECORD] if d else b""
                words = int.from_bytes(record[KEY:]) if d else 0
                parent = path[-1][0] if d else None
                if d:
                    path[-1][10] = True
                # what the first string of a range goes through may be known before it
                path.append([_below(parent, record) if d else _ROOT, parent, words, low, 0, 0, 0, 0, 0, EMPTY, False, not begun])
            top = path[-1]
            top[3], top[4], top[9] = min(top[3], low), top[4] + n, ends
            begun, last = 1, seq
            if len(out) >= 5000:
                yield _batch(out)
                out = []
        more = _shared(last, bounds[part]) if part < len(bounds) else -1
        while path:
            closed(len(path) - 1, len(path) - 1 <= more)
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in NODE.split(", ")])


def build(conversations: DataFrame, **how) -> DataFrame:
    """(node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node."""
    spark = conversations.sparkSession
    convs = materialise(rebuilt(conversations, **how), "conversations")
    n = partitions(spark)
    short = sampled(convs.where(F.length("turns") <= 2 * RECORD * BOUND), "conv_id", SAMPLE).select("turns").distinct()
    sample = sorted(bytes.fromhex(r.turns) for r in short.collect())  # at most SAMPLE strings of BOUND turns
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    seq = F.unhex("turns").alias("seq")
    chunks = convs.groupBy(seq, F.floor(F.col("conv_id") / SPAN).alias("chunk")).agg(F.count("*").alias("n"), F.min("conv_id").alias("low"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("seq", "chunk", "n", "low", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    dealt = chunks.repartition(n, "seq").sortWithinPartitions("seq", "chunk").withColumn("run", F.spark_partition_id())
    runs = dealt.mapInArrow(lean(_runs(bounds)), RUN)
    ranges = runs.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "run", "place")
    found = materialise(ranges.mapInArrow(lean(_nodes(bounds)), NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "tokens", "kept")]
    ends = F.coalesce(F.max(F.when(F.col("ends") != EMPTY, F.col("ends"))), F.lit(EMPTY)).alias("ends")
    names = [c.split()[0] for c in NODE.split(", ")[:-1]]
    shared = found.where("shared").groupBy("node", "parent", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, ends).select(names)
    nodes = materialise(found.where("not shared").select(names).unionByName(shared), "nodes")
    below = nodes.where("parent is not null")
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    placed = hot_join(below, above, ["parent"], "weight").drop("weight")
    root = nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = placed.unionByName(root)
    return out.select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("tokens") - F.col("kept")).alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
