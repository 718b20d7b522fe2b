"""Row pattern matching: `A (D|U)* P D*` over each key's rows in order of time, found on run tokens.

A is any row with a value; D and U have less and more cents than the row before; P is of the goal kind and has at least A's
cents.  D, U and P follow the row before within the gap; D and U are of a known kind other than the bad one.  The search
backtracks as in Java or Python, goes one row on where nothing fits, and after a match goes on at its last row.

Rows that are neither D, U nor of the goal kind with the cents of the row before (E: they may be a P only) break a key's rows
into sessions.  No match crosses a break, and the search begins anew there, so sessions are independent.  Inside a session every
maximal run of D or of U rows becomes one token with its goal cents, the most cents of its rows of the goal kind.  (D|U)* ends
at the last row, up to the next E, that can be P: the last token whose goal cents suffice is found by bisection of the maxima from
the right, and rows are looked at in that token alone, to place P.

Rows are dealt by ranges of (key, time, number), so a key of a third of all rows lies in many tasks.  Each task matches the
sessions that it holds from break to break, and passes on the rows before its first break and from its last one; these pieces,
one or two a task, are joined with their neighbours' and matched in the same way.  Matches are numbered by sums
over tasks, in blocks of FAN, so no task sees more than FAN of these sums.  A session is the unit that one task must hold (some 40
bytes a row): its labels may be one match's, and the hash of a text has no parts.

Cases: rows without key or time are dropped; equal rows count once (rows that agree in key, time, number, kind and value are
equal if the 64-bit hashes of their other columns are); a null number sorts first and is null in the result; rows of equal time
and number follow in order of kind, value and that hash; a null or non-finite value fits no letter; cents beyond 64 bits are
clipped; an empty table gives an empty result; columns of the result's names do no harm.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import lean, materialise, partitions

#: Rows that a task works on at once; a longer session is held whole.
CHUNK = 1 << 16
#: Sums over tasks are taken in blocks of so many.
FAN = 1024
NONE = -(1 << 63)
#: What a row's kind allows: nothing (null or the bad one), D and U, and P as well.
BAD, OTHER, GOAL = 0, 1, 2
B, D, U, E = 0, 1, 2, 3

RESULT = "key long, k long, first_id long, last_id long, n_rows long, sum_cents long, labels string"
FOUND = f"unit long, shared boolean, {RESULT}, role int, ts array<long>, number array<long>, cents array<long>, code array<int>"


def letters(key: np.ndarray, ts: np.ndarray, cents: np.ndarray, code: np.ndarray, gap: int) -> np.ndarray:
    """B, D, U or E for rows in order; the first is a break."""
    out = np.zeros(len(key), np.int8)
    if len(key) < 2:
        return out
    now, before = cents[1:], cents[:-1]
    linked = (key[1:] == key[:-1]) & (ts[1:] - ts[:-1] <= gap) & (now != NONE) & (before != NONE) & (code[1:] != BAD)
    out[1:] = np.select([linked & (now < before), linked & (now > before), linked & (code[1:] == GOAL)], [D, U, E], B)
    return out


class Tokens:
    """Run tokens of rows in order: every break and every E is a token of its own."""

    def __init__(self, letter: np.ndarray, cents: np.ndarray, goal: np.ndarray):
        edge = np.ones(len(letter), bool)
        edge[1:] = (letter[1:] != letter[:-1]) | (letter[1:] == B) | (letter[1:] == E)
        first = np.flatnonzero(edge)
        self.of = (np.cumsum(edge) - 1).tolist()  # a row's token
        self.first, self.letter = first.tolist(), letter[first].tolist()
        self.last = np.append(first[1:], len(letter)).tolist()  # exclusive
        self.goal = np.maximum.reduceat(np.where(goal, cents, NONE), first).tolist() if len(first) else []
        # the last row of the goal kind up to a row
        self.before = np.maximum.accumulate(np.where(goal, np.arange(len(goal)), -1)).tolist() if len(goal) else []
        self.cents = cents


def matches(tokens: Tokens, low: int, high: int, cents: list[int]) -> list[tuple[int, int, int]]:
    """(first row, row of P, last row) of the matches in a session of two rows or more: the tokens from low to before high."""
    out, t, at = [], low, tokens.first[low]
    end = tokens.last[high - 1]
    while t < high:
        # a stretch: a break or an E, and the runs up to the next E
        stop = t + 1
        while stop < high and tokens.letter[stop] != E:
            stop += 1
        edge = tokens.first[stop] if stop < high else end
        after = cents[edge] if stop < high else NONE  # the E that may be P
        most, best = [], NONE  # of the goal cents from the right
        for k in range(stop - 1, t, -1):
            best = max(best, tokens.goal[k])
            most.append(best)
        while at < edge:
            a, p = cents[at], -1
            if a <= after:
                p, k = edge, stop
            elif a <= best:
                k = stop - 1 - bisect_left(most, a)
                if tokens.letter[k] == U:
                    p = tokens.before[tokens.last[k] - 1]
                else:  # cents fall: the last row with enough, then the last goal up to it
                    run = tokens.cents[tokens.first[k] : tokens.last[k]]
                    p = tokens.before[tokens.first[k] + len(run) - int(np.searchsorted(run[::-1], a)) - 1]
            if p <= at:
                at += 1
                continue
            e = p
            if k < stop and tokens.letter[k] == D:
                e = tokens.last[k] - 1
            elif k + 1 < high and tokens.letter[k + 1] == D and p == tokens.last[k] - 1:
                e = tokens.last[k + 1] - 1
            out.append((at, p, e))
            at = e
        t = stop
    return out


def _searched(key, ts, cents, code, gap: int) -> tuple[np.ndarray, list[tuple[int, int, int]], np.ndarray]:
    """Letters of rows in order, all matches of their sessions, and the sums of cents up to a row."""
    letter = letters(key, ts, cents, code, gap)
    tokens = Tokens(letter, cents, (code == GOAL) & (cents != NONE))
    begins = [k for k, x in enumerate(tokens.letter) if x == B]
    plain, found = cents.tolist(), []
    for low, high in zip(begins, [*begins[1:], len(tokens.letter)], strict=True):
        if high - low > 1:
            found += matches(tokens, low, high, plain)
    return letter, found, np.concatenate([[0], np.cumsum(np.where(cents == NONE, 0, cents))])


_NAMES = np.frombuffer(b"BDUE", np.uint8)


def _result(unit: int, key: np.ndarray, number: pa.Array, letter: np.ndarray, found: list, sums: np.ndarray, taken: dict[int, int], shared: set[int] | None) -> pa.RecordBatch:
    """The rows of matches; taken: how many each key had before in this unit; shared: keys that other units may have (None: all)."""
    first = np.array([m[0] for m in found], np.int64)
    last = np.array([m[2] for m in found], np.int64)
    text = _NAMES[letter].tobytes()
    labels = [(b"A" + text[i + 1 : p] + b"P" + text[p + 1 : e + 1]).decode() for i, p, e in found]
    keys, ks = key[first].tolist() if found else [], []
    for x in keys:
        ks.append(taken.get(x, 0))
        taken[x] = ks[-1] + 1
    n = len(found)
    columns = [pa.array([unit] * n, pa.int64()), pa.array([shared is None or x in shared for x in keys], pa.bool_()), pa.array(keys, pa.int64()), pa.array(ks, pa.int64()), number.take(pa.array(first)), number.take(pa.array(last)), pa.array(last - first + 1), pa.array(sums[last + 1] - sums[first]), pa.array(labels, pa.string())]
    empty = [pa.nulls(n, t) for t in (pa.int32(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([*columns, *empty], [c.split()[0] for c in FOUND.split(", ")])


#: Pieces that a task passes on: rows before its first break (or all), rows from its last break.
HEAD, TAIL = 0, 1


def _piece(part: int, role: int, rows: tuple) -> pa.RecordBatch:
    key, ts, cents, code, number = rows
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())]
    whole = lambda x, t: pa.array([x], pa.list_(t))
    columns = [pa.array([part], pa.int64()), pa.array([False]), pa.array([key[0]], pa.int64()), *none, pa.array([role], pa.int32()), whole(ts, pa.int64()), whole(number.to_pylist(), pa.int64()), whole(cents, pa.int64()), whole(code.astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])


def _task(gap: int):
    def run(batches):
        held, size, limit, part, head, taken = [], 0, CHUNK, None, True, {}

        def settled(last: bool):
            """Works on what is held, but for the rows from the last break on, which stay or go on as pieces."""
            nonlocal held, size, head
            table = pa.Table.from_batches(held).combine_chunks()
            key, ts, cents, code = (table.column(i).cast(pa.int64()).to_numpy() for i in (1, 2, 4, 5))
            number = table.column(3).combine_chunks()
            begins = np.flatnonzero(letters(key, ts, cents, code, gap) == B)
            # row 0 begins a session only if an earlier chunk of this task ended there
            begins = begins[1:] if head else begins
            cut = lambda i, j: (key[i:j], ts[i:j], cents[i:j], code[i:j], number.slice(i, j - i))
            if not len(begins):
                if last:
                    yield _piece(part, HEAD, cut(0, len(key)))
                return
            low, high = int(begins[0]), int(begins[-1])
            if head:
                yield _piece(part, HEAD, cut(0, low))
                head = False
            if high > low:
                own = cut(low, high)
                letter, found, sums = _searched(*own[:4], gap)
                yield _result(2 * part, own[0], own[4], letter, found, sums, taken, {int(key[0]), int(key[-1])})
                taken_keys = {int(key[high])}
                for x in [x for x in taken if x not in taken_keys]:
                    del taken[x]  # of keys that are over
            if last:
                yield _piece(part, TAIL, cut(high, len(key)))
            held, size = table.slice(high).to_batches(), len(key) - high

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            held.append(batch)
            size += batch.num_rows
            if size >= limit:
                yield from settled(False)
                limit = max(CHUNK, 2 * size)  # one long session: not until it has doubled
        if held:
            yield from settled(True)

    return run


def _joined(gap: int):
    """Pieces of one home, in order, are consecutive rows: a task's last session and what follows it elsewhere."""

    def run(batches):
        home, held = None, []

        def settled():
            flat = lambda name, dtype: np.concatenate([x[name].values.to_numpy(zero_copy_only=False).astype(dtype) for x in held])
            ts, cents, code = flat("ts", np.int64), flat("cents", np.int64), flat("code", np.int64)
            key = np.repeat(np.array([x["key"].as_py() for x in held], np.int64), [len(x["ts"].values) for x in held])
            number = pa.concat_arrays([x["number"].values for x in held])
            letter, found, sums = _searched(key, ts, cents, code, gap)
            return _result(2 * home + 1, key, number, letter, found, sums, {}, None)

        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in ("key", "ts", "cents", "code", "number")}
                if batch.column("home")[r].as_py() != home:
                    if held:
                        yield settled()
                    home, held = batch.column("home")[r].as_py(), []
                held.append(row)
        if held:
            yield settled()

    return run


def before(df: DataFrame, keys: list[str], unit: str, value: F.Column, name: str, how=F.sum) -> DataFrame:
    """df with the sum (or another aggregate) of value over the rows of smaller unit and equal keys, null if there are none.  It is
    taken inside blocks of FAN units and over blocks."""
    blocks = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(unit) / FAN))
    within = how("_v").over(Window.partitionBy(*keys, "_block").orderBy(unit).rowsBetween(Window.unboundedPreceding, -1))
    totals = blocks.groupBy(*keys, "_block").agg(how("_v").alias("_t"))
    # windows of FAN blocks again: a million units are two levels
    totals = totals.withColumn("_over", F.floor(F.col("_block") / FAN))
    earlier = how("_t").over(Window.partitionBy(*keys, "_over").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    top = totals.groupBy(*keys, "_over").agg(how("_t").alias("_s"))
    top = top.withColumn("_top", how("_s").over(Window.partitionBy(*keys).orderBy("_over").rowsBetween(Window.unboundedPreceding, -1))).drop("_s")
    totals = totals.withColumn("_low", earlier).drop("_t").join(top, [*keys, "_over"]).drop("_over")
    parts = F.array_compact(F.array("_top", "_low", "_in"))
    folded = F.array_max(parts) if how is F.max else F.aggregate(parts, F.lit(0).cast("long"), lambda a, b: a + b)
    out = blocks.withColumn("_in", within).join(totals, [*keys, "_block"]).withColumn(name, F.when(F.size(parts) > 0, folded))
    return out.drop("_v", "_block", "_in", "_low", "_top")


def match(rows: DataFrame, *, key: str = "client_id", time: str = "ts", number: str = "click_id", value: str = "value", kind: str = "kind", goal: str = "view", bad: str = "error", gap_seconds: int = 900) -> DataFrame:
    """(key, match_no, first_id, last_id, n_rows, sum_cents, labels): a row per match, numbered from 1 within its key."""
    spark = rows.sparkSession
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in (key, time, number, value, kind)]
    amount = F.col(value).cast("double")
    finite = amount.isNotNull() & ~F.isnan(amount) & (F.abs(amount) < float("inf"))
    cents = F.when(finite, F.greatest(F.floor(100 * amount + 0.5), F.lit(NONE + 1))).otherwise(F.lit(NONE))
    code = F.when(F.col(kind) == goal, GOAL).when(F.col(kind) == bad, BAD).when(F.col(kind).isNull(), BAD).otherwise(OTHER)
    own = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(time).alias("ts"), F.col(number).cast("long").alias("number"), cents.alias("cents"), code.alias("code"), F.col(kind).alias("kind"), amount.alias("value"), (F.xxhash64(*rest) if rest else F.lit(0).cast("long")).alias("more"))
    own = own.distinct()
    order = ["key", "ts", "number", "kind", "value", "more"]
    dealt = own.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    dealt = dealt.select(F.spark_partition_id().alias("part"), "key", "ts", "number", "cents", "code")
    gap = gap_seconds * 1_000_000
    found = materialise(dealt.mapInArrow(lean(_task(gap)), FOUND), "matches")
    pieces = found.where("role is not null").withColumnRenamed("unit", "part")
    # a head belongs to the last task before that has a tail
    tails = pieces.groupBy("part").agg(F.max("role").alias("tail"))
    homes = before(tails, [], "part", F.when(F.col("tail") == TAIL, F.col("part")), "home", F.max)
    homes = homes.select("part", F.coalesce("home", F.lit(-1)).alias("last"))
    placed = pieces.join(homes, "part").withColumn("home", F.when(F.col("role") == TAIL, F.col("part")).otherwise(F.col("last")))
    n = partitions(spark)
    placed = placed.select("home", "part", "role", "key", "ts", "number", "cents", "code").repartition(n, "home").sortWithinPartitions("home", "part", "role")
    names = [c.split()[0] for c in RESULT.split(", ")]
    across = placed.mapInArrow(lean(_joined(gap)), FOUND)
    across = materialise(across.select("unit", *names), "across")
    whole = found.where("role is null")
    alone = whole.where("not shared").select(*names, (F.col("k") + 1).alias("match_no"))
    parts = whole.where("shared").select("unit", *names).unionByName(across)
    counts = before(parts.groupBy("key", "unit").agg(F.count("*").alias("n")), ["key"], "unit", F.col("n"), "base")
    parts = parts.join(counts.drop("n"), ["key", "unit"]).select(*names, (F.coalesce("base", F.lit(0)) + F.col("k") + 1).alias("match_no"))
    return alone.unionByName(parts).select(F.col("key").alias(key), "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels")
