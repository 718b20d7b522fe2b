"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on distributed islands.

A chromosome is a packing.  Crossover takes the well-filled bins of one parent whole, then the bins of the other
that share no document with them; what is left over - the displaced documents - is placed by best fit, longest first.
Fitness is the mean squared fill, which rewards full bins.  An island begins with best-fit packings in random orders and
evolves until no packing can have fewer bins or its generations are over.

Documents are dealt at random into groups of bounded size; each group is solved on several islands, and between epochs
every island's best packing migrates to the next island of its group; an island that is not at the bound then also takes in
the best-fit decreasing packing as one more parent.  Bins that are nearly full, or as full as the group's median bin, then
stay; the documents of all other bins are dealt anew in fewer groups, until one group holds the rest.  So at least half of the
bins stay in every round, a task sees at most about GROUP documents however many there are, nothing is gathered on the driver,
and the waste is that of the last group alone, but for pieces that cannot fill a bin to more than their median bin.

Cases: a piece as long as a sequence has its own; pieces of length 0 do not occur (a document has its end id); ties go
to the smaller (doc_id, piece); repeated rows are packed each; an empty table gives an empty result; a null doc_id is kept
as null; a null text is empty; more columns of the input, whatever their names, are not carried; a very long text is cut only
where a sequence ends.
"""

from __future__ import annotations

import bisect
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.bulk import bulk
from kindred.llm.common import lean, materialise, partitions
from kindred.llm.tokens import KEEP, encoded

GROUP = 4000
#: An island's row counts as so many when it is written.
ROWS_OF_GROUP = 32_000
ISLANDS = 2
EPOCHS = 2


def best_fit(order: list[int], length: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Adds the pieces, in the given order, each to the bin with the least room that still holds it."""
    bins = bins if bins is not None else []
    room = sorted((capacity - sum(length[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect.bisect_left(room, (length[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            left -= length[i]
        else:
            k, left = len(bins), capacity - length[i]
            bins.append([i])
        if left:
            bisect.insort(room, (left, k))
    return bins


def fitness(bins: list[list[int]], length: list[int], capacity: int) -> float:
    return sum((sum(length[i] for i in b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def crossover(one: list[list[int]], two: list[list[int]], length: list[int], capacity: int, dice: random.Random) -> list[list[int]]:
    """Whole well-filled bins of `one`, then those of `two` without a document already placed; the rest by best fit."""
    fill = [sum(length[i] for i in b) for b in one]
    limit = capacity * dice.uniform(0.97, 1.0)
    taken = [b for b, f in zip(one, fill, strict=True) if f >= limit]
    if not taken:
        taken = [one[max(range(len(one)), key=fill.__getitem__)]]
    placed = {i for b in taken for i in b}
    out = [list(b) for b in taken]
    for b in two:
        if sum(length[i] for i in b) >= limit and not placed.intersection(b):
            out.append(list(b))
            placed.update(b)
    displaced = [i for i in range(len(length)) if i not in placed]
    noise = dice.choice((0.0, 0.0, 0.05))
    displaced.sort(key=lambda i: -length[i] * (1 + noise * dice.random()))
    return best_fit(displaced, length, capacity, out)


def evolve(length: list[int], capacity: int, elite: list[list[list[int]]], seed: int, *, population: int = 4, generations: int = 16) -> list[list[int]]:
    """The best packing of an island; elite: packings of the epoch before, from this island and others."""
    dice = random.Random(seed)
    least = -(-sum(length) // capacity)

    def ranked(packings):
        return sorted(packings, key=lambda p: (len(p), -fitness(p, length, capacity)))[:population]

    people = list(elite)
    if people and min(map(len, people)) > least:
        people.append(best_fit(sorted(range(len(length)), key=lambda i: -length[i]), length, capacity))
    while len(people) < population and (not people or min(map(len, people)) > least):
        people.append(best_fit(dice.sample(range(len(length)), len(length)), length, capacity))
    people = ranked(people)
    for _ in range(generations):
        if len(people[0]) <= least or len(people) < 2:
            break
        one, two = dice.sample(people, 2)
        people = ranked([*people, crossover(one, two, length, capacity, dice)])
    return people[0]


def _bins(place: np.ndarray) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(place.tolist()):
        out.setdefault(b, []).append(i)
    return list(out.values())


def _island(capacity: int, epoch: int):
    """Rows (group, island, keys, lengths, packings): one island; its own and the arrived packings evolve."""

    def run(batches):
        for batch in batches:
            group, island, own = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4)
            lists, out = batch.column(3), []
            for r in range(batch.num_rows):
                length = lists[r].values.to_numpy().tolist()
                elite = [_bins(np.frombuffer(x.as_py(), "<i4")) for x in own[r].values] if own[r].is_valid else []
                bins = evolve(length, capacity, elite, 1_000_003 * group[r] + 7 * island[r] + epoch)
                place = np.zeros(len(length), "<i4")
                for k, b in enumerate(bins):
                    place[b] = k
                out.append([place.tobytes()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.binary()))], ["grp", "island", "keys", "lengths", "packings"])

    return run


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces: key (long, distinct) and length (int, 1 to capacity).  Returns key, sequence_id, offset."""
    spark = pieces.sparkSession
    own = pieces.select("key", F.col("length").cast("int").alias("length"))
    done = own.where(F.col("length") == capacity).select("key", F.col("key").alias("bin"), "length")
    rest = own.where(F.col("length") < capacity)
    finished, level = [], 0
    count = rest.count()
    island = "grp long, island int, keys array<bigint>, lengths array<int>, packings array<binary>"
    while count:
        groups = max(1, -(-count // GROUP))
        last = groups == 1
        dealt = rest.withColumn("grp", F.pmod(F.xxhash64("key", F.lit(level)), F.lit(groups)))
        # a group is gathered in one row: its size is about GROUP whatever the input
        rows = dealt.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("key", "length"))).alias("x"))
        rows = rows.select("grp", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("x.key").alias("keys"), F.col("x.length").alias("lengths"), F.lit(None).cast("array<binary>").alias("packings"))
        state = rows
        for epoch in range(EPOCHS):
            state = state.repartition(max(1, min(groups * ISLANDS, partitions(spark))), "grp", "island").mapInArrow(lean(_island(capacity, epoch)), island)
            if epoch + 1 < EPOCHS:  # the elite goes to the next island of the ring
                state = materialise(state, "islands", groups * ISLANDS * ROWS_OF_GROUP)
                sent = state.select("grp", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("packings").alias("arrived"))
                state = state.join(sent, ["grp", "island"]).select("grp", "island", "keys", "lengths", F.concat("packings", "arrived").alias("packings"))
        solved = state.mapInArrow(lean(_flatten(capacity)), "grp long, island int, bins int, fit double, keys array<bigint>, lengths array<int>, place array<int>, stays array<boolean>")
        best = solved.groupBy("grp").agg(F.min_by(F.struct("keys", "lengths", "place", "stays"), F.struct("bins", F.negative("fit"), "island")).alias("x"))
        flat = materialise(best.select(F.explode(F.arrays_zip("x.keys", "x.lengths", "x.place", "x.stays")).alias("p"), "grp").select(F.col("p.keys").alias("key"), F.col("p.lengths").alias("length"), F.col("p.place").alias("place"), F.col("p.stays").alias("stays"), "grp"), "packed", count)
        full = F.lit(True) if last else F.col("stays")
        left = 0 if last else flat.where(~full).count()
        stay = flat.where(full)
        low = stay.groupBy("grp", "place").agg(F.min("key").alias("bin"))
        finished.append(stay.join(low, ["grp", "place"]).select("key", "bin", "length"))
        rest = flat.where(~full).select("key", "length")
        count, level = left, level + 1
    for x in finished:
        done = done.unionByName(x)
    # at most `capacity` pieces share a sequence: the running sum needs no large group
    w = Window.partitionBy("bin").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    return done.select("key", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long").alias("offset"))


def _flatten(capacity: int):
    def run(batches):
        for batch in batches:
            bins, fit, places, stays = [], [], [], []
            for r in range(batch.num_rows):
                place = np.frombuffer(batch.column(4)[r].values[0].as_py(), "<i4")
                length = batch.column(3)[r].values.to_numpy()
                fill = np.bincount(place, length).astype(np.int64)
                bins.append(len(fill))
                fit.append(float(((fill / capacity) ** 2).mean()))
                places.append(place)
                stays.append((fill >= min(capacity * (1 - 1 / 512), np.median(fill)))[place])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bins, pa.int32()), pa.array(fit), batch.column(2), batch.column(3), pa.array(places, pa.list_(pa.int32())), pa.array(stays, pa.list_(pa.bool_()))], ["grp", "island", "bins", "fit", "keys", "lengths", "place", "stays"])

    return run


def cut(documents: DataFrame, tokenizer: str, *, end: int, spaced: bool, capacity: int, keep: int = KEEP, forget: bool = False) -> DataFrame:
    """Every document's ids, cut into pieces of at most capacity: doc_id, piece, start, length, ids_crc32.

    keep bounds what the encoder remembers; forget: workers give that memory back after each task.
    """
    def run(batches):
        encode = bulk(tokenizer, spaced, keep)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encode, end), strict=True):
                for k, a in enumerate(range(0, len(ids), capacity)):
                    part = ids[a : a + capacity]
                    out.append((doc_id, k, a, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        if forget:
            bulk.cache_clear()

    return documents.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(documents: DataFrame, tokenizer: str, *, end: int, spaced: bool, capacity: int = 4096, keep: int = KEEP, forget: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    pieces = cut(documents, tokenizer, end=end, spaced=spaced, capacity=capacity, keep=keep, forget=forget)
    keyed = materialise(pieces.withColumn("key", F.monotonically_increasing_id()), "pieces")  # written once, so that keys stay
    placed = pack(keyed, capacity)
    return keyed.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
