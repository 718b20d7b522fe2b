"""Exact n-gram Jaccard self-join by vertical partitioning.

Every text is the set of its distinct `width`-word shingles.  The global order of shingles is by document frequency, rarest
first, then by hash, and is cut into FRAGMENTS fragments of equal weight.  Two texts with Jaccard >= percent / 100 share a shingle among the first
p = size - ceil(percent / 100 * size) + 1 of each (prefix filter), so:
1. texts with equal sets are one class, found by a 128-bit digest;
2. all shingles go once, packed, to fragments by hash range; each counts frequencies and returns what is not unique;
3. a text with p unique shingles or more is done with; of the others the non-unique shingles of the prefix give candidates;
4. of each candidate pair every fragment of the order counts the partial overlap; the sums, of whole 64-bit shingle hashes,
   decide;
5. first each text is paired with only two others of each shingle, which joins nearly all of a group of copies; then
   every candidate pair whose texts are still apart is counted too, so no link between components is missed.
A shingle that a batch finds in many of its texts is marked as frequent and its postings stay with their texts, so no
fragment receives them; it counts as the most frequent, in every batch, and is used where a prefix needs it.

Cases: null or empty text, or one without words, has an empty set and links with nothing; a text of fewer words than
`width` has one shingle, all its words; ties in frequency are ordered by hash; rows of equal doc_id are one node, their
texts are compared each; a null doc_id is smaller than any other; more columns are ignored; empty tables are fine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import chained, components, discard, hot_join, lean, materialise, mix, partitions, release, slices, small, text_bytes, word_bounds, word_hashes

BATCH_BYTES = 4 << 20
BATCH_DOCS = 60_000
FRAGMENT_TOKENS = 1 << 20
#: A shingle in so large a part of a batch's distinct texts, and in so many, is frequent.
FREQUENT = 1 / 64, 32
FRAGMENTS = 4
_U = np.uint64
_MOST = np.iinfo(np.int32).max


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, one after another, and where each text's begin."""
    start, stop = word_bounds(raw, offsets[1:])
    h = word_hashes(raw, start, stop, lower=True)
    at = np.searchsorted(start, offsets)
    grams = chained(h, width)
    out, sizes = [], []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            out.append(chained(h[a:b], b - a))
        else:
            out.append(h[:0])
        sizes.append(len(out[-1]))
    return np.concatenate(out) if out else h[:0], np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _digests(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each set: equal for equal sets, else by chance only."""
    sums = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(sets ^ _U(salt)))]) for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]
    return tuple((s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)


def _sign(width: int):
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in slices(offsets):
                sets, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                one, two = _digests(sets, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(at)), pa.array(one), pa.array(two)], ["doc", "version", "m", "one", "two"])

    return run


def _squeeze(x: np.ndarray) -> bytes:
    """Byte planes, compressed."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(x) else bytes(4)


def _expand(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[4:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


PACKED = "fragment long, batch long, docs binary, versions binary, sizes binary, tokens binary, lows binary, refs binary, counts binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]


def _row(fragment: int, batch: int, docs=b"", versions=b"", sizes=b"", tokens=b"", lows=b"", refs=b"", counts=b"") -> tuple:
    return fragment, batch, docs, versions, sizes, tokens, lows, refs, counts


def _record(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), *[pa.binary()] * 7]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


def _post(width: int, bits: int):
    """Texts to packed postings: a row per batch and fragment, and one with the batch's texts and frequent shingles."""

    rest = _U(64 - bits)  # a shingle's first bits say its hash range, 32 more go in order, the others along

    def rows(docs, versions, sets, number):
        sizes = np.array([len(x) for x in sets])
        one, two = _digests(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
        _, keep = np.unique(np.stack([one, two ^ sizes], 1), axis=0, return_index=True)  # equal sets: one is enough
        keep = np.sort(keep[sizes[keep] > 0])
        if not len(keep):
            return
        docs, versions, sizes, sets = docs[keep], versions[keep], sizes[keep], [sets[i] for i in keep]
        batch = int(mix(np.array([TaskContext.get().partitionId() << 32 | number], _U) ^ one.view(_U).sum(dtype=_U))[0].view(np.int64))
        flat, ref = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, ref = flat[order], ref[order].astype(np.uint16)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        many = np.diff(np.append(first, len(flat)))
        hot = many >= max(FREQUENT[1], FREQUENT[0] * len(sets))
        is_hot = np.repeat(hot, many)
        h, r = flat[is_hot], ref[is_hot]
        yield _row(-1 - batch % 1_000_003, batch, docs.astype("<i8").tobytes(), versions.astype("<i8").tobytes(), sizes.astype("<i4").tobytes(), h.tobytes(), b"", r.tobytes(), np.full(len(h), _MOST, "<i4").tobytes())
        marks = flat[first[hot]]
        flat, ref = flat[~is_hot], ref[~is_hot]
        cut = np.arange(1 << bits, dtype=_U) << rest
        a, c = np.searchsorted(flat, cut), np.searchsorted(marks, cut)
        b, d = np.append(a[1:], len(flat)), np.append(c[1:], len(marks))
        for f in np.flatnonzero((b > a) | (d > c)):
            own = flat[a[f] : b[f]]
            middle = np.diff((own >> (rest - _U(32))).astype(np.uint32), prepend=np.uint32(0))
            low = (own & ((_U(1) << (rest - _U(32))) - _U(1))).astype(np.uint32)
            yield _row(int(f), batch, tokens=_squeeze(middle), lows=_squeeze(low), refs=_squeeze(ref[a[f] : b[f]]), counts=marks[c[f] : d[f]].tobytes())

    def run(batches):
        docs, versions, sets, size, number = [], [], [], 0, 0
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            d, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in slices(offsets):
                flat, at = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                sets += [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                docs.append(d[i:j])
                versions.append(v[i:j])
                size += offsets[j] - offsets[i]
                if size >= BATCH_BYTES or len(sets) >= BATCH_DOCS // 2:
                    for x in range(0, len(sets), BATCH_DOCS):
                        found = list(rows(np.concatenate(docs)[x : x + BATCH_DOCS], np.concatenate(versions)[x : x + BATCH_DOCS], sets[x : x + BATCH_DOCS], number))
                        number += 1
                        if found:
                            yield _record(found)
                    docs, versions, sets, size = [], [], [], 0
        for x in range(0, len(sets), BATCH_DOCS):
            found = list(rows(np.concatenate(docs)[x : x + BATCH_DOCS], np.concatenate(versions)[x : x + BATCH_DOCS], sets[x : x + BATCH_DOCS], number))
            number += 1
            if found:
                yield _record(found)

    return run


def _grouped(batches, column: int):
    """Rows of the same key, which follow one another, as lists of tuples."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[column] != key and held:
                yield held
                held = []
            key = row[column]
            held.append(row)
    if held:
        yield held


def _count(bits: int):
    """One hash range at a time: frequencies over all batches; what occurs twice or more goes back to its batch."""
    rest = _U(64 - bits)

    def run(batches):
        for held in _grouped(batches, 0):
            fragment = held[0][0]
            if fragment < 0:
                yield _record(held)
                continue
            middle = [np.cumsum(_expand(x[5], "<u4"), dtype=np.uint32) for x in held]
            marks = np.unique(np.concatenate([np.frombuffer(x[8], "<u8") for x in held]))
            sizes = [len(x) for x in middle]
            flat = np.concatenate(middle).astype(_U) << (rest - _U(32)) | _U(fragment) << rest
            flat |= np.concatenate([_expand(x[6], "<u4") for x in held])
            ids, at, many = np.unique(flat, return_inverse=True, return_counts=True)
            many[np.isin(ids, marks)] = _MOST
            count = many[at].astype(np.int32)
            out, base = [], 0
            for x, n in zip(held, sizes, strict=True):
                own = slice(base, base + n)
                keep = count[own] > 1
                base += n
                if keep.any():
                    out.append(_row(fragment, x[1], tokens=_squeeze(flat[own][keep]), refs=_squeeze(_expand(x[7], "<u2")[keep]), counts=_squeeze(count[own][keep])))
            if out:
                yield _record(out)

    return run


def _bin(count: np.ndarray) -> np.ndarray:
    """Frequencies by bins that grow with them: at most 640."""
    return np.where(count < 256, count, 256 + (16 * np.log2(np.maximum(count, 256) / 256)).astype(np.int64))


def _masses(batches):
    """Of the counted postings how many have a frequency in each bin."""
    total = np.zeros(1024, np.int64)
    for batch in batches:
        for fragment, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total += np.bincount(_bin(np.frombuffer(counts, "<i4") if fragment < 0 else _expand(counts, "<i4")), minlength=1024)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bin", "n"])


def order_cuts(masses: dict[int, int], fragments: int) -> list[tuple[int, int]]:
    """Places (bin, hash) that cut the global order, by frequency and then hash, into fragments of equal weight."""
    total, seen, cuts = sum(masses.values()), 0, []
    for b in sorted(masses):
        while len(cuts) < fragments - 1 and seen + masses[b] >= (want := total * (len(cuts) + 1) / fragments):
            cuts.append((b, min(int((want - seen) / masses[b] * 2**64), 2**64 - 1)))
        seen += masses[b]
    return cuts


def _select(percent: int, cuts: list[tuple[int, int]]):
    """One batch at a time: per text that may have a partner, its non-unique shingles in the global order, how many of
    them are in the prefix, and where each fragment of the order ends among them."""

    def run(batches):
        for held in _grouped(batches, 1):
            head = next(x for x in held if x[0] < 0)
            docs, versions, sizes = (np.frombuffer(head[i], t) for i, t in ((2, "<i8"), (3, "<i8"), (4, "<i4")))
            rest = [x for x in held if x[0] >= 0]
            token = np.concatenate([np.frombuffer(head[5], "<u8"), *(_expand(x[5], "<u8") for x in rest)])
            ref = np.concatenate([np.frombuffer(head[7], "<u2"), *(_expand(x[7], "<u2") for x in rest)]).astype(np.int64)
            count = np.concatenate([np.frombuffer(head[8], "<i4"), *(_expand(x[8], "<i4") for x in rest)])
            order = np.lexsort((token, count, ref))
            token, ref, count = token[order], ref[order], _bin(count[order])
            shared = np.bincount(ref, minlength=len(docs))
            prefix = sizes - -(-percent * sizes.astype(np.int64) // 100) + 1 - (sizes - shared)
            ok = np.flatnonzero((prefix > 0) & (shared > 0))
            keep = np.isin(ref, ok)
            ends = [np.bincount(ref[(count < b) | (count == b) & (token < _U(t))], minlength=len(docs))[ok] for b, t in cuts]
            ends = np.stack([*ends, shared[ok]], 1).astype(np.int32) if len(ok) else np.zeros((0, 1), np.int32)
            edges = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * ends.shape[1]), pa.array(ends.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(shared[ok])]), pa.int32()), pa.array(token[keep].view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(docs[ok]), pa.array(versions[ok]), pa.array(sizes[ok].astype(np.int64)), pa.array(np.minimum(prefix, shared)[ok].astype(np.int32)), edges, lists], ["doc", "version", "m", "prefix", "ends", "tokens"])

    return run


def _verified(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (xd, xv, yd, yv) those that are similar: partial overlaps by fragment, then their sum."""
    x = fragments.select(F.col("doc").alias("xd"), F.col("version").alias("xv"), F.col("m").alias("xm"), "f", F.col("part").alias("xp"))
    y = fragments.select(F.col("doc").alias("yd"), F.col("version").alias("yv"), F.col("m").alias("ym"), "f", F.col("part").alias("yp"))
    met = pairs.join(x, ["xd", "xv"]).join(y, ["yd", "yv", "f"])
    partial = met.select("xd", "xv", "yd", "yv", "xm", "ym", F.size(F.array_intersect("xp", "yp")).cast("long").alias("o"))
    total = partial.groupBy("xd", "xv", "yd", "yv", "xm", "ym").agg(F.sum("o").alias("o"))
    return total.where(F.col("o") * 100 >= percent * (F.col("xm") + F.col("ym") - F.col("o")))


def _possible(m: str, s: str, other_m: str, other_s: str, percent: int) -> F.Column:
    """Whether sets of these sizes, with so many shingles that are not unique, can be similar: the smaller of those numbers
    bounds the overlap."""
    least = F.least(s, other_s)
    return least * 100 >= percent * (F.col(m) + F.col(other_m) - least)


def identity() -> list:
    """doc, version: a null doc_id counts as the smallest; version, a 64-bit hash, tells the texts of one doc_id apart."""
    return [F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("version")]


def similar(documents: DataFrame, *, width: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(doc, version, m): every row's set size; and (node, component): the components of all linked documents."""
    spark = documents.sparkSession
    own = documents.select(*identity(), "text")
    signed = materialise(own.mapInArrow(lean(_sign(width)), "doc long, version long, m long, one long, two long"), "signed")
    classes = signed.where("m > 0").groupBy("one", "two", "m").agg(F.min("doc").alias("low"), F.count("*").alias("n"))
    classes = materialise(classes.where("n > 1"), "classes", signed.count() // 2)
    same = hot_join(signed, classes, ["one", "two", "m"], "n").select(F.col("doc").alias("a"), F.col("low").alias("b")).where("a <> b")
    total = signed.agg(F.sum("m")).first()[0] or 0
    bits = min(max(8, (total // FRAGMENT_TOKENS).bit_length()), 31)
    n = partitions(spark)
    posted = own.mapInArrow(lean(_post(width, bits)), PACKED).repartition(n, "fragment").sortWithinPartitions("fragment")
    counted = materialise(posted.mapInArrow(lean(_count(bits)), PACKED), "counted")
    del posted
    release(spark)  # of the postings' shuffle, the largest
    masses = counted.select("fragment", "counts").mapInArrow(_masses, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    cuts = order_cuts({r.bin: r.n for r in masses.collect()}, FRAGMENTS)  # at most 640 rows
    by_batch = counted.repartition(n, "batch").sortWithinPartitions("batch")
    chosen = materialise(by_batch.mapInArrow(lean(_select(percent, cuts)), "doc long, version long, m long, prefix int, ends array<int>, tokens array<bigint>"), "chosen")
    discard(counted)
    del by_batch
    release(spark)
    fragments = chosen.select("doc", "version", "m", "tokens", "ends", F.posexplode("ends").alias("f", "end"))
    begin = F.when(F.col("f") == 0, 0).otherwise(F.col("ends")[F.col("f") - 1])
    fragments = fragments.withColumn("begin", begin).where("end > begin").withColumn("part", F.expr("slice(tokens, begin + 1, end - begin)")).drop("tokens", "ends", "begin", "end")
    shared = F.size("tokens").alias("s")  # no more can be common with any other text
    prefix = chosen.select("doc", "version", "m", shared, F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("pos", "token"))
    prefix = prefix.withColumn("pos", F.col("pos") + F.col("m") - F.col("s"))  # after the unique shingles
    # 5a. two others of each shingle: that with the fewest shingles of its own, which is nearest the middle of a group of
    # copies, and any one
    pairs = None
    for middle in (True, False):
        r = F.xxhash64("doc", "version")
        if middle:
            r = F.shiftleft(F.col("m") - F.col("s"), 40) + r.bitwiseAND(F.lit((1 << 40) - 1))
        heads = prefix.groupBy("token").agg(*[F.min_by(c, r).alias(to) for c, to in (("doc", "yd"), ("version", "yv"), ("m", "ym"), ("s", "ys"))])
        near = prefix.join(heads, "token").where("(doc, version) <> (yd, yv)").where(_possible("m", "s", "ym", "ys", percent))
        best = near.groupBy("doc", "version", "yd", "yv").agg(F.count("*").alias("c"))
        best = best.groupBy("doc", "version").agg(F.max_by(F.struct("yd", "yv"), F.struct("c", "yd", "yv")).alias("y"))
        best = best.select(F.col("doc").alias("xd"), F.col("version").alias("xv"), F.col("y.yd").alias("yd"), F.col("y.yv").alias("yv"))
        pairs = best if pairs is None else pairs.unionByName(best)
    first = materialise(_verified(pairs.distinct(), fragments, percent).select(F.col("xd").alias("a"), F.col("yd").alias("b")).unionByName(same), "links")
    found = components(first)
    # 5b. candidates that are still apart
    apart = prefix.join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    apart = materialise(apart, "prefix")
    mixed = apart.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    left = apart.join(mixed, "token")
    x, y = left.alias("x"), left.alias("y")
    # sets of these two sizes share a shingle among the first m - overlap + 1 of each, overlap being what they need
    early = lambda t: (F.col(f"{t}.m") - F.col(f"{t}.pos")) * (100 + percent) >= percent * (F.col("x.m") + F.col("y.m"))
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") < F.col("y.component")) & _possible("x.m", "x.s", "y.m", "y.s", percent) & early("x") & early("y"))
    cross = cross.select(F.col("x.doc").alias("xd"), F.col("x.version").alias("xv"), F.col("y.doc").alias("yd"), F.col("y.version").alias("yv")).distinct()
    second = _verified(cross, fragments, percent).select(F.col("xd").alias("a"), F.col("yd").alias("b"))
    links = found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second)
    return signed.select("doc", "version", "m"), components(links)


def join(documents: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """documents with n_shingles and component_id (of the smallest doc_id reachable by links, itself included)."""
    sizes, found = similar(documents, width=width, percent=percent)
    kept = documents.drop("n_shingles", "component_id")
    doc, version = identity()
    keyed = kept.withColumns({"_doc": doc, "_version": version})
    sizes = sizes.groupBy(F.col("doc").alias("_doc"), F.col("version").alias("_version")).agg(F.max("m").alias("n_shingles"))
    out = keyed.join(sizes, ["_doc", "_version"]).join(found.select(F.col("node").alias("_doc"), F.col("component").alias("component_id")), "_doc", "left")
    known = F.when(F.col("component_id") == -(1 << 63), None).otherwise(F.coalesce("component_id", "doc_id"))  # null: of a row without doc_id
    return out.withColumn("component_id", known).select(*kept.columns, "n_shingles", "component_id")


def one_of_each(documents: DataFrame, *, width: int = 5, percent: int = 75) -> DataFrame:
    """Of each group of linked texts the row with the smallest doc_id (null first, then by a hash of the text); rows without
    words all stay.  Texts of one doc_id, or without one, are told apart here, so no text goes that is like no other."""
    doc, version = identity()
    rows = documents.count()
    ids = materialise(documents.groupBy("doc_id", version).agg(F.count("*").alias("copies")), "ids", rows)
    several = ids.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_id"), F.lit(True).alias("_several"))
    several = small(materialise(several, "several", rows))
    for seed in range(64):  # a node of its own for each text of such a doc_id; only by chance is one taken already
        own = F.when(F.col("_several"), F.xxhash64("doc_id", "version", F.lit(seed))).otherwise(F.col("doc_id"))
        given = lambda df, own=own: df.join(several, F.col("doc_id").eqNullSafe(F.col("_id")), "left").withColumn("node", own)
        if not given(ids).groupBy("node").count().where("count > 1").limit(1).count():
            break
    nodes = given(ids).select("node", "doc_id", "version", "copies")
    sizes, found = similar(given(documents.select("doc_id", version, "text")).select(F.col("node").alias("doc_id"), "text"), width=width, percent=percent)
    sizes = sizes.groupBy(F.col("doc").alias("node")).agg(F.max("m").alias("m"))
    every = nodes.join(sizes, "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    row = F.struct("doc_id", "version", "copies")
    stay = every.where("m > 0").groupBy("component").agg(F.min(row).alias("x")).select("x.doc_id", "x.version", (F.col("x.copies") > 1).alias("many"))
    stay = stay.unionByName(every.where("m = 0").select("doc_id", "version", F.lit(False).alias("many")))
    stay = materialise(stay.select(doc.alias("_doc"), F.col("version").alias("_version"), "many"), "stay", rows)
    keyed = documents.withColumns({"_doc": doc, "_version": version})
    key = ["_doc", "_version"]
    once = keyed.join(stay.where("not many"), key, "left_semi")
    many = keyed.join(small(stay.where("many")), key, "left_semi").dropDuplicates(key)
    return once.unionByName(many).select(*documents.columns)
