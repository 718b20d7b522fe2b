"""Near-duplicate vectors by product quantisation over inverted lists.

Coarse centroids part the unit sphere into lists.  Each vector is stored in the list of its nearest centroid as the codes of
its residual, one per subspace, with its own quantisation error.  A vector probes its nearest lists; there a table of
distances from its residual to every code word gives, by lookup and sum, its distance to each stored vector but for
that vector's error.  Whoever may be within reach by the triangle inequality is compared exactly, in double precision.
So only the choice of lists can lose a link; `probes` lists are searched from either side of a pair.

The centroids and code words are fitted on a bounded sample (`sample` vectors, those with the smallest hash); all vectors are
indexed.  Equal vectors are one class, counted, so copies are not compared.  A list is cut into blocks of at most BLOCK
stored by BLOCK probing vectors, each its own group, so a hot list or label is spread over many tasks; a block yields a
count for each vector and a spanning forest of its links, never its pairs.

Cases: a null label, a null, empty or zero vector, or one with a null or non-finite component links with nothing, nor do vectors
of different lengths; ties in distance go to the lower list; repeated rows are vectors of their own, linked by cosine 1;
a null vec_id counts as the smallest; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import components, hot_join, lean, local_forest, materialise, partitions, sampled

BLOCK = 2048
SUBSPACES = 8
WORDS = 64


def _means(x: np.ndarray, k: int, rounds: int, dice: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm."""
    c = x[dice.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)[:, 0]
        count = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, n: int = 1) -> np.ndarray:
    d = (c * c).sum(1)[None] - 2 * x @ c.T
    return np.argsort(d, 1, kind="stable")[:, :n]


def fit(x: np.ndarray, lists: int, seed: int = 7) -> tuple[np.ndarray, list[np.ndarray]]:
    """Coarse centroids, and the code words of each subspace of the residuals."""
    dice = np.random.default_rng(seed)
    c = _means(x, lists, 8, dice)
    rest = x - c[nearest(x, c)[:, 0]]
    return c, [_means(rest[:, s], WORDS, 8, dice) for s in subspaces(x.shape[1])]


def subspaces(dims: int) -> list[slice]:
    edge = np.linspace(0, dims, min(SUBSPACES, dims) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(model, probes: int):
    """(node, weight, label, embedding) to (home, probes, codes, error) of each vector."""
    c, words = model

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(3))
            near = nearest(x, c, probes)
            rest = x - c[near[:, 0]]
            cuts = subspaces(x.shape[1])
            codes = np.stack([nearest(rest[:, s], w)[:, 0] for s, w in zip(cuts, words, strict=True)], 1).astype(np.uint8)
            back = np.concatenate([w[codes[:, k]] for k, w in enumerate(words)], 1)
            error = np.linalg.norm(rest - back, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near[:, 0].astype(np.int32)), lists, pa.array([r.tobytes() for r in codes]), pa.array(error)], ["node", "weight", "label", "embedding", "home", "probes", "codes", "error"])

    return run


def _search(model, least: float):
    """Groups (label, list, block of stored, block of probing), which follow one another, to counts and links."""
    c, words = model
    reach = np.sqrt(max(0.0, 2 - 2 * least)) + 1e-9

    def solve(rows: pa.Table):
        kind = rows.column("kind").to_numpy()
        x, node, home = unit(rows.column("embedding").combine_chunks()), rows.column("node").to_numpy(), rows.column("home").to_numpy()
        weight = rows.column("weight").to_numpy()
        probes = np.array(rows.column("probes").to_pylist())
        at = rows.column("list")[0].as_py()
        stored, asking = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        if not len(stored) or not len(asking):
            return None
        codes = np.frombuffer(b"".join(rows.column("codes").take(pa.array(stored)).to_pylist()), np.uint8).reshape(len(stored), -1)
        error = rows.column("error").to_numpy()[stored]
        cuts, both = subspaces(x.shape[1]), (probes[stored][:, None, :] == home[asking][None, :, None]).any(2)
        pairs = []
        for a in range(0, len(asking), 256):
            q = asking[a : a + 256]
            rest = x[q] - c[at]
            d = np.zeros((len(q), len(stored)))
            for k, (s, w) in enumerate(zip(cuts, words, strict=True)):
                table = ((rest[:, None, s] - w[None]) ** 2).sum(2)
                d += table[:, codes[:, k]]
            i, j = np.nonzero(np.sqrt(d) <= reach + error[None])
            there = home[q[i]] == at
            once = np.where(there, node[q[i]] < node[stored[j]], (home[q[i]] < at) | ~both[j, a + i])
            i, j = q[i[once]], stored[j[once]]
            exact = (x[i] * x[j]).sum(1) >= least
            pairs.append((i[exact], j[exact]))
        i, j = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        if not len(i):
            return None
        n = np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
        seen = np.flatnonzero(n)
        src, dst = local_forest(node[i], node[j])
        other = np.full(len(seen) + len(src), -1, np.int64)
        return np.concatenate([node[seen], src]), np.concatenate([n[seen].astype(np.int64), np.zeros(len(src), np.int64)]), np.concatenate([other[: len(seen)], dst]), np.concatenate([np.zeros(len(seen), bool), np.ones(len(src), bool)])

    def emit(parts):
        found = solve(pa.Table.from_batches(parts))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], ["node", "n", "other", "link"])

    def run(batches):
        key, held = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in ("label", "list", "i", "j")), strict=True))
            begin = 0
            for r in range(1, len(keys) + 1):
                if r == len(keys) or keys[r] != keys[begin]:
                    if held and key != keys[begin]:
                        yield from emit(held)
                        held = []
                    key = keys[begin]
                    held.append(batch.slice(begin, r - begin))
                    begin = r
        if held:
            yield from emit(held)

    return run


def near_duplicates(vectors: DataFrame, *, least: float = 0.98, sample: int = 16_384, list_size: int = 1024, most_lists: int = 4096, probes: int = 8) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    low = -(1 << 63)
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good = good & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0)
    rows = vectors.select(F.coalesce("vec_id", F.lit(low)).alias("id"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"), F.coalesce(good, F.lit(False)).alias("good"))
    flat = F.transform("embedding", lambda v: v + 0.0)  # one zero
    rows = rows.withColumns({"h1": F.xxhash64(flat, "label"), "h2": F.xxhash64(F.lit(7), "label", flat)})
    usable = rows.where("good")
    classes = materialise(usable.groupBy("label", "h1", "h2").agg(F.min("id").alias("node"), F.count("*").alias("weight")), "classes")
    # a vector that a third of the rows repeat is one row here, and its rows stay where they are
    first = hot_join(usable.select("id", "label", "h1", "h2", "embedding"), classes, ["label", "h1", "h2"], "weight").where("id = node").dropDuplicates(["label", "h1", "h2"])
    reps = materialise(first.select("node", "weight", "label", "embedding"), "vectors")
    found = None
    for dims in sorted(r[0] for r in reps.select(F.size("embedding")).distinct().collect()):
        own = reps.where(F.size("embedding") == dims)
        part = _linked(own, dims, least, sample, list_size, most_lists, probes)
        found = part if found is None else found.unionByName(part)
    result = classes
    if found is None:
        result = result.withColumns({"n": F.lit(0), "component": F.col("node")})
    else:
        found = materialise(found, "found")
        count = found.where("not link").groupBy("node").agg(F.sum("n").alias("n"))
        joined = components(found.where("link").select("node", "other"))
        result = classes.join(count, "node", "left").join(joined, "node", "left")
    result = result.select("label", "h1", "h2", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    result = materialise(result, "classes")
    out = hot_join(rows.drop("embedding"), result, ["label", "h1", "h2"], "weight", "left").withColumn("c", F.when(F.col("good"), F.col("component")).otherwise(F.col("id")))
    return out.select("vec_id", F.when(F.col("good"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"), F.when(F.col("c") != low, F.col("c")).alias("component_id"), (F.col("id") == F.col("c")).alias("kept"))


def _linked(own: DataFrame, dims: int, least: float, sample: int, list_size: int, most_lists: int, probes: int) -> DataFrame:
    spark = own.sparkSession
    n = own.count()
    some = sampled(own, "node", sample).select("embedding").toArrow()  # at most `sample` vectors
    lists = int(min(max(1, n // list_size), most_lists))
    model = fit(unit(some.column(0).combine_chunks()), lists)
    index = own.mapInArrow(lean(_index(model, min(probes, lists))), "node long, weight long, label string, embedding array<double>, home int, probes array<int>, codes binary, error double")
    index = materialise(index, "index")
    sizes = index.groupBy("label", F.col("home").alias("list")).agg(F.count("*").alias("stored"))
    asked = index.select("*", F.explode("probes").alias("list"))
    asking = asked.groupBy("label", "list").agg(F.count("*").alias("asking")).join(sizes, ["label", "list"])
    blocks = asking.select("label", "list", F.ceil(F.col("stored") / BLOCK).alias("bi"), F.ceil(F.col("asking") / BLOCK).alias("bj"))
    keep = ["node", "weight", "embedding", "home", "probes", "codes", "error"]
    spread = lambda b: F.explode(F.sequence(F.lit(0).cast("long"), F.col(b) - 1))
    one = index.withColumn("list", F.col("home")).join(blocks, ["label", "list"])
    one = one.select("label", "list", F.pmod(F.xxhash64("node"), F.col("bi")).alias("i"), spread("bj").alias("j"), F.lit(0).alias("kind"), *keep)
    two = asked.join(blocks, ["label", "list"])
    two = two.select("label", "list", F.pmod(F.xxhash64("node"), F.col("bj")).alias("j"), spread("bi").alias("i"), F.lit(1).alias("kind"), *keep)
    both = one.unionByName(two).repartition(partitions(spark), "label", "list", "i", "j").sortWithinPartitions("label", "list", "i", "j")
    return both.mapInArrow(lean(_search(model, least)), "node long, n long, other long, link boolean")
