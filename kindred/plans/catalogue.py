"""The query catalogue: every operator on the driver's tables, with the same in DuckDB SQL where SQL has it.

Documents stand for methods (words for opcodes) and files, sign bits of embeddings for perceptual hashes, urls for archive
paths, event types for manifest entries.  Even ids are the left side, odd ids the right one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred import config
from kindred.functions import columns as C
from kindred.operators import attribution as A
from kindred.operators import matching as M
from kindred.operators import scoring as S

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows that lie in fewer files than there are cores are dealt out first, since work on texts is done where they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(table(spark, sf_dir, "documents"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as methods, with the side by parity."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), C.words(F.coalesce("text", F.lit(""))).alias("opcode_tokens"), "lang")
    t = F.col("opcode_tokens")
    return d.select(
        "ord", F.pmod("ord", F.lit(2)).alias("side"), "opcode_tokens", "lang",
        F.filter(t, lambda x: F.length(x) <= 2).alias("block_signature"), F.filter(t, lambda x: F.length(x) >= 9).alias("api_calls"),
        F.transform(t, lambda x: F.left(x, F.lit(1))).alias("constants"),
        F.size(t).cast("long").alias("instruction_count"), F.sha2(F.array_join(t, " ").cast("binary"), 256).alias("canonical_hash"),
    )


def sides(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("side = 0"), df.where("side = 1")


METHODS = r"""m as (select doc_id as ord, doc_id % 2 as side, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') as t, lang from documents),
    mh as (select *, len(t)::bigint as n, sha256(array_to_string(t, ' ')) as h from m)"""
EXACT = METHODS + r""",
    rk as (select *, row_number() over (partition by side, h order by ord) as k from mh),
    ex as (select a.ord as l, b.ord as r, a.n as l_n, b.n as r_n, a.h as key from rk a join rk b on a.h = b.h and a.k = b.k and a.side = 0 and b.side = 1)"""
SHINGLES = METHODS + r""",
    sh as (select ord, side, case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, chr(31))] else list_distinct(list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i : i + 4], chr(31)))) end as s from m)"""
CANDIDATES = SHINGLES + r""",
    po as (select ord, side, unnest(s) as g from sh),
    rare as (select g from po where side = 1 group by g having count(*) <= 200),
    ca as (select a.ord as l, b.ord as r, count(*) as shared from po a join po b on a.g = b.g and a.side = 0 and b.side = 1 where a.g in (select g from rare) group by all)"""


def dimension_sql(policy: str, row: str) -> str:
    """finalize() over a row (matched, n_matched, l_mass, l_n, r_mass, r_n)."""
    score = "case when l_mass + r_mass > 0 then least(matched * 200 / (l_mass + r_mass), 100.0) else 0.0 end"
    cover = {s: f"case when {s}_mass > 0 then least(matched / {s}_mass, 1.0) else {{e}} end" for s in "lr"}
    both, one = "l_n = 0 and r_n = 0", "l_n = 0 or r_n = 0"
    if policy == "methods":
        parts = f"case when {both} then null else {score} end", *[f"case when {one} then 0.0 else {cover[s].format(e='0.0')} end" for s in "lr"], "1.0"
    elif policy == "files":
        parts = f"case when {both} then 100.0 else {score} end", *[f"case when {both} then 1.0 else {cover[s].format(e='1.0')} end" for s in "lr"], "1.0"
    else:
        parts = f"case when {one} then null else {score} end", *[f"case when {one} then 0.0 else {cover[s].format(e='0.0')} end" for s in "lr"], f"case when {one} then 0.0 else 1.0 end"
    names = ("score", "left_coverage", "right_coverage", "confidence")
    return f"select *, {', '.join(f'({p})::double as {n}' for p, n in zip(parts, names))} from ({row})"


def greedy_sql(edges: str, turn: str, *, cap: int = 1 << 30, threshold: float = 0.0) -> str:
    """One to one: left rows choose in the order of `turn`, each of its first `cap` edges by pref and r whose right is free
    the most similar.  edges: CTEs that end with e(l, r, pref, sim, <what turn needs>)."""
    return f"""with recursive {edges},
    listed as materialized (select l, row_number() over (order by turn) as k, es from (select l, min(turn) as turn, list({{'r': r, 'sim': sim}} order by pref desc, r) as es from (select *, {turn} as turn from e) group by l) q),
    g(k, l, used, best) as (select 0::bigint, null::bigint, []::bigint[], null::struct(sim double, k bigint, r bigint) union all
        select k, l, case when best is null then used else list_append(used, best.r) end, best from (select listed.k, listed.l, g.used,
            list_reverse_sort(list_filter(list_transform(list_filter(es, lambda x: not list_contains(g.used, x.r))[1:{cap}], lambda x, i: {{'sim': x.sim, 'k': -i, 'r': x.r}}), lambda x: x.sim >= {threshold}))[1] as best from g join listed on listed.k = g.k + 1)),
    won as (select l, best.r as r, best.sim as sim from g where best is not null)"""


# --- matching ------------------------------------------------------------------------------------------------------


@query(f"with {EXACT} select l, r, key from ex")
def q_exact_match(spark, sf_dir):
    """JN-01, WIN-01."""
    return M.exact_match(*sides(methods(spark, sf_dir)), "canonical_hash")


def dimension(pairs: DataFrame, left: DataFrame, right: DataFrame, weight: str, policy: str) -> DataFrame:
    a, b = left.select(F.col("ord").alias("l"), F.col(weight).alias(f"l_{weight}")), right.select(F.col("ord").alias("r"), F.col(weight).alias(f"r_{weight}"))
    return S.finalize(S.mass(pairs.withColumn("sim", F.lit(1.0)).join(a, "l").join(b, "r"), left, right, weight), policy)


MASS = "select (select coalesce(sum(least(l_n, r_n)), 0)::double from ex{w}) as matched, (select count(*) from ex{w}) as n_matched, (select coalesce(sum(n), 0)::double from mh where side = 0{a}) as l_mass, (select count(*) from mh where side = 0{a}) as l_n, (select coalesce(sum(n), 0)::double from mh where side = 1{a}) as r_mass, (select count(*) from mh where side = 1{a}) as r_n"


@query(f"with {EXACT} {dimension_sql('methods', MASS.format(w='', a=''))}")
def q_exact_dimension(spark, sf_dir):
    """AGG-01: the flagship."""
    left, right = sides(methods(spark, sf_dir))
    return dimension(M.exact_match(left, right, "canonical_hash"), left, right, "instruction_count", "methods")


@query(f"with {EXACT} {dimension_sql('methods', MASS.format(w=' where l_n >= 100', a=' and n >= 100'))}")
def q_long_subset_dimension(spark, sf_dir):
    """PRJ-20: long methods are matched anew."""
    left, right = sides(methods(spark, sf_dir).where("instruction_count >= 100"))
    return dimension(M.exact_match(left, right, "canonical_hash"), left, right, "instruction_count", "methods")


def files(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    content = F.coalesce("text", F.lit("")).cast("binary")
    norm = F.sha2(F.array_join(C.words(F.coalesce("text", F.lit(""))), " ").cast("binary"), 256)
    return d.select(F.col("doc_id").alias("ord"), F.pmod("doc_id", F.lit(2)).alias("side"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(content).cast("long").alias("size"), F.sha2(content, 256).alias("sha256"), norm.alias("semantic_hash"), "source")


FILES = """f as (select doc_id as ord, doc_id % 2 as side, source, octet_length(encode(coalesce(text, '')))::bigint as n, sha256(coalesce(text, '')) as h from documents),
    mh as (select * from f), rk as (select *, row_number() over (partition by side, h order by ord) as k from f),
    ex as (select a.ord as l, b.ord as r, a.n as l_n, b.n as r_n, a.source <> b.source as renamed from rk a join rk b on a.h = b.h and a.k = b.k and a.side = 0 and b.side = 1)"""


@query(f"with {FILES} select *, (select count(*) from ex where renamed) as renamed_matches from ({dimension_sql('files', MASS.format(w='', a=''))})")
def q_file_dimension(spark, sf_dir):
    """AGG-02, AGG-17: files by content, weighed by bytes."""
    left, right = sides(files(spark, sf_dir))
    pairs = M.exact_match(left, right, "sha256")
    renamed = pairs.join(left.select(F.col("ord").alias("l"), F.col("source").alias("a")), "l").join(right.select(F.col("ord").alias("r"), F.col("source").alias("b")), "r").agg(F.count_if(F.col("a") != F.col("b")).alias("renamed_matches"))
    return dimension(pairs, left, right, "size", "files").crossJoin(renamed)


@query(
    greedy_sql(
        r"""f as (select doc_id as ord, doc_id % 2 as side, sha256(coalesce(text, '')) as h, sha256(array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> ''), ' ')) as s from documents),
        e as (select a.ord as l, b.ord as r, 0 as pref, 1.0::double as sim from f a join f b on a.side = 0 and b.side = 1 and a.s = b.s where a.h = b.h or a.h not in (select h from f where side = 1))""",
        "l",
    )
    + " select l, r, sim from won"
)
def q_file_match_two_key(spark, sf_dir):
    """JN-03: content, else semantic hash; one to one."""
    return M.match_files(*sides(files(spark, sf_dir)))


@query(f"with {SHINGLES} select ord, len(s)::bigint as n_shingles from sh")
def q_shingle_counts(spark, sf_dir):
    """FN-21."""
    return methods(spark, sf_dir).select("ord", F.size(C.shingles(F.col("opcode_tokens"))).cast("long").alias("n_shingles"))


@query(f"with {CANDIDATES} select * from ca")
def q_inverted_candidates(spark, sf_dir):
    """JN-02b, SRT-07."""
    return M.inverted_candidates(*sides(methods(spark, sf_dir)), C.shingle_hashes(F.col("opcode_tokens")))


def minhash_sql(permutations: int) -> str:
    rows = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(map(M.permutation, range(permutations))))
    return f"""{SHINGLES}, g as (select ord, side, ('0x' || substr(md5(unnest(s)), 1, 8))::bigint & 2147483647 as x from sh), p(i, a, b) as (values {rows}),
    h as (select ord, side, i, min((x * a + b) % {M.PRIME})::bigint as h from g, p group by all)"""


@query(f"with {minhash_sql(128)} select ord, i::int as i, h from h")
def q_minhash_signature(spark, sf_dir):
    """AGG-20."""
    return M.minhash(methods(spark, sf_dir), C.shingles(F.col("opcode_tokens")), 128)


@query(
    f"""with {minhash_sql(126)},
    b as (select ord, side, i // 6 as band, string_agg(h::varchar, ',' order by i) as key from h group by all)
    select distinct a.ord as l, c.ord as r from b a join b c on a.band = c.band and a.key = c.key and a.side = 0 and c.side = 1"""
)
def q_lsh_candidates(spark, sf_dir):
    """JN-02a: 21 bands of 6 rows, the best for a threshold of 0.55 with 128 permutations."""
    return M.lsh_candidates(*sides(methods(spark, sf_dir)), C.shingles(F.col("opcode_tokens")), parameters=(21, 6))


JACCARD = "case when len({a}) = 0 and len({b}) = 0 then 1.0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end"


def _run(column: str, width: int) -> str:
    return f"case when len({column}) = 0 then [] when len({column}) < {width} then [array_to_string({column}, chr(31))] else list_distinct(list_transform(range(1, len({column}) - {width - 2}), lambda i: array_to_string({column}[i : i + {width - 1}], chr(31)))) end"


SCORED = (
    CANDIDATES
    + f""",
    pt as (select ord, s, list_distinct(list_filter(t, lambda x: length(x) <= 2)) as b, list_filter(t, lambda x: length(x) >= 9) as a, list_distinct(list_transform(t, lambda x: x[1])) as c from m join sh using (ord)),
    pu as (select ord, s, b, c, {_run("a", 2)} as a from pt),
    sm as (select l, r, shared, ({JACCARD.format(a="x.s", b="y.s")} * 0.45 + {JACCARD.format(a="x.b", b="y.b")} * 0.25 + {JACCARD.format(a="x.a", b="y.a")} * 0.20 + {JACCARD.format(a="x.c", b="y.c")} * 0.10) as sim from ca join pu x on x.ord = l join pu y on y.ord = r),
    sc as (select l, r, shared, floor(sim * 1e6 + 0.5)::bigint as millionths from sm)"""
)


MILLIONTHS = "cast(floor(sim * 1e6 + 0.5) as long) as millionths"
#: As SCORED, of shingles that any number of right rows have.
EVERY = SCORED.replace(CANDIDATES.removeprefix(SHINGLES), """,
    po as (select ord, side, unnest(s) as g from sh),
    ca as (select a.ord as l, b.ord as r, count(*) as shared from po a join po b on a.g = b.g and a.side = 0 and b.side = 1 group by all)""")


@query(f"with {EVERY} select * from sc")
def q_pair_similarity(spark, sf_dir):
    """FN-22, FN-23."""
    return M.similarities(*sides(methods(spark, sf_dir))).selectExpr("l", "r", "shared", MILLIONTHS)


@query(f"with {SCORED} select l, r, shared, millionths from (select *, row_number() over (partition by l order by shared desc, r) as k from sc) where k <= 30 qualify row_number() over (partition by l order by millionths desc, k) = 1")
def q_best_candidate_per_left(spark, sf_dir):
    """WIN-02: of the 30 with most shared shingles the most similar."""
    left, right = sides(methods(spark, sf_dir))
    index = M.shingle_index(left, right, C.shingle_hashes(F.col("opcode_tokens")))
    pairs = M.rare_pairs(index).withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("shared"), "r"))).where("k <= 30")
    top = M.compared(pairs, left, right, index).selectExpr("l", "r", "shared", "k", MILLIONTHS)
    return top.groupBy("l").agg(F.max_by(F.struct("r", "shared", "millionths"), F.struct("millionths", F.negative("k"))).alias("x")).select("l", "x.r", "x.shared", "x.millionths")


FUZZY = EXACT + ", lo as (select * from m where ord not in (select l from ex union select r from ex))" + SHINGLES.removeprefix(METHODS).replace("from m)", "from lo)") + SCORED.removeprefix(SHINGLES)


@query(
    greedy_sql(FUZZY + ", e as (select sm.*, shared as pref, {'a': -least(n, 4194303), 'b': l} as first from sm join mh on ord = l)", "first", cap=30, threshold=0.70)
    + " select l, r, floor(sim * 1e6 + 0.5)::bigint as millionths, 'fuzzy' as stage from won union all select l, r, 1000000, 'exact' from ex"
)
def q_fuzzy_match_1to1(spark, sf_dir):
    """JN-02, JN-02c, SRT-08: exact, then fuzzy with cap and threshold, longest first, one to one."""
    found = M.match_methods(*sides(methods(spark, sf_dir)), lsh=False)
    return found.select("l", "r", F.floor(F.col("sim") * 1e6 + 0.5).cast("long").alias("millionths"), "stage")


def images(spark, sf_dir) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    bits = F.aggregate(F.zip_with("embedding", F.sequence(F.lit(0), F.size("embedding") - 1), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.lit(0).cast("long"), lambda acc, p: acc.bitwiseOR(F.when(p.x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), p.i)).otherwise(F.lit(0).cast("long"))))
    return v.select(F.col("vec_id").alias("ord"), F.pmod("vec_id", F.lit(2)).alias("side"), bits.alias("bits"), F.col("label").cast("long").alias("size"))


HAMMING = "select a.vec_id as l, b.vec_id as r, list_sum(list_transform(range(1, 65), lambda i: case when (a.embedding[i] >= 0) <> (b.embedding[i] >= 0) then 1 else 0 end))::int as distance from embeddings a, embeddings b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1"


@query(f"select * from ({HAMMING}) where distance <= 20")
def q_hamming_banded(spark, sf_dir):
    """FN-06, JN-04: blocks with their neighbours lose no pair within 20 bits."""
    return M.hamming_pairs(*sides(images(spark, sf_dir)), most=20)


@query(f"select distance, count(*) as n from ({HAMMING}) where distance <= 10 group by all")
def q_hamming_default(spark, sf_dir):
    """JN-04 at the product's threshold."""
    return M.hamming_pairs(*sides(images(spark, sf_dir)), most=10).groupBy("distance").agg(F.count("*").alias("n"))


@query(greedy_sql(f"e as (select l, r, 0 as pref, (1.0 - distance / 64.0)::double as sim from ({HAMMING}) where distance <= 20)", "l", threshold=44 / 64) + " select * from won")
def q_image_match_1to1(spark, sf_dir):
    """JN-04, AGG-03: one to one within 20 bits."""
    found = M.match_hashes(*sides(images(spark, sf_dir)), most=20)
    return found.select("l", "r", (1.0 - F.col("distance") / 64).alias("sim"))


# --- sets and multisets ----------------------------------------------------------------------------------------------


@query(
    """with s as (select p_partkey % 2 as side, p_brand || '#' || p_size as v from part), a as (select distinct v from s where side = 0), b as (select distinct v from s where side = 1),
    n as (select (select count(*) from a) as l_n, (select count(*) from b) as r_n, (select count(*) from a join b using (v)) as n_matched)
    select *, (case when l_n + r_n = 0 then 100.0 else n_matched * 200.0 / (l_n + r_n) end)::double as score, (case when l_n = 0 then 1.0 else n_matched::double / l_n end)::double as left_coverage, (case when r_n = 0 then 1.0 else n_matched::double / r_n end)::double as right_coverage from n"""
)
def q_set_dimension_brand(spark, sf_dir):
    """AGG-04, JN-05."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey % 2 as side", "p_brand || '#' || p_size as v")
    return S.set_score(p.where("side = 0").select("v"), p.where("side = 1").select("v"))


def entries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(2)).alias("side"), F.col("event_type").alias("value"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(5)).cast("string")).alias("source_path"))
    return sides(e)


ENTRIES = "e as (select event_id % 2 as side, event_type as value, 'u' || user_id % 5 as source_path from events), c as (select side, value, count(*) as n, array_to_string(list_sort(list_distinct(list(source_path))), ',') as p from e group by all)"


@query(f"with {ENTRIES} select a.value, least(a.n, b.n) as occurrences, a.p as left_source_paths, b.p as right_source_paths from c a join c b on a.value = b.value and a.side = 0 and b.side = 1")
def q_multiset_events(spark, sf_dir):
    """JN-06, SET-03."""
    m = S.multiset_matches(*entries(spark, sf_dir))
    return m.select("value", "occurrences", *[F.array_join(c, ",").alias(c) for c in ("left_source_paths", "right_source_paths")])


@query(
    f"with {ENTRIES}, r as (select coalesce((select sum(least(a.n, b.n)) from c a join c b on a.value = b.value and a.side = 0 and b.side = 1), 0)::double as matched, (select count(*) from c a join c b on a.value = b.value and a.side = 0 and b.side = 1) as n_matched, (select count(*)::double from e where side = 0) as l_mass, (select count(*) from e where side = 0) as l_n, (select count(*)::double from e where side = 1) as r_mass, (select count(*) from e where side = 1) as r_n) {dimension_sql('owned', 'select * from r')}"
)
def q_multiset_dimension(spark, sf_dir):
    """JN-06, AGG-18."""
    return S.multiset_score(*entries(spark, sf_dir))


PAIR = "select event_type, user_id % 10 as bucket from events where event_id % 2 = {p}"


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id"), "event_type", F.pmod("user_id", F.lit(10)).alias("bucket"))
    return [e.where(F.pmod("event_id", F.lit(2)) == k).drop("event_id") for k in (0, 1)]


@query(f"select event_type, bucket, count(*) as n from ({PAIR.format(p=0)} intersect all {PAIR.format(p=1)}) group by all")
def q_intersect_all(spark, sf_dir):
    """SET-02, SET-03."""
    a, b = _pairs(spark, sf_dir)
    return a.intersectAll(b).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query(f"select event_type, bucket, count(*) as n from ({PAIR.format(p=0)} except all {PAIR.format(p=1)}) group by all")
def q_except_all(spark, sf_dir):
    """SET-05, SET-06."""
    a, b = _pairs(spark, sf_dir)
    return a.exceptAll(b).groupBy("event_type", "bucket").agg(F.count("*").alias("n"))


@query(f"{PAIR.format(p=0)} union {PAIR.format(p=1)}")
def q_union_distinct(spark, sf_dir):
    """SET-04."""
    a, b = _pairs(spark, sf_dir)
    return a.unionByName(b).distinct()


@query("select l.doc_id, array_to_string(list_sort(list_intersect(w, ['the', 'of', 'and', 'de', 'la'])), ',') as common, len(list_filter(['the', 'of'], lambda x: not list_contains(w, x)))::int as missing, len(list_filter(['the', 'of'], lambda x: not list_contains(w, x))) = 0 as covers from (select doc_id, list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) as w from documents) l")
def q_array_sets(spark, sf_dir):
    """SET-01, SET-07."""
    d = table(spark, sf_dir, "documents").select("doc_id", C.words(F.coalesce("text", F.lit(""))).alias("w"))
    known, need = F.array(*map(F.lit, ("the", "of", "and", "de", "la"))), F.array(F.lit("the"), F.lit("of"))
    left = F.size(F.array_except(need, F.col("w")))
    return d.select("doc_id", F.array_join(F.array_sort(F.array_intersect("w", known)), ",").alias("common"), left.alias("missing"), (left == 0).alias("covers"))


# --- scores --------------------------------------------------------------------------------------------------------------


def _dimension_rows(spark, sf_dir, drop: str | None = None) -> DataFrame:
    p = table(spark, sf_dir, "part")
    keys = list(config.WEIGHTS)
    row = p.agg(*[(F.count_if(F.col("p_size") % 8 == i) * 800 / F.count("*")).alias(k) for i, k in enumerate(keys)])
    flat = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.when(F.lit(k != drop), F.least(F.floor(F.col(k)).cast("double"), F.lit(100.0))).alias("score")) for k in keys])).alias("x"))
    return flat.select("x.key", "x.score")


def _aggregate_sql(drop: str | None = None) -> str:
    rows = ", ".join(f"('{k}', {i}, {w})" for i, (k, w) in enumerate(config.WEIGHTS.items()))
    levels = ", ".join(f"('{k}', {v})" for k, v in config.LEVELS.items())
    return f"""with d as (select key, i, w, case when key = '{drop}' then null else least(floor((select count(*) filter (where p_size % 8 = i) * 800 / count(*) from part))::double, 100.0) end as score from (values {rows}) v(key, i, w)),
    a as (select floor(coalesce(sum(w * score / 100), 0.0) * 100 + 0.5) / 100 as minimum, coalesce(sum(w) filter (where score is not null), 0)::bigint as analyzed_weight, coalesce(sum(w) filter (where score is null), 0) as missing from d),
    b as (select minimum, floor((minimum + missing) * 100 + 0.5) / 100 as maximum, analyzed_weight, case when missing = 0 then minimum end as score from a)
    select score, minimum, maximum, analyzed_weight, case when score is not null then (select l from (values {levels}) v(l, t) order by t <= score desc, t desc limit 1) end as level from b"""


@query(_aggregate_sql())
def q_weighted_aggregate(spark, sf_dir):
    """AGG-06, AGG-07."""
    return S.aggregate(_dimension_rows(spark, sf_dir))


@query(_aggregate_sql("images"))
def q_missing_interval(spark, sf_dir):
    """AGG-06: a missing dimension leaves an interval."""
    return S.aggregate(_dimension_rows(spark, sf_dir, "images"))


def _empty_sql() -> str:
    out = []
    for policy in ("methods", "files", "owned"):
        for case, a, b in (("both", 0, 0), ("left", 0, 1), ("right", 1, 0), ("none", 1, 1)):
            row = f"select 0.0::double as matched, 0::bigint as n_matched, coalesce(sum(p_size) filter (where {a} = 1), 0)::double as l_mass, count(*) filter (where {a} = 1) as l_n, coalesce(sum(p_size) filter (where {b} = 1), 0)::double as r_mass, count(*) filter (where {b} = 1) as r_n from part"
            out.append(f"select '{policy}' as policy, '{case}' as \"case\", score, left_coverage, right_coverage, confidence from ({dimension_sql(policy, row)})")
    return " union all ".join(out)


@query(_empty_sql())
def q_empty_policies(spark, sf_dir):
    """AGG-18: what an empty side means, by operator."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_size").cast("long").alias("size"))
    none = p.where("false")
    out = None
    for policy in ("methods", "files", "owned"):
        for case, a, b in (("both", none, none), ("left", none, p), ("right", p, none), ("none", p, p)):
            pairs = none.select(F.col("size").alias("l_size"), F.col("size").alias("r_size"), F.lit(1.0).alias("sim"))
            row = S.finalize(S.mass(pairs, a, b, "size"), policy).select(F.lit(policy).alias("policy"), F.lit(case).alias("case"), "score", "left_coverage", "right_coverage", "confidence")
            out = row if out is None else out.unionByName(row)
    return out


@query("select lang, (case when count(*) filter (where doc_id % 3 = 0) = 0 then 0.0 else avg(case when doc_id % 2 = 0 then 0.75 else 0.5 end) filter (where doc_id % 3 = 0) end)::double as confidence, least(0.75, 0.5, 1.0)::double as merged, (case when count(*) <= 0 then 1.0 else least(greatest(count(*) filter (where doc_id % 4 <> 0)::double / count(*), 0.0), 1.0) end)::double as resources from documents group by all")
def q_confidences(spark, sf_dir):
    """AGG-05, AGG-15, AGG-16."""
    d = table(spark, sf_dir, "documents")
    one = F.when(F.col("doc_id") % 3 == 0, F.when(F.col("doc_id") % 2 == 0, 0.75).otherwise(0.5))
    row = d.groupBy("lang").agg(F.coalesce(F.avg(one), F.lit(0.0)).alias("confidence"), F.count("*").alias("n"), F.count_if(F.col("doc_id") % 4 != 0).alias("covered"))
    return row.select("lang", "confidence", F.least(F.lit(0.75), F.lit(0.5), F.lit(1.0)).alias("merged"), S.resource_confidence(F.col("n"), F.col("covered")).alias("resources"))


# --- classification ------------------------------------------------------------------------------------------------------

PATH = """case page_id % 8 when 0 then 'base/res/drawable-hdpi/' || page_id || '.PNG' when 1 then 'base/res/layout/abc_' || page_id || '.xml' when 2 then 'feature/assets/nim/' || page_id || '.bin' when 3 then 'base/lib/arm64-v8a/lib' || page_id || '.so'
    when 4 then 'META-INF/' || page_id || '.SF' when 5 then 'BundleConfig.pb' when 6 then 'base/res/drawable/$Icon__' || page_id || '.9.png' else 'base/assets/' || page_id end"""


def paths(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.expr(PATH).alias("path"))


@query(
    f"""select page_id, case when n >= 3 and s[2] = 'res' then case when x in ('.png', '.jpg', '.jpeg', '.webp', '.gif', '.bmp') then 'image' else 'resource' end when n >= 3 and s[2] = 'assets' then 'asset' when n >= 4 and s[2] = 'lib' and x = '.so' then 'native'
    when path = 'BundleConfig.pb' or starts_with(path, 'BUNDLE-METADATA/') or starts_with(path, 'META-INF/') then 'build' end as category, case when s[1] in ('BundleConfig.pb', 'BUNDLE-METADATA', 'META-INF') then 'bundle' else s[1] end as module
    from (select page_id, path, string_split(path, '/') as s, len(string_split(path, '/')) as n, lower(regexp_extract(path, '[^/.][^/]*(\\.[^./]+)$', 1)) as x from (select page_id, {PATH} as path from pages))"""
)
def q_category_dispatch(spark, sf_dir):
    """PRJ-01, PRJ-02, PRJ-03."""
    return paths(spark, sf_dir).select("page_id", C.category(F.col("path")).alias("category"), C.module(F.col("path")).alias("module"))


def _any(column: str, prefixes) -> str:
    return "(" + " or ".join(f"starts_with({column}, '{p}')" for p in prefixes) + ")"


@query(
    f"""with p as (select page_id, {PATH} as path from pages), n as (select page_id, path, lower(path) as low, regexp_replace(ltrim(lower(split_part(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.9\\.png$', ''), '.', 1)), '$'), '__\\d+$', '') as name, case page_id % 8 when 2 then 'asset' when 7 then 'asset' when 3 then 'native' else 'resource' end as kind from p)
    select page_id, name, case when kind = 'native' then 'PUBLIC_DEPENDENCY' when kind = 'asset' then case when {_any("case when instr(low, '/assets/') > 0 then substr(low, instr(low, '/assets/') + 8) else low end", config.PUBLIC_ASSET_PREFIXES)} then 'PUBLIC_DEPENDENCY' else 'HEURISTIC_OWNED' end
    when {_any("name", config.TOOL_RESOURCE_PREFIXES)} then 'TOOL_GENERATED' when {_any("name", config.PUBLIC_RESOURCE_PREFIXES)} then 'PUBLIC_DEPENDENCY' else 'HEURISTIC_OWNED' end as origin from n"""
)
def q_file_origin(spark, sf_dir):
    """PRJ-10, PRJ-11."""
    kind = F.expr("case page_id % 8 when 2 then 'asset' when 7 then 'asset' when 3 then 'native' else 'resource' end")
    return paths(spark, sf_dir).select("page_id", C.resource_name(F.col("path")).alias("name"), C.file_origin(F.col("path"), kind).alias("origin"))


CLASS = """case p_partkey % 7 when 0 then 'Lcom/google/x' || p_partkey || ';' when 1 then 'Lcom/app/R$id;' when 2 then 'Lapp/main/' || p_partkey || ';' when 3 then 'Lcom/app/databinding/A' || p_partkey || 'Binding;' when 4 then 'Lokio/B' || p_partkey || ';' when 5 then 'Lorg/acme/Foo_Factory;' else 'Lcom/app/Manifest;' end"""


def classes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.expr(CLASS).alias("class_name"), (F.col("p_size") > 45).alias("third_party"), F.col("p_size").cast("long").alias("instruction_count"))


LADDER = f"""c as (select p_partkey as ord, {CLASS} as class_name, p_size > 45 as third_party, p_size::bigint as instruction_count from part),
    o as (select ord, case when regexp_matches(class_name, '{config.HEURISTIC_GENERATED_CLASS}') then 'TOOL_GENERATED' when starts_with(class_name, 'Lapp/main/') then 'HEURISTIC_OWNED' when {_any("class_name", config.THIRD_PARTY_PREFIXES)} or third_party then 'PUBLIC_DEPENDENCY' else 'HEURISTIC_OWNED' end as origin,
    case when regexp_matches(class_name, '{config.HEURISTIC_GENERATED_CLASS}') then null when starts_with(class_name, 'Lapp/main/') then 0.75 when {_any("class_name", config.THIRD_PARTY_PREFIXES)} or third_party then null else 0.45 end::double as confidence from c)"""


@query(f"with {LADDER} select ord, origin, confidence from o")
def q_method_ladder(spark, sf_dir):
    """PRJ-09."""
    x = C.method_origin(F.col("class_name"), F.col("third_party"), ("Lapp/main/",), config.THIRD_PARTY_PREFIXES)
    return classes(spark, sf_dir).select("ord", x.alias("x")).select("ord", "x.origin", "x.confidence")


@query(f"with {LADDER} select {', '.join(f'''count(*) filter (where coalesce(origin, 'UNRESOLVED') = '{k}') as {k.lower()}''' for k in config.ORIGINS)} from o")
def q_attribution_summary(spark, sf_dir):
    """AGG-09."""
    return S.attribution_summary(q_method_ladder(spark, sf_dir), config.ORIGINS)


@query(f"with {LADDER} select count(*) as candidate_methods, count(*) filter (where not third_party) as methods, count(*) filter (where not third_party and instruction_count >= 20) as long_methods from c")
def q_method_counts(spark, sf_dir):
    """AGG-10: candidates, those that are no third party's, and the long ones of these."""
    return S.method_counts(classes(spark, sf_dir), config.Config(long_method_min_instructions=20))


@query("select source as source_path, count(*) as n from documents where source is not null group by all")
def q_source_counts(spark, sf_dir):
    """AGG-08: rows of each source file."""
    return S.source_counts(table(spark, sf_dir, "documents").select(F.col("source").alias("source_path")))


@query("select coalesce(nullif(source, 'src0'), 'UNRESOLVED') as origin, count(*) as n from documents group by all")
def q_origin_counts(spark, sf_dir):
    """AGG-08."""
    return S.origin_counts(table(spark, sf_dir, "documents").select(F.nullif("source", F.lit("src0")).alias("origin")))


@query(f"with {LADDER} select ord, third_party or regexp_matches(class_name, '{config.GENERATED_CLASS}') or starts_with(class_name, 'Lorg/acme/') or starts_with(class_name, 'Lapp/main/') as third_party from c")
def q_classify_methods(spark, sf_dir):
    """PRJ-05, PRJ-06, PRJ-07."""
    deps = spark.createDataFrame([("org.acme:core:1.0",), ("app.main:x:2",), ("plain:y:1",), ("no coordinates",)], "dependency string")
    return A.classify_methods(classes(spark, sf_dir), deps).select("ord", "third_party")


@query("with p as (select distinct lower(left(n_name, 3)) as prefix from nation union select distinct left(p_name, 4) from part where p_size < 3) select p_partkey, p_name from part where exists (select 1 from p where starts_with(p_name, prefix))")
def q_prefix_join(spark, sf_dir):
    """JN-16: a prefix join as an equi-join."""
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    prefixes = n.select(F.lower(F.left("n_name", F.lit(3))).alias("prefix")).union(p.where("p_size < 3").select(F.left("p_name", F.lit(4))))
    return A.prefix_join(p.select("p_partkey", "p_name"), "p_name", prefixes)


@query(f"with {LADDER} select p as dependency from (values ('com.google', 'Lcom/google/'), ('okio', 'Lokio/'), ('kotlin', 'Lkotlin/')) v(p, x) where exists (select 1 from c where starts_with(class_name, x))")
def q_implicit_dependencies(spark, sf_dir):
    """FN-27."""
    return A.implicit_dependencies(classes(spark, sf_dir), ("Lcom/google/", "Lokio/", "Lkotlin/"))


@query(
    f"""select page_id, (instr(url, '://') > 0 and len(list_intersect(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.'), ['sentry', 'example2', {", ".join(repr(x) for x in config.PUBLIC_HOST_LABELS)}])) > 0) or {_any("'L' || replace(url, '.', '/')", config.THIRD_PARTY_PREFIXES)} as public
    from (select page_id, case page_id % 3 when 0 then url when 1 then replace(url, 'example', 'Sentry') else 'com.google.x' || page_id end as url from pages)"""
)
def q_host_labels(spark, sf_dir):
    """PRJ-12."""
    p = table(spark, sf_dir, "pages").select("page_id", F.expr("case page_id % 3 when 0 then url when 1 then replace(url, 'example', 'Sentry') else 'com.google.x' || page_id end").alias("url"))
    return p.select("page_id", C.public_dotted(F.col("url"), config.THIRD_PARTY_PREFIXES).alias("public"))


@query(
    """with e as (select p_partkey, case p_partkey % 3 when 0 then 'com.google.' when 1 then 'android.' else 'app.x.' end || p_partkey as name from part),
    a as (select 0 as kind, 'activity' as tag, name from e union all select 1, 'action', name from e where not starts_with(name, 'android.') union all select 2, 'permission', name from e where not starts_with(name, 'android.'))
    select tag || ':name=' || name as value, 'HEURISTIC_OWNED' as origin, 'aab://base/manifest/AndroidManifest.xml' as source_path from a where not starts_with(name, 'com.google.') and not starts_with(name, 'android.')"""
)
def q_manifest_entries(spark, sf_dir):
    """PRJ-13."""
    p = table(spark, sf_dir, "part").select(F.lit("base").alias("module"), F.expr("case p_partkey % 3 when 0 then 'com.google.' when 1 then 'android.' else 'app.x.' end || p_partkey").alias("name"))
    one = p.select("module", F.array(F.struct(F.lit("activity").alias("tag"), "name")).alias("components"), F.array("name").alias("actions"), F.array("name").alias("permissions"))
    return A.manifest_entries(one, config.THIRD_PARTY_PREFIXES)[0]


# --- provenance ----------------------------------------------------------------------------------------------------------


@query("select l_orderkey as key, min(l_returnflag) as origin, min(l_linestatus) as source_path, min((l_suppkey % 3)::varchar) as module from lineitem group by l_orderkey having count(distinct l_returnflag || '|' || l_linestatus || '|' || l_suppkey % 3) = 1")
def q_unique_owner(spark, sf_dir):
    """JN-07."""
    x = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_returnflag").alias("origin"), F.col("l_linestatus").alias("source_path"), F.pmod("l_suppkey", F.lit(3)).cast("string").alias("module"))
    return A.unique_owner(x, "key")


@query(
    """with m as (select l_orderkey, 'La' || o_custkey || case when l_linenumber % 2 = 0 then '$B' || l_linenumber || '$C;' else ';' end as original, l_orderkey as output from lineitem join orders on l_orderkey = o_orderkey),
    w as (select 'La' || c_custkey || ';' as identifier, c_mktsegment as origin, 'p' || c_nationkey as source_path from customer where c_custkey % 4 <> 0 union all select 'La' || c_custkey || ';', 'OTHER', 'q' from customer where c_custkey % 9 = 0),
    u as (select identifier, min(origin) as origin, min(source_path) as source_path from w group by all having count(distinct origin || '|' || source_path) = 1),
    f as (select distinct original, u.* from m left join u on u.identifier = regexp_replace(original, '\\$.*$', ';')),
    p as (select output, count(*) as n, count(origin) as k, min(origin || '|' || source_path) as lo, max(origin || '|' || source_path) as hi, min(origin) as origin, min(source_path) as source_path from (select distinct output, original from m) left join f using (original) group by output)
    select o_orderkey as ord, case when n = k and lo = hi then origin else 'UNRESOLVED' end as origin, case when n = k and lo = hi then source_path end as source_path from orders left join p on output = o_orderkey"""
)
def q_r8_attribution(spark, sf_dir):
    """JN-07, JN-08: every original class must resolve, all to one owner; nested classes to their outer ones."""
    li, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    nested = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("$B"), F.col("l_linenumber").cast("string"), F.lit("$C;"))).otherwise(";")
    mapping = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").cast("string").alias("output"), F.concat(F.lit("La"), F.col("o_custkey").cast("string"), nested).alias("original")).distinct()
    name = F.concat(F.lit("La"), F.col("c_custkey").cast("string"), F.lit(";")).alias("identifier")
    own = c.where("c_custkey % 4 <> 0").select(name, F.col("c_mktsegment").alias("origin"), F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("source_path"))
    own = own.union(c.where("c_custkey % 9 = 0").select(name, F.lit("OTHER"), F.lit("q"))).withColumns({"category": F.lit("code"), "module": F.lit("m")})
    return A.attribute_methods(o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("class_name")), mapping, own)


@query("select user_id, arg_max(event_type, event_id) as event_type, max(event_id) as event_id from events group by all")
def q_last_writer_wins(spark, sf_dir):
    """AGG-12, JN-09, JN-10."""
    return A.last_writer(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], "event_id").select("user_id", "event_type", "event_id")


@query("select o_orderkey, case when o_orderkey % 2 = 0 and c_custkey is not null then c_mktsegment else o_orderstatus end as origin from orders left join (select * from customer where c_custkey % 3 = 0) on c_custkey = o_custkey")
def q_local_override(spark, sf_dir):
    """JN-15, SRC-11."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0")
    rows = o.select("o_orderkey", F.col("o_custkey").alias("key"), (F.col("o_orderkey") % 2 == 0).alias("from_dependency"), F.col("o_orderstatus").alias("origin"), F.lit("a").alias("source_path"), F.lit("b").alias("category"))
    local = c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("origin"), F.lit("c").alias("source_path"), F.lit("d").alias("category"))
    return A.local_override(rows, local, ["key"]).select("o_orderkey", "origin")


@query(
    """with f as (select doc_id as ord, 'n' || doc_id % 50 as name, sha256(coalesce(text, '')) as h from documents), a as (select 'n' || doc_id % 50 as name, sha256(coalesce(text, '')) as h, case when doc_id % 3 = 0 then 'OWNED_SOURCE' else 'OWNED_GENERATED' end as origin, 's' || doc_id % 7 as source_path from documents where doc_id % 2 = 0),
    m as (select f.ord, a.origin, a.source_path from f join a using (name, h)), u as (select ord, min(origin) as origin, min(source_path) as source_path from m group by ord having count(distinct origin || '|' || source_path) = 1)
    select f.ord, coalesce(origin, 'UNRESOLVED') as origin, source_path from f left join u using (ord)"""
)
def q_asset_owner(spark, sf_dir):
    """JN-11, JN-12: an asset's owner needs both its name and its content."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("name"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha256"))
    files_ = d.select(F.col("doc_id").alias("ord"), F.concat(F.lit("base/assets/"), "name").alias("path"), "sha256")
    assets = d.where("doc_id % 2 = 0").select("name", "sha256", F.when(F.col("doc_id") % 3 == 0, "OWNED_SOURCE").otherwise("OWNED_GENERATED").alias("origin"), F.concat(F.lit("s"), F.pmod("doc_id", F.lit(7)).cast("string")).alias("source_path"), F.lit("m").alias("module"))
    none = spark.createDataFrame([], "type string, qualifiers string, name string, seq long, origin string, source_path string")
    return A.attribute_files(files_, none, assets)


@query(
    """select p_partkey, l_partkey::varchar as value, case when l_partkey is null then p_type || case when p_size % 2 = 0 then '-v' || p_size else '' end || ':' || p_partkey end as unverified from part left join (select distinct l_partkey from lineitem where l_partkey % 3 <> 0) on l_partkey = p_partkey"""
)
def q_expected_vs_inventory(spark, sf_dir):
    """JN-14, PRJ-19."""
    q = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v"), F.col("p_size").cast("string"))).otherwise("")
    expected = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("type"), q.alias("qualifiers"), F.col("p_partkey").cast("string").alias("name"))
    seen = table(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").cast("string").alias("name")).distinct()
    inventory = expected.join(seen, "name").select("type", "qualifiers", "name", F.col("name").alias("value"))
    return A.expected_inventory(expected, inventory).select("p_partkey", "value", "unverified")


@query("select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1)")
def q_semi_kept(spark, sf_dir):
    """JN-13."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id, lang from documents where doc_id not in (select doc_id from labels)")
def q_anti_unmatched(spark, sf_dir):
    """JN-01, JN-14: what has no match."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select event_type as category, max(event_id) as modified from events group by grouping sets ((event_type), ())")
def q_latest_by_category(spark, sf_dir):
    """AGG-14."""
    return A.latest_by_category(table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("event_id").alias("modified")))


@query("select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderkey) as k from orders where o_orderstatus = 'F') where k = 1")
def q_first_existing(spark, sf_dir):
    """WIN-08."""
    return A.first_existing(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("existing")), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query(
    """with p as (select p_partkey, case p_partkey % 5 when 0 then '/p/gen/' when 1 then '/p/app/src/main/' when 2 then '/p/app/build/intermediates/packaged_res/' when 3 then '/home/.gradle/caches/' else '/p/app/build/generated/' end || p_name as path, p_size % 2 = 0 as dep from part)
    select p_partkey, case when starts_with(path, '/p/gen/') then 'OWNED_GENERATED' when starts_with(path, '/p/app/src/main/') then 'OWNED_SOURCE' when dep and starts_with(path, '/p/app/build/intermediates/packaged_res/') then 'UNRESOLVED' when dep or contains(path, '.gradle/caches') then 'PUBLIC_DEPENDENCY' when starts_with(path, '/p/') and contains(path, '/build/generated/') then 'TOOL_GENERATED' else 'UNRESOLVED' end as origin from p"""
)
def q_path_origin(spark, sf_dir):
    """PRJ-16, PRJ-17."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr("case p_partkey % 5 when 0 then '/p/gen/' when 1 then '/p/app/src/main/' when 2 then '/p/app/build/intermediates/packaged_res/' when 3 then '/home/.gradle/caches/' else '/p/app/build/generated/' end || p_name").alias("path"), (F.col("p_size") % 2 == 0).alias("dep"))
    return p.select("p_partkey", A.path_origin(F.col("path"), F.col("dep"), generated_roots=["/p/gen"], source_roots=["/p/app/src/main"], selected_modules=["/p/app"], project_root="/p").alias("origin"))


@query(f"with p as (select page_id, {PATH} as path from pages) select page_id, case when page_id % 8 in (2, 7) then 'asset' when page_id % 8 in (0, 6) then 'image' when page_id % 8 = 1 then 'resource' end as kind, case page_id % 8 when 0 then 'drawable' when 1 then 'layout' when 6 then 'drawable' end as type, case page_id % 8 when 0 then 'hdpi' when 1 then '' when 6 then '' end as qualifiers, case page_id % 8 when 0 then page_id::varchar when 1 then 'abc_' || page_id when 2 then 'nim/' || page_id || '.bin' when 6 then '$Icon__' || page_id when 7 then page_id::varchar end as name from p")
def q_file_keys(spark, sf_dir):
    """PRJ-18."""
    return paths(spark, sf_dir).select("page_id", A.file_keys(F.col("path")).alias("k")).select("page_id", "k.kind", "k.type", "k.qualifiers", "k.name")


# --- functions -------------------------------------------------------------------------------------------------------------

PRINTABLE = "list_sort(list_distinct(regexp_extract_all(coalesce(html, ''), '[A-Za-z0-9_.$:/@+()<>?=-]{3,}')))"


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"))


@query(f"select page_id, array_to_string({PRINTABLE}, chr(10)) as tokens from pages")
def q_printable_tokens(spark, sf_dir):
    """FN-02."""
    return _pages(spark, sf_dir).select("page_id", F.array_join(C.printable_tokens(F.col("content")), "\n").alias("tokens"))


@query(f"select page_id, case when len(f) = 0 then sha256(coalesce(html, '')) else sha256(array_to_string(list_filter(f, lambda x: not regexp_full_match(x, '(0x)?[0-9a-fA-F]{{6,}}')), chr(10))) end as semantic_hash from (select page_id, html, {PRINTABLE} as f from pages)")
def q_semantic_hash(spark, sf_dir):
    """FN-01, FN-03."""
    return _pages(spark, sf_dir).select("page_id", C.semantic_hash(C.printable_tokens(F.col("content")), F.col("content")).alias("semantic_hash"))


@query(f"select page_id, array_to_string(list_filter({PRINTABLE}, lambda t: regexp_matches(t, 'manifest|permission|activity|service|receiver|provider|intent|feature|application|android\\.|com\\.')), chr(10)) as features from pages")
def q_marker_filter(spark, sf_dir):
    """FN-07."""
    return _pages(spark, sf_dir).select("page_id", F.array_join(C.manifest_markers(C.printable_tokens(F.col("content"))), "\n").alias("features"))


@query("select doc_id, array_to_string(list_transform(range(0, (octet_length(b) + 4095) // 4096), lambda i: substr(sha1(b[i * 4096 + 1 : i * 4096 + 4096]), 1, 16)), ',') as chunks from (select doc_id, encode(coalesce(text, '')) as b from documents)")
def q_chunk_digests(spark, sf_dir):
    """FN-04."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(C.chunk_digests(F.coalesce("text", F.lit("")).cast("binary")), ",").alias("chunks"))


OPCODE = "case p_partkey % 6 when 0 then 'invoke-virtual/range' when 1 then 'IF-eqz' when 2 then 'sget-object' when 3 then 'packed-switch' when 4 then 'add-int/lit8' else 'throw' end"


@query(
    f"""with o as (select p_partkey, split_part(lower({OPCODE}), '/', 1) as b from part)
    select p_partkey, case {" ".join(f"when starts_with(b, '{p}') then '{f}'" for p, f in config.OPCODE_FAMILIES)} else split_part(b, '-', 1) end as family from o"""
)
def q_opcode_family(spark, sf_dir):
    """FN-10."""
    return table(spark, sf_dir, "part").select("p_partkey", C.opcode_family(F.expr(OPCODE)).alias("family"))


@query(
    """with i as (select conv_id, turn, case role when 'user' then 'invoke-virtual' when 'assistant' then 'const-string' else 'goto/16' end as name, case role when 'user' then 'v0, Ljava/lang/A' || turn || ';->f(I)V' else 'v1, "' || replace(coalesce(text, ''), '"', '') || '"' end as output from conversations),
    r as (select conv_id, list(case when starts_with(name, 'invoke') then 'invoke' when starts_with(name, 'const') then 'const' else 'goto' end order by turn) as t, list('Ljava/lang/A' || turn || ';->f' order by turn) filter (where name = 'invoke-virtual') as a,
        list(case when split_part(output, '"', 2) = '' then 'empty' else 'string:' || least(length(split_part(output, '"', 2)) // 8, 8) end order by turn) filter (where name <> 'invoke-virtual') as c, count(*)::bigint as n from i group by conv_id)
    select conv_id, array_to_string(t, ',') as tokens, array_to_string(list_filter(t, lambda x: x = 'goto'), ',') as blocks, coalesce(array_to_string(a, ','), '') as api_calls, coalesce(array_to_string(c, ','), '') as constants, n as instruction_count,
        sha256(array_to_string(list_concat(t, ['|api-calls|'], coalesce(a, []), ['|constant-categories|'], coalesce(c, [])), chr(31))) as canonical_hash from r"""
)
def q_canonicalize(spark, sf_dir):
    """FN-11, FN-12."""
    c = table(spark, sf_dir, "conversations")
    name = F.when(F.col("role") == "user", "invoke-virtual").when(F.col("role") == "assistant", "const-string").otherwise("goto/16")
    output = F.when(F.col("role") == "user", F.concat(F.lit("v0, Ljava/lang/A"), F.col("turn").cast("string"), F.lit(";->f(I)V"))).otherwise(F.concat(F.lit('v1, "'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit("")), F.lit('"')))
    i = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("name"), output.alias("output")))).alias("i"))
    x = i.select("conv_id", C.canonical(F.transform("i", lambda v: F.struct(v["name"].alias("name"), v["output"].alias("output")))).alias("x"))
    join = lambda n: F.array_join(f"x.{n}", ",")
    return x.select("conv_id", join("opcode_tokens").alias("tokens"), join("block_signature").alias("blocks"), join("api_calls").alias("api_calls"), join("constants").alias("constants"), "x.instruction_count", "x.canonical_hash")


@query("select 'La/o' || s_suppkey % 40 || ';' as output, 'Lorg/S' || s_suppkey || ';' as original from supplier where s_suppkey % 4 <> 3")
def q_r8_parse(spark, sf_dir):
    """FN-19: mapping lines, with comments and members between."""
    from kindred.sources.parsers import mapping_lines, r8_mapping

    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey").cast("string")
    line = F.when(F.col("s_suppkey") % 4 == 3, F.concat(F.lit("# org.S"), k, F.lit(" -> x:"))).otherwise(F.concat(F.lit("org.S"), k, F.lit(" -> a.o"), (F.col("s_suppkey") % 40).cast("string"), F.lit(":\n    int f -> a")))
    return r8_mapping(mapping_lines(s.select(line.cast("binary").alias("content")), []))  # a mapping file a supplier


@query("select n_nationkey, sha256('sha' || n_nationkey || chr(0) || '{\"a\":' || n_regionkey || '}' || chr(0) || '1' || chr(0) || '[]') as key, left(regexp_replace(n_name || ' x/é', '[^A-Za-z0-9._-]+', '_', 'g'), 60) as stem, case when n_regionkey = 0 then 'N/A' else printf('%.2f', n_nationkey / 10.0) end as score from nation")
def q_cache_key(spark, sf_dir):
    """FN-28, FN-29, SNK-13."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey").cast("string")
    score = F.when(F.col("n_regionkey") != 0, F.col("n_nationkey") / 10.0)
    return n.select("n_nationkey", C.cache_key(F.concat(F.lit("sha"), k), F.concat(F.lit('{"a":'), F.col("n_regionkey").cast("string"), F.lit("}")), F.lit("1"), F.lit("[]")).alias("key"), C.output_stem(F.concat("n_name", F.lit(" x/é"))).alias("stem"), C.score_text(score).alias("score"))


# --- windows, order, reports ------------------------------------------------------------------------------------------------


@query(f"with {EXACT} select (row_number() over (order by least(l_n, r_n) desc, l))::int as rank, l::varchar as \"left\", r::varchar as \"right\", 1.0::double as sim from ex order by rank limit 50")
def q_topk_findings(spark, sf_dir):
    """SRT-01, SRT-02, SRT-03, SRT-04, WIN-06: the product's own ranking of what a dimension found."""
    from kindred.plans import compare

    left, right = sides(methods(spark, sf_dir))
    pairs = M.exact_match(left, right, "canonical_hash").join(left.select(F.col("ord").alias("l"), F.col("instruction_count").alias("a")), "l").join(right.select(F.col("ord").alias("r"), F.col("instruction_count").alias("b")), "r")
    pairs = pairs.select("l", F.col("l").cast("string").alias("left"), F.col("r").cast("string").alias("right"), F.lit(1.0).alias("sim"), F.least("a", "b").alias("mass"))
    return compare.top_findings(pairs, 50, F.desc(F.col("sim") * F.col("mass")), "l")


@query(
    """with e as (select page_id as position, case page_id % 6 when 0 then '/abs' when 1 then 'a/../b' when 2 then 'dup' else 'ok/' || page_id end as path, length(html) as size, case page_id % 5 when 0 then 0 else length(html) // (page_id % 40 * 10 + 1) + 1 end as compressed_size, case when page_id % 7 = 0 then 41471 else 33188 end as mode from pages)
    select position, case when starts_with(path, '/') or list_contains(string_split(path, '/'), '..') or path = '' then 'unsafe path' when mode & 61440 = 40960 then 'symbolic link' when size > 20000 then 'entry too large' when size > 0 and compressed_size = 0 then 'invalid compressed size' when compressed_size > 0 and size::double / compressed_size > 200 then 'unsafe ratio' end as violation,
    count(*) over (partition by rtrim(path, '/')) > 1 as duplicate from e"""
)
def q_entry_safety(spark, sf_dir):
    """SEC-01, SEC-02, SEC-03."""
    from kindred.sources.archive import violations

    e = table(spark, sf_dir, "pages").select(F.lit("a").alias("archive"), F.col("page_id").alias("position"), F.expr("case page_id % 6 when 0 then '/abs' when 1 then 'a/../b' when 2 then 'dup' else 'ok/' || page_id end").alias("path"), F.length("html").cast("long").alias("size"), F.expr("case page_id % 5 when 0 then 0 else length(html) div (page_id % 40 * 10 + 1) + 1 end").cast("long").alias("compressed_size"), F.expr("case when page_id % 7 = 0 then 41471 else 33188 end").alias("mode"))
    return violations(e, config.ArchiveLimits(max_entry_size=20_000)).select("position", "violation", "duplicate")


@query(
    """select o_orderkey, case when c_custkey is null then 'missing' when o_orderkey % 5 = 0 then 'invalid' when c_nationkey <> o_orderkey % 25 then 'stale' else 'matched' end as status from orders left join (select * from customer where c_custkey % 2 = 0) on c_custkey = o_custkey"""
)
def q_registry_status(spark, sf_dir):
    """SRC-18, JN-17."""
    from kindred.plans.registry import pair_status

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("left_path"), F.lit("r").alias("right_path"), (F.col("o_orderkey") % 25).cast("string").alias("left_sha"), F.lit("s").alias("right_sha"), (F.col("o_orderkey") % 5 != 0).alias("valid"))
    records = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("left_path"), F.lit("r").alias("right_path"), F.col("c_nationkey").cast("string").alias("left_sha"), F.lit("s").alias("right_sha"))
    return pair_status(o, records).select("o_orderkey", "status")


@query(f"with p as (select page_id, {PATH} as path from pages), s as (select string_split(path, '/') as s, path from p) select count(*) as entries, count(*) filter (where len(s) >= 3 and s[2] = 'dex' and ends_with(path, '.dex')) as dex, count(*) filter (where len(s) >= 4 and s[2] = 'lib' and ends_with(path, '.so')) as native, count(*) filter (where len(s) >= 3 and s[2] = 'assets') as assets, count(*) filter (where len(s) >= 3 and s[2] = 'res') as resources, count(*) filter (where len(s) >= 3 and s[2] = 'manifest' and s[-1] = 'AndroidManifest.xml') as manifests from s")
def q_inventory(spark, sf_dir):
    """SRC-02, AGG-11."""
    from kindred.sources.archive import inventory

    return inventory(paths(spark, sf_dir).select(F.lit("a").alias("archive"), "path")).drop("archive", "modules")
