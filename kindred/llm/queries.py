"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontaminate, embed_dedup, langid, ngram_join, packing, quality, rowmatch, substring_dedup, suffix_dedup, tokens, toxicity, trie, urlrules
from kindred.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def held_out(n: int, which: int) -> F.Column:
    """Rows without doc_id are never learnt from."""
    return F.coalesce(remainder(n) == which, F.lit(True)).alias("held_out")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(remainder(5) != 0)
    scored = toxicity.score(documents, toxicity.fit(documents, labels))
    return scored.select("doc_id", held_out(5, 0), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.read(tokens.write(documents, tokenizer_path("byte_bpe_50k.json"), end=0, spaced=True))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(documents, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urlrules.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(documents.where(remainder(3) != 1))
    found = langid.predict(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(3, 1), "lang_pred", F.col("lang_score").alias("score"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, tokenizer_path("word_bpe_49k.json"), end=1, spaced=False, capacity=4096)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.join(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(remainder(4) != 2)
    scored = quality.score(documents, quality.fit(documents, labels))
    return scored.select("doc_id", held_out(4, 2), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op12_row_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rowmatch.match(table(spark, sf_dir, "clicks"))
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.build(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_token_ids": op3_token_ids,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_decontamination": op5_decontamination,
    "op6_url_rules": op6_url_rules,
    "op7_language": op7_language,
    "op8_packing": op8_packing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_join": op10_ngram_join,
    "op11_quality": op11_quality,
    "op12_row_pattern": op12_row_pattern,
    "op13_prefix_trie": op13_prefix_trie,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": r"""
        with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        q as (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k : k + 9], ' ') as t from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
        s as (select distinct n from q),
        d as (select doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') as t from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from w, s where len(w) >= n)),
        m as (select doc_id, k, d.n, item_id from d join q on d.t = q.t and d.n = q.n),
        h as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from m) group by doc_id),
        x as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as l from m group by doc_id)
        select w.doc_id, len(w.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from w left join h using (doc_id) left join x using (doc_id)
    """,
    "op6_url_rules": r"""
        with p as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
        q as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
        r(h, p, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
        select page_id, host, path, max_by(h || p, length(h || p)) as rule, coalesce(max_by(v, length(h || p)), 'allow') as verdict
        from q left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
        group by page_id, host, path
    """,
    "op4_embedding_dedup": r"""
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id where len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
        r(node, c) as (select vec_id, vec_id from embeddings union select l.b, r.c from r join l on l.a = r.node),
        m as (select node, min(c) as c from r group by node), n as (select a, count(*) as n from l group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, c as component_id, vec_id = c as kept from embeddings join m on node = vec_id left join n on a = vec_id
    """,
    "op9_substring_dedup": r"""
        with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        g as (select doc_id, k, md5(array_to_string(w[k : k + 49], ' ')) as t from (select doc_id, w, unnest(range(1, len(w) - 48)) as k from w where len(w) >= 50)),
        f as (select t, min(doc_id) as d from g group by t),
        h as (select doc_id, list(distinct p) as gone from (select g.doc_id, unnest(range(k, k + 50)) as p from g join f using (t) where g.doc_id > d) group by doc_id)
        select w.doc_id, len(w.w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
            sha256(coalesce(array_to_string(case when gone is null then w.w else list_filter(w.w, lambda x, i: not list_contains(gone, i)) end, ' '), '')) as kept_sha256
        from w left join h using (doc_id)
    """,
    "op10_ngram_join": r"""
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select distinct doc_id, md5(array_to_string(w[k : k + 4], ' ')) as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as k from w where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
        e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * o >= 75 * (a.n + b.n - o)),
        l as (select x as a, y as b from e union all select y, x from e),
        r(node, c) as (select doc_id, doc_id from documents union select l.b, r.c from r join l on l.a = r.node),
        m as (select node, min(c) as c from r group by node)
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, c as component_id from documents d join m on node = d.doc_id left join n on n.doc_id = d.doc_id
    """,
    "op12_row_pattern": r"""
        with recursive d as (select distinct * from clicks where client_id is not null and ts is not null),
        c as (select client_id, click_id, ts, kind, case when isfinite(value) then floor(100 * value + 0.5)::bigint end as cents, row_number() over (partition by client_id order by ts, click_id nulls first) as n from d),
        g as (select *, lag(cents) over w as was, coalesce(ts <= lag(ts) over w + interval 15 minute and kind is not null and kind <> 'error', false) as linked from c window w as (partition by client_id order by n)),
        l as (select *, case when linked and cents < was then 'D' when linked and cents > was then 'U' when linked and cents = was and kind = 'view' then 'E' else 'B' end as letter from g),
        s as (select *, count(*) filter (letter = 'B') over w as session, count(*) filter (letter in ('B', 'E')) over w as stretch,
                coalesce(min(n) filter (letter <> 'D') over (partition by client_id order by n rows between 1 following and unbounded following), count(*) over (partition by client_id) + 1) - 1 as falls
            from l window w as (partition by client_id order by n)),
        goals as (select client_id, n, cents, stretch, falls from s where kind = 'view' and letter in ('D', 'U') union all select client_id, n, cents, stretch - 1, falls from s where letter = 'E'),
        p as (select s.client_id, s.n, max(g.n) as p, max_by(g.falls, g.n) as last from s join goals g on g.client_id = s.client_id and g.stretch = s.stretch and g.n > s.n and g.cents >= s.cents group by all),
        r(client_id, session, n) as (select client_id, session, n from s where letter = 'B'
            union all select r.client_id, r.session, t.n from r left join p using (client_id, n) join s t on t.client_id = r.client_id and t.session = r.session and t.n = coalesce(p.last, r.n + 1)),
        m as (select p.*, row_number() over (partition by client_id order by n) as match_no from r join p using (client_id, n))
        select m.client_id, match_no, max(s.click_id) filter (s.n = m.n) as first_id, max(s.click_id) filter (s.n = last) as last_id, count(*) as n_rows, sum(cents)::bigint as sum_cents,
            sha256(string_agg(case when s.n = m.n then 'A' when s.n = p then 'P' else letter end, '' order by s.n)) as labels_sha256
        from m join s on s.client_id = m.client_id and s.n between m.n and last group by m.client_id, match_no
    """,
    "op13_prefix_trie": r"""
        with o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as k from conversations where conv_id is not null),
        c as (select distinct conv_id, conv_id - conv_id % 20 as base,
                xor(list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda y, z: case when y & 1 = 1 then xor(y >> 1, 3988292384) else y >> 1 end, xor(a, x)), 4294967295::bigint), 4294967295) % 4 as h from o),
        t as (select c.conv_id, o.k, role, text from c join o on o.conv_id = c.base and o.k <= h union all select c.conv_id, o.k, role, text from c join o on o.conv_id = c.conv_id and o.k > h),
        q as (select conv_id, list(sha256(length(role) || ':' || role || text) order by k) as key, list(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) order by k) as words from t group by conv_id),
        s as (select conv_id, coalesce(key, []) as key, coalesce(words, []) as words from c left join q using (conv_id)),
        m as (select conv_id, len(key) as size, d, array_to_string(key[1 : d], ',') as node, words[d] as w from (select *, unnest(range(0, len(key) + 1)) as d from s)),
        n as (select node, d, min(conv_id) as conv_id, count(*) as n, coalesce(any_value(w), 0) as w, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (size = d), '') as ends from m group by node, d),
        e as (select *, case when d > 0 then substr(node, 1, greatest(65 * d - 66, 0)) end as parent from n),
        k as (select parent, d - 1 as d, count(*) as n from e where d > 0 group by all),
        a as (select substr(node, 1, greatest(65 * g - 1, 0)) as node, g as d, sum((n - 1) * w) as saved, count(*) filter (leaf) as leaves from (select e.node, e.n, e.w, k.n is null as leaf, unnest(range(0, e.d + 1)) as g from e left join k on k.parent = e.node and k.d = e.d) group by all)
        select e.conv_id, e.d as depth, u.conv_id as parent_conv_id, e.n as n_convs, coalesce(k.n, 0)::bigint as n_children, leaves::bigint as n_leaves, saved::bigint as saved_tokens, sha256(e.ends) as ends_sha256
        from e join a on a.node = e.node and a.d = e.d left join k on k.parent = e.node and k.d = e.d left join n u on u.node = e.parent and u.d = e.d - 1
    """,
}
