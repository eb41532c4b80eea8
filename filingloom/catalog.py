"""Queries of the core operators over the given tables, and their SQL.

Every query runs over whole tables and whole texts. Long texts are returned as
their SHA-256, which both engines compute alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.text import uwords
from filingloom.operators import aggregates, answers, chunking, cleaning, dedup, html, retrieval, sections, selection, windows
from filingloom.plans import pipeline
from filingloom.session import materialize, prepare, shared_dir
from filingloom.sources import files
from filingloom.sources.files import malformed_rows
from filingloom.streaming.ingest import current, ingest, landing_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Unicode white space and the token pattern, written for DuckDB.
_WS = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_WS}]"
_STRIP = rf"'^[{_WS}]+|[{_WS}]+$', '', 'g'"
_LINES = "unnest(string_split({0}, chr(10))) as line, generate_subscripts(string_split({0}, chr(10)), 1) - 1 as no"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Records once each: rows delivered twice agree in all columns."""
    return table(spark, d, "records").dropDuplicates(["record_id"])


# ------------------------------------------------------------------------ vectors
@query("""
    with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e), 9) as score from v q, v where q.vec_id % 20 = 0),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id, round(score, 6) as score from r where rank <= 5""")
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    top = retrieval.cosine_topk(v.where("vec_id % 20 = 0"), v, "vec_id", "vec_id", "embedding", 5)
    return top.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("""
    with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    n as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v)
    select vec_id, round(list_sum(list_transform(e, lambda x: abs(x / norm))), 6) as total from n""")
def vector_normalized(spark: SparkSession, d: str) -> DataFrame:
    unit = table(spark, d, "embeddings").select("vec_id", retrieval.normalized(F.col("embedding")).alias("u"))
    return unit.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("""
    with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
    s as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e), 9) as score from v q, v where q.vec_id % 20 = 0 and v.label < 5),
    r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
    select query_id, rank::int as rank, vec_id from r where rank <= 3""")
def cosine_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Beyond parity: a metadata filter before the search."""
    v = table(spark, d, "embeddings")
    return retrieval.cosine_topk(v.where("vec_id % 20 = 0"), v.where("label < 5"), "vec_id", "vec_id", "embedding", 3).select("query_id", "rank", "vec_id")


# ----------------------------------------------------------------------- cleaning
_COUNTED = f"""
    l as (select doc_id, {_LINES.format("text")} from documents where text is not null),
    s as (select doc_id, no, line, regexp_replace(line, {_STRIP}) as s from l),
    c as (select *, count(*) over (partition by doc_id, s) as n from s)"""


@query(f"""
    with {_COUNTED},
    k as (select * from c where s = '' or s in ('[TABLE]', '[/TABLE]') or not (regexp_matches(s, '^[0-9]{{1,4}}$') or lower(s) = 'table of contents' or (length(s) < 100 and n >= 2))),
    j as (select doc_id, string_agg(line, chr(10) order by no) as t from k group by doc_id)
    select d.doc_id, sha256(regexp_replace(regexp_replace(coalesce(t, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP})) as text_hash
    from documents d left join j using (doc_id) where d.text is not null
    union all select doc_id, null from documents where text is null""")
def strip_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    clean = cleaning.strip_boilerplate(table(spark, d, "documents"), ["doc_id"], "text")
    return clean.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query(f"""
    with {_COUNTED}
    select distinct doc_id, s as line, n as times from c where s <> '' and n >= 2 and length(s) < 100 and s not in ('[TABLE]', '[/TABLE]')""")
def stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.stripped_lines(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
    with {_COUNTED},
    g as (select distinct doc_id, s as line, n from c where s <> '' and n >= 2 and length(s) < 100 and s not in ('[TABLE]', '[/TABLE]'))
    select line, sum(n)::bigint as times, count(*) as texts from g group by line order by times desc, line limit 10""")
def top_stripped_lines(spark: SparkSession, d: str) -> DataFrame:
    gone = cleaning.stripped_lines(table(spark, d, "documents"), "doc_id", "text")
    return gone.groupBy("line").agg(F.sum("times").alias("times"), F.count("*").alias("texts")).orderBy(F.desc("times"), "line").limit(10)


@query("""
    select ticker, count(*) filter (contains(text, '[TABLE]')) as hits, count(*) as total, count(*) filter (contains(text, '[TABLE]')) / count(*)::double as rate
    from records group by ticker having count(*) filter (contains(text, '[TABLE]')) > 0""")
def rate_by_group(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.rate_by_group(table(spark, d, "records"), ["ticker"], F.col("text").contains("[TABLE]"))


@query("""
    select form, count(*) filter (regexp_matches(text, '[a-z],[a-z]|[a-z]\\.[A-Z][a-z]')) as hits, count(*) as total, count(*) filter (regexp_matches(text, '[a-z],[a-z]|[a-z]\\.[A-Z][a-z]')) / count(*)::double as rate
    from chunks group by form having hits > 0""")
def joined_words(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.rate_by_group(table(spark, d, "chunks"), ["form"], cleaning.has_joined_words(F.col("text")))


@query("""
    with p as (select doc_id, text, strpos(lower(text), 'agreement') - 1 as pos from documents where contains(lower(text), 'agreement')),
    w as (select doc_id, pos, substring(text, greatest(pos - 200, 0) + 1, pos + 200 - greatest(pos - 200, 0)) as c from p)
    select doc_id, pos::int as pos, len(regexp_extract_all(lower(c), 'million'))::int as around, sha256(c) as context_hash from w""")
def keyword_context(spark: SparkSession, d: str) -> DataFrame:
    found = cleaning.keyword_context(table(spark, d, "documents"), ["doc_id"], "text", "agreement", 200, "million")
    return found.select("doc_id", F.col("at").alias("pos"), "around", F.sha2("context", 256).alias("context_hash"))


# ----------------------------------------------------------------------- chunking
_CHUNK_SQL = f"""
    with t as (select doc_id, text, regexp_extract_all(text, '[{_WS}]*(?:{_TOKEN})') as p from documents where text is not null),
    n as (select *, len(p) as n, case when len(p) <= 500 then 1 else 1 + ceil((len(p) - 500) / 450.0) end::int as n_chunks from t),
    e as (select *, unnest(range(0, n_chunks)) as i from n)
    select doc_id, i::int as chunk_index, n_chunks, least(500, n - i * 450)::int as token_count,
        sha256(case when n_chunks = 1 then text else regexp_replace(array_to_string(p[i * 450 + 1 : i * 450 + 500], ''), '^[{_WS}]+', '') end) as chunk_hash from e"""


@query(_CHUNK_SQL)
def token_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.token_windows(table(spark, d, "documents"), ["doc_id"], "text")
    return cut.select("doc_id", "chunk_index", "n_chunks", "token_count", F.sha2("chunk", 256).alias("chunk_hash"))


@query(f"""
    with t as (select doc_id, list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '') as p from documents where text is not null),
    n as (select *, len(p) as n, case when len(p) <= 512 then 1 else 1 + ceil((len(p) - 512) / 462.0) end::int as n_chunks from t),
    e as (select *, unnest(range(0, n_chunks)) as i from n)
    select doc_id, i::int as chunk_index, n_chunks, least(512, n - i * 462)::int as word_count, sha256(array_to_string(p[i * 462 + 1 : i * 462 + 512], ' ')) as chunk_hash from e""")
def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    cut = chunking.word_windows(table(spark, d, "documents"), ["doc_id"], "text")
    return cut.select("doc_id", "chunk_index", "n_chunks", "word_count", F.sha2("chunk", 256).alias("chunk_hash"))


@query(f"""
    with r as (select distinct on (record_id) * from records),
    t as (select *, regexp_extract_all(text, '[{_WS}]*(?:{_TOKEN})') as p from r where text is not null),
    n as (select *, len(p) as n, case when len(p) <= 500 then 1 else 1 + ceil((len(p) - 500) / 450.0) end::int as n_chunks from t),
    e as (select *, unnest(range(0, n_chunks)) as i from n),
    c as (select *, case when n_chunks = 1 then text else regexp_replace(array_to_string(p[i * 450 + 1 : i * 450 + 500], ''), '^[{_WS}]+', '') end as c from e)
    select coalesce(ticker, '') || '|' || coalesce(report_date, '') || '|' || coalesce(item_id, '') || '|' || i as chunk_id, accession, i::int as chunk_index, n_chunks as n_chunks_in_section,
        least(500, n - i * 450)::int as token_count, len(list_filter(regexp_split_to_array(c, '[{_WS}]+'), lambda w: w <> ''))::int as word_count from c""")
def chunk_records(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.chunk_records(_records(spark, d))
    return made.select("chunk_id", "accession", "chunk_index", "n_chunks_in_section", "token_count", "word_count")


@query("select count(*) filter (token_count > 500) as over, count(*) as total, max(token_count) as largest, count(*) filter (token_count > 500) / count(*)::double as share from chunks")
def chunks_over_limit(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.over_limit(table(spark, d, "chunks"), "token_count", 500)


@query("select count(chunk_id) as n_rows, count(distinct chunk_id) as n_keys, count(chunk_id) - count(distinct chunk_id) as repeated from chunks")
def chunk_id_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.duplicate_keys(table(spark, d, "chunks"), "chunk_id")


# ------------------------------------------------------------------------- copies
@query("select sha256(text) as content_hash, count(*) as copies, min(doc_id) as first_key from documents where text is not null group by 1 having count(*) > 1")
def exact_copies(spark: SparkSession, d: str) -> DataFrame:
    return dedup.exact_copies(table(spark, d, "documents"), "doc_id", "text")


@query("select doc_id, min(doc_id) over (partition by text) as class_id from documents where text is not null")
def copy_classes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.copy_classes(table(spark, d, "documents"), "doc_id", "text")


_NEAR_SQL = f"""
    with r as (select min(doc_id) as k, text from documents where length(text) >= 200 group by text),
    w as (select k, list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '') as w from r),
    s as (select distinct k, unnest(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) end) as g from w),
    h as (select k, hash(g) as g from s),
    n as (select k, count(*) as n from h group by all),
    p as (select a.k as a, b.k as b, count(*) as c from h a join h b on a.g = b.g and a.k < b.k group by all)
    select a, b, round(c / (x.n + y.n - c)::double, 6) as similarity from p join n x on x.k = a join n y on y.k = b where c / (x.n + y.n - c)::double >= 0.8 - 1e-12"""


@query(_NEAR_SQL)
def near_duplicates_exact(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates_exact(table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_NEAR_SQL)
def near_duplicates_minhash(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicates_minhash(table(spark, d, "documents"), "doc_id", "text").select("a", "b", F.round("similarity", 6).alias("similarity"))


_CLASSES_SQL = f"""
    with recursive q as ({_NEAR_SQL}),
    e as (select a, b from q union all select b, a from q),
    reach(k, o) as (select distinct a, a from e union select r.k, e.b from reach r join e on r.o = e.a),
    c as (select k, min(o) as root from reach group by k),
    m as (select doc_id, case when length(text) >= 200 then min(doc_id) over (partition by text) else doc_id end as rep from documents),
    n as (select rep, count(*) as n from m group by rep),
    l as (select e.a as rep, sum(n.n) as near from e join n on n.rep = e.b group by e.a)
    select doc_id, coalesce(root, m.rep) as class_id, (coalesce(near, 0) + n.n - 1)::bigint as links
    from m join n using (rep) left join c on c.k = m.rep left join l on l.rep = m.rep"""


@query(_CLASSES_SQL)
def near_duplicate_classes(spark: SparkSession, d: str) -> DataFrame:
    return dedup.near_duplicate_classes(table(spark, d, "documents"), "doc_id", "text")


@query(f"""
    with u as (select distinct record_id, text, coalesce(ticker, '') || '|' || coalesce(report_date, '') || '|' || coalesce(item_id, '') as k from records where length(text) >= 200),
    d as (select record_id, text, case when row_number() over (partition by k order by record_id) = 1 then k else k || '#' || row_number() over (partition by k order by record_id) end as key from u),
    r as (select min(record_id) as id, text from u group by text),
    w as (select id, list_filter(regexp_split_to_array(text, '[{_WS}]+'), lambda w: w <> '') as w from r),
    s as (select distinct id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as g from w where len(w) >= 3),
    h as (select id, hash(g) as g from s),
    n as (select id, count(*) as n from h group by all),
    p as (select a.id as a, b.id as b, count(*) as c from h a join h b on a.g = b.g and a.id < b.id group by all),
    t as (select a, b, round(c / (x.n + y.n - c)::double, 6) as similarity from p join n x on x.id = a join n y on y.id = b where c / (x.n + y.n - c)::double >= 0.7 - 1e-12)
    select least(x.key, y.key) as key_a, greatest(x.key, y.key) as key_b, similarity from t join d x on x.record_id = a join d y on y.record_id = b order by similarity desc, key_a, key_b limit 10""")
def top_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """The most similar pairs of different section texts, under the sections' unique keys."""
    r = table(spark, d, "records")
    ids = r.where("length(text) >= 200").select("record_id", "ticker", "report_date", "item_id").distinct()
    key = F.concat(F.coalesce("ticker", F.lit("")), F.lit("|"), F.coalesce("report_date", F.lit("")), F.lit("|"), F.coalesce("item_id", F.lit("")))
    named = windows.suffix_duplicates(ids, key, ["record_id"]).select("record_id", "key")
    pairs = dedup.near_duplicates_exact(r, "record_id", "text", 0.7, 3)
    both = pairs.join(named.select(F.col("record_id").alias("a"), F.col("key").alias("x")), "a").join(named.select(F.col("record_id").alias("b"), F.col("key").alias("y")), "b")
    return both.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), F.round("similarity", 6).alias("similarity")).orderBy(F.desc("similarity"), "key_a", "key_b").limit(10)


# ---------------------------------------------------------------------- selection
@query("""
    with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders where o_orderstatus = 'F' and o_orderdate <= timestamp '1997-12-31')
    select o_custkey, o_orderkey, o_orderdate, rn::int as rn from r where rn <= 3""")
def latest_n(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    top = selection.latest_n(o, ["o_custkey"], "o_orderdate", 3, ["o_orderkey"], F.lit("1997-12-31").cast(o.schema["o_orderdate"].dataType), F.col("o_orderstatus") == "F")
    return top.select("o_custkey", "o_orderkey", "o_orderdate", "rn")


@query("""
    with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders where o_orderstatus = 'F'),
    b as (select o_custkey, max(o_orderdate) filter (rn = 1) as newest, max(o_orderdate) filter (rn = 2) as prior from r where rn <= 2 group by 1 having count(*) = 2)
    select o.o_custkey, o.o_orderkey, o.o_orderdate from orders o join b using (o_custkey) where o.o_orderstatus = 'O' and prior < o.o_orderdate and o.o_orderdate < newest""")
def between_latest_two(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    inside = selection.between_latest_two(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderdate", ["o_orderkey"])
    return inside.select("o_custkey", "o_orderkey", "o_orderdate")


@query("select distinct o_orderkey from orders anti join (select l_orderkey from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey")
def not_yet_present(spark: SparkSession, d: str) -> DataFrame:
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.not_yet_present(table(spark, d, "orders").select("o_orderkey"), returned, ["o_orderkey"]).distinct()


@query("""
    with r as (select *, row_number() over (partition by accession order by downloaded_at desc nulls last, sha256 nulls last, local_path nulls last) as rn from manifest where accession is not null)
    select accession, sha256, epoch_us(downloaded_at) as downloaded_us, coalesce(size_bytes, -1) as size_bytes from r where rn = 1""")
def latest_version(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("accession is not null")
    return selection.latest_version(m, ["accession"], "downloaded_at", ["sha256", "local_path"]).select("accession", "sha256", F.unix_micros("downloaded_at").alias("downloaded_us"), F.coalesce("size_bytes", F.lit(-1).cast("long")).alias("size_bytes"))


@query("""
    with n as (select o_orderkey, 'new' as state from orders where o_orderstatus = 'P')
    select * from n union all select o_orderkey, 'old' from orders anti join n using (o_orderkey)""")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("state"))
    return selection.latest_wins(old, o.where("o_orderstatus = 'P'").select("o_orderkey", F.lit("new").alias("state")), ["o_orderkey"])


@query("""
    select c_custkey, coalesce(case when n_regionkey = 1 then upper(n_name) end, case when n_regionkey < 4 then n_name end) as n_name
    from customer join nation on c_nationkey = n_nationkey where n_regionkey < 4""")
def lookup_with_override(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    own = n.where("n_regionkey = 1").select("c_nationkey", F.upper("n_name").alias("n_name"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return selection.lookup_with_override(c, n.where("n_regionkey < 4").select("c_nationkey", "n_name"), own, "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("""
    with r as (select *, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey) as rn from orders)
    select o_custkey, o_orderkey, o_totalprice from r where rn = 1""")
def argmax_per_group(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return selection.argmax_per_group(o, ["o_custkey"], "o_totalprice", ["o_orderkey"])


@query("select distinct accession from manifest where accession is not null and accession not in (select accession from records where accession is not null)")
def filings_without_records(spark: SparkSession, d: str) -> DataFrame:
    return selection.missing_keys(table(spark, d, "manifest"), table(spark, d, "records").select("accession"), "accession")


@query("""
    with r as (select distinct on (run_row) run_row, retrieved from run_20261012t174720z),
    e as (select run_row, unnest(retrieved) as x, generate_subscripts(retrieved, 1) - 1 as pos from r)
    select run_row, pos::int as pos, x.chunk_id as chunk_id, x.score as score from e""")
def rows_of_columns(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run_20261012t174720z").dropDuplicates(["run_row"])
    columns = run.select("run_row", F.col("retrieved.chunk_id").alias("chunk_id"), F.col("retrieved.score").alias("score"))
    return selection.rows_of_columns(columns, ["run_row"], ["chunk_id", "score"])


@query("select doc_id, source, lang from documents where source = (select min(source) from documents) order by doc_id limit 1")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    least = docs.agg(F.min("source")).first()[0]
    return selection.first_match(docs, "source", least, ["doc_id"])


@query("select count(*) as malformed from manifest where coalesce(trim(local_path), '') = ''")
def manifest_malformed(spark: SparkSession, d: str) -> DataFrame:
    return malformed_rows(table(spark, d, "manifest")).agg(F.count("*").alias("malformed"))


@query("""
    select distinct upper(ticker) as ticker, lpad(ltrim(cik, '0'), 10, '0') as cik, replace(accession, '-', '') as folder, coalesce(nullif(regexp_extract(primary_doc, '(\\.[A-Za-z0-9]+)$', 1), ''), '.htm') as ext,
        coalesce(size_bytes < 100000, false) as small, form in ('10-K', '10-Q') as plain_form, coalesce(report_date, '') <> '' and report_date <= '2020-12-31' as in_period
    from manifest where accession is not null and cik is not null""")
def manifest_projection(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "manifest").where("accession is not null and cik is not null")
    ext = F.regexp_extract("primary_doc", r"(\.[A-Za-z0-9]+)$", 1)
    return m.select(
        F.upper("ticker").alias("ticker"), F.lpad(F.ltrim(F.col("cik"), F.lit("0")), 10, "0").alias("cik"), F.replace("accession", F.lit("-"), F.lit("")).alias("folder"),
        F.coalesce(F.nullif(ext, F.lit("")), F.lit(".htm")).alias("ext"), F.coalesce(F.col("size_bytes") < 100000, F.lit(False)).alias("small"),
        F.col("form").isin("10-K", "10-Q").alias("plain_form"), ((F.coalesce("report_date", F.lit("")) != "") & (F.col("report_date") <= "2020-12-31")).alias("in_period"),
    ).distinct()


# --------------------------------------------------------------------- aggregates
@query("with c as (select item_id, count(*) as cnt, min(record_id) as f from records group by 1) select item_id, cnt from c order by cnt desc, f limit 10")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_counts(table(spark, d, "records"), "item_id", "record_id", 10)


@query("""
    select o_orderstatus, count(o_orderkey) filter (o_orderpriority = '1-URGENT') as "1-URGENT", count(o_orderkey) filter (o_orderpriority = '2-HIGH') as "2-HIGH", count(o_orderkey) filter (o_orderpriority = '5-LOW') as "5-LOW"
    from orders group by 1""")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.pivot_counts(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey", ["1-URGENT", "2-HIGH", "5-LOW"])


@query("""
    with r as (select source, n_chars, row_number() over (partition by source order by n_chars) as rn, count(*) over (partition by source) as n from documents where n_chars is not null)
    select source, n_chars as upper_median, n from r where rn = n // 2 + 1""")
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.upper_median(table(spark, d, "documents"), ["source"], "n_chars")


@query("select list_sort(list(n_chars))[count(n_chars) // 2 + 1] as upper_median, count(n_chars) as n from documents where n_chars is not null")
def upper_median_overall(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.upper_median(table(spark, d, "documents"), [], "n_chars")


@query("""
    with b as (select record_id, length(text) as chars from records where length(text) >= 50 and length(text) < 500 and not item_id like '%FRONT'),
    u as (select distinct * from b)
    select record_id, chars::int as chars from u order by chars, record_id limit 1 offset (select count(*) // 2 from u)""")
def sample_record(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").where("not item_id like '%FRONT'").select("record_id", F.length("text").alias("chars")).distinct()
    return aggregates.median_or_least(r, "chars", 50, 500, ["record_id"])


@query("""
    select form, count(*) filter (item_id not like '%-%-%') as hits, count(*) as total, count(*) filter (item_id not like '%-%-%') / count(*)::double as rate
    from records where item_id not like '%FRONT' group by form having hits > 0""")
def unprefixed_items(spark: SparkSession, d: str) -> DataFrame:
    """Item ids without a part, per form."""
    return aggregates.rate_by_group(table(spark, d, "records").where("item_id not like '%FRONT'"), ["form"], ~F.col("item_id").like("%-%-%"))


@query("""
    with u as (select distinct record_id, char_length(text) as chars from records where length(text) >= 20000)
    select record_id, chars::int as chars from u order by chars desc, record_id limit 20""")
def big_sections(spark: SparkSession, d: str) -> DataFrame:
    """The largest of the sections of at least 20,000 characters."""
    r = table(spark, d, "records").where("length(text) >= 20000").select("record_id", F.length("text").alias("chars")).distinct()
    return r.orderBy(F.desc("chars"), "record_id").limit(20)


@query("select chunk_id, token_count from (select distinct chunk_id, token_count from chunks where token_count > 512) order by chunk_id, token_count limit 3")
def over_limit_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "token_count").distinct()
    return aggregates.failures(c, F.col("token_count") > 512, ["chunk_id", "token_count"], 3)


@query("select run_row, round(input_tokens / 1e6 * 1.0 + output_tokens / 1e6 * 5.0, 6) as cost from (select distinct run_row, input_tokens, output_tokens from run_20261012t174720z)")
def token_cost(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run_20261012t174720z").select("run_row", "input_tokens", "output_tokens").distinct()
    return aggregates.weighted_cost(run, {"input_tokens": 1.0, "output_tokens": 5.0}).select("run_row", "cost")


@query("select record_id, chars::int as chars from (select distinct record_id, length(text) as chars from records where text is not null) order by chars, record_id limit 1")
def least_record(spark: SparkSession, d: str) -> DataFrame:
    """No record lies in an empty band, so the least one is the sample."""
    r = table(spark, d, "records").where("text is not null").select("record_id", F.length("text").alias("chars")).distinct()
    return aggregates.median_or_least(r, "chars", 10**8, 10**8 + 1, ["record_id"])


@query("select count(*) as passed from chunks where token_count <= 10000000")
def guarded_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").where("token_count is not null")
    return chunking.guard_length(c, F.col("token_count"), 10_000_000, "chunk_id").agg(F.count("*").alias("passed"))


# ------------------------------------------------------------------------ windows
@query("""
    select l_orderkey, l_linenumber, case when sum((l_returnflag = 'R')::int) over (partition by l_orderkey order by l_linenumber, l_partkey rows unbounded preceding) >= 2 then 'II' else 'I' end as part from lineitem""")
def running_switch(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    return windows.running_switch(li, ["l_orderkey"], ["l_linenumber", "l_partkey"], F.col("l_returnflag") == "R", 2, "I", "II").select("l_orderkey", "l_linenumber", "part")


@query("""
    with r as (select distinct record_id, coalesce(ticker, '') || '|' || coalesce(report_date, '') || '|' || coalesce(item_id, '') as k from records where length(text) >= 200),
    n as (select *, row_number() over (partition by k order by record_id) as n from r)
    select record_id, case when n = 1 then k else k || '#' || n end as key from n""")
def suffix_duplicates(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").where("length(text) >= 200").select("record_id", "ticker", "report_date", "item_id").distinct()
    key = F.concat(F.coalesce("ticker", F.lit("")), F.lit("|"), F.coalesce("report_date", F.lit("")), F.lit("|"), F.coalesce("item_id", F.lit("")))
    return windows.suffix_duplicates(r, key, ["record_id"]).select("record_id", "key")


# ----------------------------------------------------------------------- sections
@query(f"""
    with r as (select distinct record_id, text from records),
    l as (select record_id, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP}) <> '') as l from r)
    select record_id, len(l) >= 3 and len(list_filter(l, lambda x: regexp_matches(x, '\\t[^\\t\\n]*\\t[0-9]{{1,4}}(-[0-9]{{1,4}})?[{_WS}]*$'))) >= 0.5 * len(l) as contents from l""")
def contents_shape(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").select("record_id", "text").distinct()
    return r.select("record_id", sections.looks_like_contents(F.col("text")).alias("contents"))


def _filings(spark: SparkSession, d: str) -> DataFrame:
    """Each filing's records as one HTML document: the front text as it is, then headings
    in bold, texts as paragraphs; ``n_items`` headings."""
    r = table(spark, d, "records").where("text is not null")
    esc = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    front, raw = F.coalesce(F.col("item_id").like("%FRONT"), F.lit(False)), F.regexp_extract("item_id", r"-([0-9]+[A-Z]?)$", 1)
    heading = F.concat(F.lit('<div><span style="font-weight:700">Item '), raw, F.lit(". Section</span></div>\n"))
    part = F.concat(F.when(front, F.lit("")).otherwise(heading), F.lit("<p>"), esc, F.lit("</p>\n"))
    # a filing's own sections; rows delivered twice are equal, so a set holds them once
    listed = r.where(front | (raw != "")).groupBy("accession", "form").agg(F.array_sort(F.collect_set(F.struct((~front).alias("item"), "record_id", part.alias("html")))).alias("l"))
    listed = listed.withColumn("n_items", F.size(F.filter("l", lambda x: x["item"])))
    return listed.select("accession", "form", "n_items", F.encode(F.concat(F.lit("<html><body>"), F.array_join(F.transform("l", lambda x: x["html"]), ""), F.lit("</body></html>")), "utf-8").alias("content"))


@query("""
    with r as (select distinct on (record_id) record_id, accession, form, regexp_extract(item_id, '-([0-9]+[A-Z]?)$', 1) as raw from records where text is not null and not item_id like '%FRONT'),
    n as (select accession, raw as item_id, row_number() over (partition by accession order by record_id)::int as section_pos from r where raw <> '')
    select accession, section_pos, item_id from n union all select distinct accession, 0, 'FRONT' from n""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Filings with an item, written as HTML and split into their sections again."""
    return html.split_html(_filings(spark, d).where("n_items > 0"), ["accession"], "content").select("accession", "section_pos", "item_id")


_PART_ROWS = ", ".join(f"('{i}', '{p}')" for i, p in sections.ANNUAL_PARTS.items())


@query(f"""
    with r as (select distinct on (record_id) record_id, accession, form, text, coalesce(item_id like '%FRONT', false) as front, regexp_extract(item_id, '-([0-9]+[A-Z]?)$', 1) as raw from records where text is not null),
    v as (select *, case when front then 'FRONT' else raw end as item from r where front or raw <> ''),
    z as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP}) <> '') as l from v),
    g as (select *, not (len(l) >= 3 and len(list_filter(l, lambda x: regexp_matches(x, '\\t[^\\t\\n]*\\t[0-9]{{1,4}}(-[0-9]{{1,4}})?[{_WS}]*$'))) >= 0.5 * len(l)) as good from z),
    k as (select * from g qualify count(*) over (partition by accession, form, item) = 1 or good or count(*) filter (good) over (partition by accession, form, item) = 0),
    o as (select *, count(*) filter (item = '1') over (partition by accession, form order by not front, record_id rows unbounded preceding) as ones from k),
    p as (select o.*, case when item = 'FRONT' or form not in ('10-K', '10-Q') then item when form = '10-K' then coalesce(m.part, '?') || '-' || item when ones >= 2 then 'II-' || item else 'I-' || item end as id
        from o left join (values {_PART_ROWS}) m(i, part) on m.i = item),
    ls as (select record_id, {_LINES.format("text")} from p),
    st as (select record_id, no, line, regexp_replace(line, {_STRIP}) as s from ls),
    c as (select *, count(*) over (partition by record_id, s) as n from st),
    kept as (select * from c where s = '' or s in ('[TABLE]', '[/TABLE]') or not (regexp_matches(s, '^[0-9]{{1,4}}$') or lower(s) = 'table of contents' or (length(s) < 100 and n >= 2))),
    j as (select record_id, regexp_replace(regexp_replace(string_agg(line, chr(10) order by no), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_STRIP}) as t from kept group by record_id)
    select accession, form || ':' || id as item_id, length(t)::int as char_count, sha256(t) as content_hash from p join j using (record_id) where length(t) >= 50""")
def section_records(spark: SparkSession, d: str) -> DataFrame:
    f = _filings(spark, d)
    for c in ("ticker", "cik", "company", "filing_date", "report_date"):
        f = f.withColumn(c, F.lit(None).cast("string"))
    made = pipeline.section_records(f)
    return made.select("accession", "item_id", "char_count", "content_hash")


#: Small filings and what comes of them.
_PAGES = (
    ("plain", "<style>a{}</style><p>One &amp; two</p><script>no()</script><p>three</p>"),
    ("table", "<p>a</p><table><tr><td>Net <b>sales</b></td><td>5</td></tr><tr><td> </td><td></td></tr><tr><td>Costs</td><td>3</td></tr></table>"),
    ("heads", '<p>cover</p><div><span style="font-weight:700">Item 1. Business</span></div><p>We act.</p><p>See <u>Item 2. Land</u> above</p><div><b>Item 1A: Risk</b></div><p>Some.</p>'),
    ("contents", "<table><tr><td><b>Item 1. A</b></td></tr><tr><td><b>Item 2. B</b></td></tr></table><p>rest</p>"),
)


def _pages(spark: SparkSession) -> DataFrame:
    return prepare(spark).createDataFrame(list(_PAGES), "name string, html string")


@query(r"""
    select * from (values ('plain', 'plain', 'One & two' || chr(10) || 'three'), ('plain', 'tables', 'One & two' || chr(10) || 'three'), ('plain', 'marked', 'One & two' || chr(10) || chr(10) || 'three'),
        ('table', 'tables', 'a' || chr(10) || chr(10) || '[TABLE]' || chr(10) || 'Netsales' || chr(9) || '5' || chr(10) || 'Costs' || chr(9) || '3' || chr(10) || '[/TABLE]'),
        ('table', 'plain', 'a' || chr(10) || 'Net ' || chr(10) || 'sales' || chr(10) || '5' || chr(10) || ' ' || chr(10) || 'Costs' || chr(10) || '3')) t(name, parser, text)""")
def html_renderings(spark: SparkSession, d: str) -> DataFrame:
    made = html.parse_html(_pages(spark), ["name"], "html")
    return made.where("name = 'plain' or name = 'table' and parser <> 'marked'")


@query(r"""
    select * from (values ('heads', 0, 'FRONT', ''), ('heads', 1, '1', 'Business'), ('heads', 2, '1A', 'Risk'), ('contents', 0, 'FRONT', '')) t(name, section_pos, item_id, item_title)""")
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    """A cross reference and the headings of a table of contents open no section."""
    made = html.split_html(_pages(spark).where("name in ('heads', 'contents')"), ["name"], "html")
    return made.select("name", "section_pos", "item_id", "item_title")


@query(f"""
    with r as (select distinct on (record_id) record_id, accession, text, regexp_extract(item_id, '-([0-9]+[A-Z]?)$', 1) as item_id from records where text is not null),
    z as (select *, list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, {_STRIP}) <> '') as l from r),
    g as (select *, not (len(l) >= 3 and len(list_filter(l, lambda x: regexp_matches(x, '\\t[^\\t\\n]*\\t[0-9]{{1,4}}(-[0-9]{{1,4}})?[{_WS}]*$'))) >= 0.5 * len(l)) as good from z)
    select record_id, item_id from g qualify count(*) over (partition by accession, item_id) = 1 or good or count(*) filter (good) over (partition by accession, item_id) = 0""")
def contents_dropped(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where("text is not null").select("record_id", "accession", "text", F.regexp_extract("item_id", r"-([0-9]+[A-Z]?)$", 1).alias("item_id"))
    return sections.drop_contents_duplicates(r, ["accession"]).select("record_id", "item_id")


@query(f"""
    with r as (select distinct on (record_id) record_id, accession, form, case when item_id like '%FRONT' then 'FRONT' else regexp_extract(item_id, '([0-9]+[A-Z]?)$', 1) end as item from records),
    o as (select *, count(*) filter (item = '1') over (partition by accession order by record_id rows unbounded preceding) as ones from r)
    select record_id, case when item = 'FRONT' then item when form = '10-K' then coalesce(m.part, '?') || '-' || item when form = '10-Q' then case when ones >= 2 then 'II-' else 'I-' end || item else item end as item_id
    from o left join (values {_PART_ROWS}) m(i, part) on m.i = item""")
def parts_assigned(spark: SparkSession, d: str) -> DataFrame:
    item = F.when(F.col("item_id").like("%FRONT"), "FRONT").otherwise(F.regexp_extract("item_id", r"([0-9]+[A-Z]?)$", 1))
    r = _records(spark, d).select("record_id", "accession", "form", F.col("record_id").alias("section_pos"), item.alias("item_id"))
    return sections.assign_parts(r, ["accession"]).select("record_id", "item_id")


# --------------------------------------------------------------- sources and sinks
def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(prepare(spark))}/filingloom/{name}-{uuid.uuid4().hex}"


@query("select coalesce(accession, '') as accession, coalesce(company, '') as company, coalesce(local_path, '') as local_path, size_bytes, epoch_us(downloaded_at) as downloaded_us from manifest")
def manifest_csv(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as CSV and read back under its schema."""
    path = _folder(spark, "manifest")
    files.write_csv(table(spark, d, "manifest").withColumn("downloaded_at", F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")), path)
    back = files.read_manifest(spark, path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("accession", "company", "local_path")], "size_bytes", F.unix_micros("downloaded_at").alias("downloaded_us"))


@query("select record_id, item_title, sha256(text) as text_hash, char_count from (select distinct on (record_id) * from records)")
def records_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The records written as JSON lines and read back."""
    path = _folder(spark, "records")
    r = _records(spark, d).select("record_id", "item_title", "text", "char_count")
    files.write_jsonl(r, path)
    return files.read_jsonl(spark, path, r.schema).select("record_id", "item_title", F.sha2("text", 256).alias("text_hash"), "char_count")


@query("""
    with f as (select distinct accession, company from manifest where accession is not null),
    g as (select accession, string_agg(coalesce(company, '') , chr(10) order by coalesce(company, '')) as t from f group by accession)
    select accession || '.htm' as name, octet_length(encode(t))::bigint as size, sha256(t) as sha256 from g""")
def raw_documents(spark: SparkSession, d: str) -> DataFrame:
    """One raw file per filing: written as bytes, listed, read and matched by name."""
    path = _folder(spark, "raw").removeprefix("file://")
    m = table(spark, d, "manifest").where("accession is not null").select("accession", F.coalesce("company", F.lit("")).alias("company")).distinct()
    content = m.groupBy("accession").agg(F.array_join(F.array_sort(F.collect_list("company")), "\n").alias("t"))  # the few names of a filing
    rows = content.select(F.concat("accession", F.lit(".htm")).alias("local_path"), F.encode("t", "utf-8").alias("content"))
    listed = materialize(files.write_files(rows, path, "local_path", "content"), "written")
    found, _ = files.with_documents(listed.withColumnRenamed("name", "local_path"), files.read_documents(spark, path))
    return files.decode_utf8(found, "content", "t").select(F.col("local_path").alias("name"), F.col("bytes").alias("size"), F.sha2("t", 256).alias("sha256"))


@query("select distinct trim(question) as line from eval_items where trim(question) <> '' and not starts_with(trim(question), '#')")
def question_lines(spark: SparkSession, d: str) -> DataFrame:
    """The questions as a file of lines with comments and blank lines between."""
    path = _folder(spark, "questions")
    q = table(spark, d, "eval_items").select(F.explode(F.array(F.col("question"), F.lit("# a comment"), F.lit("   "))).alias("value"))
    q.write.text(path)
    return files.read_lines(spark, path).distinct()


@query("select 'tables' as parser, count(*) as texts from (select distinct record_id from records where text is not null) union all select 'plain', count(*) from (select distinct record_id from records where text is not null)")
def texts_by_parser(spark: SparkSession, d: str) -> DataFrame:
    """Renderings written one folder per parser; line ends are escaped, so a text is a line."""
    path = _folder(spark, "texts")
    made = html.parse_html(_records(spark, d).where("text is not null"), ["record_id"], "text", ["tables", "plain"])
    files.write_texts(made.withColumn("text", F.concat(F.lit("|"), F.translate("text", "\n\r", "  "))), path, "parser", "text", compression="gzip")
    return spark.read.text(path).groupBy("parser").agg(F.count("*").alias("texts"))


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records").select("record_id", "text").distinct()
    return html.parse_html(r, ["record_id"], "text").select("record_id", "parser", F.sha2("text", 256).alias("text_hash"))


# ------------------------------------------------------------------------ answers
_RUN = "r as (select distinct on (run_row) * from run_20261012t174720z)"
_CITED = r"list_sort(list_distinct(list_filter(list_transform(flatten(list_transform(list_filter(regexp_extract_all(coalesce(answer, ''), '\[([^\[\]]+)\]', 1), lambda g: contains(g, '|')), lambda g: regexp_split_to_array(g, '[,;]'))), lambda p: trim(p)), lambda p: p <> '')))"


@query(f"""
    with {_RUN}, c as (select run_row, {_CITED} as cited, list_transform(retrieved, lambda x: x.chunk_id) as ids from r),
    f as (select run_row, cited, list_filter(cited, lambda x: not list_contains(ids, x)) as fabricated from c)
    select run_row, array_to_string(cited, ';') as cited, array_to_string(fabricated, ';') as fabricated, len(fabricated) = 0 as valid from f""")
def citations_verified(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run_20261012t174720z").dropDuplicates(["run_row"]).select("run_row", "answer", F.col("retrieved.chunk_id").alias("ids"))
    checked = answers.verify_citations(run, "answer", "ids")
    return checked.select("run_row", F.array_join("cited", ";").alias("cited"), F.array_join("fabricated", ";").alias("fabricated"), "valid")


@query(f"""
    with {_RUN}, w as (select *, row_number() over (order by run_row) as rn from r)
    select 1 as run, count(*) as questions, count(*) filter (len(fabricated_citations) > 0) as fabricated_answers, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens,
        list_sort(list(retrieval_ms) filter (rn > 1 and retrieval_ms is not null))[count(retrieval_ms) filter (rn > 1) // 2 + 1] as retrieval_ms_warm,
        list_sort(list(generation_ms) filter (generation_ms is not null))[count(generation_ms) // 2 + 1] as generation_ms from w""")
def run_metrics(spark: SparkSession, d: str) -> DataFrame:
    """One run has one group, so its medians come from counts, not from one sort."""
    run = table(spark, d, "run_20261012t174720z").select("run_row", "fabricated_citations", "retrieval_ms", "generation_ms", "input_tokens", "output_tokens").dropDuplicates(["run_row"])
    return answers.run_metrics(run.withColumn("run", F.lit(1)), "run", "run_row")


@query(f"""
    with {_RUN}, e as (select run_row, unnest(retrieved) as x from r), c as (select distinct on (chunk_id) * from chunks),
    b as (select run_row, x.rank as rank, '[' || chunk_id || '] ' || coalesce(c.company, '') || ' (' || coalesce(c.ticker, '') || '), ' || coalesce(c.form, '') || ' for period ' || coalesce(c.report_date, '') || ', ' || coalesce(c.item_title, '') || ':' || chr(10) || coalesce(c.text, '') as block
        from e join c on c.chunk_id = x.chunk_id)
    select run_row, sha256(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)) as context_hash from b group by run_row""")
def answer_context(spark: SparkSession, d: str) -> DataFrame:
    run = table(spark, d, "run_20261012t174720z").dropDuplicates(["run_row"]).select("run_row", F.explode("retrieved").alias("x")).select("run_row", "x.rank", "x.chunk_id")
    # only the retrieved chunks are deduplicated
    chunks = table(spark, d, "chunks").select("chunk_id", "company", "ticker", "form", "report_date", "item_title", "text")
    wanted = chunks.join(run.select("chunk_id").distinct(), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return retrieval.context(run.join(wanted, "chunk_id"), "run_row").select("run_row", F.sha2("context", 256).alias("context_hash"))


@query()
def answer_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Records to chunks to vectors to answers, with the offline encoder and generator."""
    encoder = retrieval.hashing_encoder()
    index = materialize(pipeline.index_of(_records(spark, d), encoder), "index")
    asked = table(spark, d, "eval_items").select(F.col("item_id").alias("question_id"), "question")
    return pipeline.answer_questions(asked, index, encoder, answers.echo_generator).select("question_id", "answer", F.size("retrieved").alias("retrieved"), "citations_valid")


@query("select run_row, len(list_filter(regexp_split_to_array(question, '[\\s]+'), lambda w: w <> ''))::int as words from (select distinct run_row, question from run_20261012t174720z)")
def question_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "run_20261012t174720z").select("run_row", "question").distinct().select("run_row", F.size(uwords(F.col("question"))).alias("words"))


# ---------------------------------------------------------------------- streaming
@query("""
    with r as (select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events)
    select user_id, ts, event_id from r where rn = 1""")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files into a table of each user's latest event: two
    files are two micro-batches, then one is delivered again to the restarted stream."""
    base = _folder(spark, "ingest")
    events = table(spark, d, "events")
    half = F.pmod(F.xxhash64("event_id"), F.lit(2))

    def deliver(n: int) -> None:
        events.where(half == n).coalesce(1).write.mode("append").parquet(f"{base}/landing")

    def run() -> None:
        stream = landing_stream(spark, f"{base}/landing", events.schema, per_trigger=1)
        ingest(stream, f"{base}/table", ["user_id"], "ts", f"{base}/checkpoint", ["event_id"]).awaitTermination()

    deliver(0)
    deliver(1)
    run()
    deliver(0)
    run()
    return current(spark, f"{base}/table", ["user_id"], "ts", ["event_id"]).select("user_id", "ts", "event_id")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
