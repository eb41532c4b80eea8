"""The queries of the training-data operators, and the SQL of those SQL can state."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.llm.confusables import lookalike_groups, one_form
from filingloom.llm.leakage import find_leaks
from filingloom.llm.markup import hinted, strip_markup
from filingloom.llm.mojibake import repair_encoding
from filingloom.llm.near_dups import link_counts, linked_pairs, near_duplicates
from filingloom.llm.packing import bpe_sizer, pack
from filingloom.llm.pairs_crf import TAGS, Languages, broken_pairs, fit_languages
from filingloom.llm.site_lines import flagged_lines, remove_repeated_lines, scored_lines
from filingloom.llm.splitting import split_oversized
from filingloom.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = os.environ.get("FILINGLOOM_TOKENIZERS", "/opt/tokenizers")
#: How the byte-level BPE splits a text before it merges (fixed value).
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _languages(spark: SparkSession, sf_dir: str) -> Languages:
    """Language profiles from the labelled rows of documents, 150 a language."""
    return fit_languages(_table(spark, sf_dir, "documents"), "text", "lang", "doc_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _table(spark, sf_dir, "run_20261012t174720z")
    return broken_pairs(run, ["run_row"], "question", "answer", only_defects=True, languages=_languages(spark, sf_dir)).select("run_row", "defect").distinct()


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each answer's defect and the shares of its prose under each tag, beside the run's own
    hints, which can mislead."""
    run = _table(spark, sf_dir, "run_20261012t174720z")
    run = run.select("run_row", "question", "answer", "stop_reason", "citations_valid").dropDuplicates(["run_row"])
    judged = broken_pairs(run, ["run_row", "stop_reason", "citations_valid"], "question", "answer", languages=_languages(spark, sf_dir))
    return judged.select("run_row", "stop_reason", "citations_valid", "defect", *[F.round(t, 6).alias(t) for t in TAGS])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = one_form(_table(spark, sf_dir, "records"), ["record_id"], "text", only_changed=True, with_text=False)
    chunks = one_form(_table(spark, sf_dir, "chunks"), ["chunk_id"], "item_title", only_changed=True, with_text=False)
    return (
        records.select(F.lit("records").alias("tab"), F.col("record_id").cast("string").alias("item_key"))
        .unionByName(chunks.select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("item_key")))
        .distinct()
    )


def p2_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored values of each field that look equal: of titles, and of texts."""
    records = lookalike_groups(_table(spark, sf_dir, "records"), "text").withColumn("tab", F.lit("records"))
    chunks = lookalike_groups(_table(spark, sf_dir, "chunks"), "item_title").withColumn("tab", F.lit("chunks"))
    columns = ("tab", "skeleton", "n_rows", "n_forms", "form")
    return records.select(*columns).unionByName(chunks.select(*columns))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one form of each text and title that is not stored in it."""
    records = one_form(_table(spark, sf_dir, "records"), ["record_id"], "text", only_changed=True)
    chunks = one_form(_table(spark, sf_dir, "chunks"), ["chunk_id"], "item_title", only_changed=True)
    form = F.sha2("form", 256).alias("form_hash")
    return (
        records.select(F.lit("records").alias("tab"), F.col("record_id").cast("string").alias("item_key"), form)
        .unionByName(chunks.select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("item_key"), form))
        .distinct()
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the rule of TESTDATA.md; the method's verdict on each is in p3_lines and
    drops none, as what stands in other tickers plays no part in the rule."""
    return flagged_lines(_table(spark, sf_dir, "records"), "record_id", "ticker", "text", by_rule=True)


def p3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of p3_found, each at its first place in its ticker, with the likelihood ratio
    of its documents within and outside, and whether the false-discovery cut keeps it."""
    lines = scored_lines(_table(spark, sf_dir, "records"), "record_id", "ticker", "text")
    return lines.select(F.col("source").alias("ticker"), "record_id", "line_no", "docs", "docs_outside", F.round("ratio", 6).alias("ratio"), F.round("p", 12).alias("p"), "significant")


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = remove_repeated_lines(_table(spark, sf_dir, "records"), "record_id", "ticker", "text", by_rule=True)
    return clean.select("record_id", F.sha2("clean_text", 256).alias("clean_hash"), "removed_lines")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = strip_markup(_table(spark, sf_dir, "records"), ["record_id"], "text", only_marked=True, with_text=False)
    return marked.select("record_id", F.explode("languages").alias("markup")).distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each filing's local_path hints at the kind of its file; only texts that can hold
    markup meet it."""
    records = _table(spark, sf_dir, "records").select("record_id", "accession", "text").where(hinted(F.col("text")))
    paths = _table(spark, sf_dir, "manifest").where("accession is not null").groupBy("accession").agg(F.max("local_path").alias("local_path"))
    clean = strip_markup(records.join(paths, "accession", "left"), ["record_id"], "text", only_marked=True, path="local_path")
    return clean.select("record_id", F.length("clean_text").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_hash")).distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = split_oversized(_table(spark, sf_dir, "records"), ["record_id"], "text", with_text=False, only_split=True)
    chunks = split_oversized(_table(spark, sf_dir, "chunks"), ["chunk_id"], "text", with_text=False, only_split=True)
    return (
        records.where("piece_index = 0").select(F.lit("records").alias("tab"), F.col("record_id").cast("string").alias("item_key"))
        .unionByName(chunks.where("piece_index = 0").select(F.lit("chunks").alias("tab"), F.col("chunk_id").alias("item_key")))
        .distinct()
    )


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all records and chunks with their sizes, cuts and content hashes."""
    records = split_oversized(_table(spark, sf_dir, "records"), ["record_id"], "text").withColumn("tab", F.lit("records")).withColumn("item_key", F.col("record_id").cast("string"))
    chunks = split_oversized(_table(spark, sf_dir, "chunks"), ["chunk_id"], "text").withColumn("tab", F.lit("chunks")).withColumn("item_key", F.col("chunk_id"))
    columns = ("tab", "item_key", "piece_index", "n_pieces", "n_tokens", "shared_chars", "cut", F.sha2("piece", 256).alias("piece_hash"))
    return records.select(*columns).unionByName(chunks.select(*columns)).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every link between different texts, and every copy's to its representative; what
    single records of two classes have beside those is in p6_links."""
    return linked_pairs(*near_duplicates(_table(spark, sf_dir, "records"), "record_id", "text"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all pairs can be rebuilt from, whatever the size of a class: the near pairs
    between representatives, and with ``is_copy`` each other member of a class of exact
    copies (record_b) under its representative (record_a)."""
    pairs, members = near_duplicates(_table(spark, sf_dir, "records"), "record_id", "text")
    near = pairs.select(F.col("a").alias("record_a"), F.col("b").alias("record_b"), F.lit(False).alias("is_copy"))
    copies = members.where("rep <> member").select(F.col("rep").alias("record_a"), F.col("member").alias("record_b"), F.lit(True).alias("is_copy"))
    return near.unionByName(copies)


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its representative and the number of its equal and near records."""
    return link_counts(*near_duplicates(_table(spark, sf_dir, "records"), "record_id", "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", text="text")
    return packed.where("n_parts > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The containers with their parts and tokens."""
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", text="text").where("container is not null")
    return packed.groupBy("container").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))


def p7_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's parts and tokens as they were packed, none lost and none twice."""
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", text="text")
    return packed.groupBy("doc_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))


def p7_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The containers measured in tokens of a public byte-level BPE."""
    sizer = bpe_sizer(f"{tokenizers}/byte_bpe_50k.tiktoken", BPE_PATTERN)
    packed = pack(_table(spark, sf_dir, "documents"), "doc_id", text="text", sizer=sizer).where("container is not null")
    return packed.groupBy("container").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("tokens"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one word in eight: of any eight words of the run in a row."""
    found = find_leaks(_table(spark, sf_dir, "documents"), ["doc_id"], "text", _table(spark, sf_dir, "eval_items"), "item_id", ["question", "passage"], spaced=True)
    return found.select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_encoding(_table(spark, sf_dir, "documents"), ["doc_id"], "text", only_garbled=True, with_text=False).select("doc_id").distinct()


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = repair_encoding(_table(spark, sf_dir, "documents"), ["doc_id"], "text", only_garbled=True)
    return fixed.select("doc_id", F.array_join(F.array_sort("operations"), " ").alias("operations"), F.sha2("restored", 256).alias("restored_hash"))


def queries() -> dict[str, Query]:
    own = (p1_found, p1_shares, p2_found, p2_titles, p2_forms, p3_found, p3_lines, p3_clean, p4_found, p4_clean, p5_found, p5_pieces, p6_found, p6_classes, p6_links, p7_found, p7_containers, p7_parts, p8_found, p9_found, p9_restored)
    if os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"):
        own += (p7_bpe,)
    return {f.__name__: f for f in own}


#: The token of TESTDATA.md for DuckDB's regular expressions.
_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SPACE = r"[\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: All pairs of records (p) by brute force over shared shingles.
_PAIRS = rf"""
        with u as (select distinct record_id, text from records where length(text) >= 200),
        t as (select record_id, list_filter(regexp_split_to_array(text, '{_SPACE}+'), lambda w: w <> '') as w from u),
        s as (select distinct record_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from t where len(w) > 0),
        h as (select record_id, hash(g) as g from s),
        n as (select record_id, count(*) as n from h group by all),
        c as (select a.record_id as record_a, b.record_id as record_b, count(*) as c from h a join h b on a.g = b.g and a.record_id < b.record_id group by all),
        p as (select record_a, record_b from c join n x on x.record_id = record_a join n y on y.record_id = record_b where c >= 0.7 * (x.n + y.n - c))"""

#: Numbered lines of the records with their normal form (n) and the flagged ones (f).
_REPEATED = rf"""
        with r as (select distinct record_id, coalesce(ticker, '') as ticker, text from records where record_id is not null and text is not null),
        l as (select record_id, ticker, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from r),
        t as (select record_id, ticker, line_no, line as raw, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') as line from l),
        n as (select record_id, ticker, line_no, raw, line, regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '[0-9]+', '#', 'g') as norm from t),
        f as (select ticker, norm from n where length(line) >= 25 group by all having count(distinct record_id) >= 8)"""

ORACLE = {
    "p3_clean": f"""{_REPEATED},
        m as (select n.*, length(line) >= 25 and f.norm is not null as gone from n left join f using (ticker, norm)),
        c as (select record_id, string_agg(raw, chr(10) order by line_no) filter (not gone) as clean, (count(*) filter (gone))::int as removed_lines from m group by record_id)
        select record_id, sha256(coalesce(clean, '')) as clean_hash, removed_lines from c
        union all select distinct record_id, null, 0 from records where text is null""",
    "p3_lines": f"""{_REPEATED},
        g as (select ticker, norm, count(distinct record_id) as docs, min({{'k': record_id, 'i': line_no}}) as place from n where length(line) >= 25 group by all),
        d as (select coalesce(ticker, '') as ticker, count(distinct record_id) as n1 from records where record_id is not null group by all),
        w as (select ticker, place, docs, (sum(docs) over (partition by norm) - docs)::bigint as docs_outside, n1, ((select sum(n1) from d) - n1)::bigint as n2 from g join d using (ticker)),
        v as (select *, docs::double as k1, n1::double as m1, (case when n2 > 0 then docs_outside else 0 end)::double as k2, (case when n2 > 0 then n2 else n1 end)::double as m2 from w where docs >= 8),
        s as (select *, (k1 + k2) / (m1 + m2) as q from v),
        x as (select *, case when k1 * m2 > k2 * m1 then greatest(2 * (
            k1 * ln(k1 / (m1 * q)) + case when m1 > k1 then (m1 - k1) * ln((m1 - k1) / (m1 * (1 - q))) else 0 end
            + case when k2 > 0 then k2 * ln(k2 / (m2 * q)) else 0 end + case when m2 > k2 then (m2 - k2) * ln((m2 - k2) / (m2 * (1 - q))) else 0 end), 0) else 0 end::double as ratio from s),
        z as (select *, 1 / (1 + 0.3275911::double * sqrt(ratio / 2)) as u from x),
        p as (select *, case when ratio > 0 then least(u * (0.254829592::double + u * (-0.284496736::double + u * (1.421413741::double + u * (-1.453152027::double + u * 1.061405429::double)))) * exp(-ratio / 2), 1) else 1 end::double as p from z),
        b as (select *, count(*) over () * p <= 0.01::double * count(*) over (order by p range between unbounded preceding and current row) as kept from p),
        c as (select max(p) filter (kept) as cut from b)
        select ticker, place.k as record_id, place.i::bigint as line_no, docs, docs_outside, round(ratio, 6) as ratio, round(p, 12) as p, coalesce(p <= cut, false) as significant from b cross join c""",
    "p7_parts": f"""
        with d as (select doc_id, coalesce(len(regexp_extract_all(text, '{_TOKEN}')), 0) as n from documents)
        select doc_id, greatest(ceil(n / 2048.0), 1)::bigint as parts, n::bigint as tokens from d""",
    "p3_found": rf"""
        with r as (select distinct record_id, coalesce(ticker, '') as ticker, text from records where record_id is not null and text is not null),
        l as (select record_id, ticker, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as line_no from r),
        t as (select record_id, ticker, line_no, regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g') as line from l),
        n as (select record_id, ticker, line_no, regexp_replace(regexp_replace(lower(line), '{_SPACE}+', ' ', 'g'), '[0-9]+', '#', 'g') as norm from t where length(line) >= 25),
        f as (select ticker, norm from n group by all having count(distinct record_id) >= 8)
        select distinct record_id, line_no::bigint as line_no from n semi join f using (ticker, norm)""",
    "p5_found": rf"""
        select 'records' as tab, record_id::varchar as item_key from records where len(regexp_extract_all(text, '{_TOKEN}')) > 500
        union select 'chunks', chunk_id from chunks where len(regexp_extract_all(text, '{_TOKEN}')) > 500""",
    "p6_found": f"""{_PAIRS},
        m as (select record_id, min(record_id) over (partition by text) as rep from u)
        select record_a, record_b from p join m x on x.record_id = record_a join m y on y.record_id = record_b where record_a = x.rep or record_b = y.rep""",
    "p6_classes": f"""{_PAIRS},
        m as (select record_id, min(record_id) over (partition by text) as rep from u)
        select record_a, record_b, x.rep = y.rep as is_copy from p join m x on x.record_id = record_a join m y on y.record_id = record_b
        where record_a = x.rep and (x.rep = y.rep or record_b = y.rep)""",
    "p6_links": f"""{_PAIRS},
        m as (select record_id, min(record_id) over (partition by text) as rep from u),
        e as (select record_a as record, record_b as o from p union all select record_b, record_a from p)
        select record, rep, count(*) as links from e join m on record_id = record group by all""",
    "p7_found": rf"select doc_id from documents where len(regexp_extract_all(text, '{_TOKEN}')) > 2048",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
