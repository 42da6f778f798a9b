"""Scalar text operators over the stored texts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import patterns as P
from dealweave.functions import text as X
from dealweave.functions.markup import cells_of, visual_text_udf
from dealweave.session import read_table


def stored_pages(spark: SparkSession, root: str) -> DataFrame:
    """(record_table, id, markup) of filings and exhibits; ids are of their table."""
    one = read_table(spark, root, "filings").select(F.lit("filings").alias("record_table"), "id", F.col("raw_html").alias("markup"))
    return one.unionByName(read_table(spark, root, "exhibits").select(F.lit("exhibits").alias("record_table"), "id", F.col("raw_content").alias("markup")))


def stored_cells(spark: SparkSession, root: str) -> DataFrame:
    """Grid places of every table of the stored pages; ``key`` is (record_table, id)."""
    pages = stored_pages(spark, root)
    of = lambda t: cells_of(pages.filter(F.col("record_table") == t), "id", "markup").withColumn("key", F.struct(F.lit(t).alias("record_table"), "id")).drop("id")
    return of("filings").unionByName(of("exhibits"))


def t1_visual_text(spark: SparkSession, root: str) -> DataFrame:
    """Visible text of every stored page."""
    return stored_pages(spark, root).select("record_table", "id", X.normalize_text(visual_text_udf("markup")).alias("visual_text")).filter("visual_text is not null")


def t2_normalized_text(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("normalized"))


def t3_preambles(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "exhibits").select("id", X.preamble(F.col("visual_text")).alias("preamble"))


def t4_quality(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("visual_text")
    return read_table(spark, root, "exhibits").select("id", X.word_count(c).cast("bigint").alias("words"), X.quality(c).alias("quality"))


def t5_preamble_digest(spark: SparkSession, root: str) -> DataFrame:
    c = F.col("visual_text")
    return read_table(spark, root, "exhibits").filter(c.isNotNull()).select("id", F.sha2(X.preamble(c), 256).alias("preamble_hash"), F.substring(c, 1, 500).alias("preview"))


_GATES = {
    "merger_header": P.MERGER_HEADER,
    "sponsor_keywords": P.SPONSOR_KEYWORDS,
    "equity_commitment": P.EQUITY_COMMITMENT,
    "sponsor_negated": P.SPONSOR_NEGATION,
    "item_101": P.ITEM_101,
    "item_801": P.ITEM_801,
    "definitive_agreement": P.DEFINITIVE_AGREEMENT,
    "purchase_agreement": P.PURCHASE_AGREEMENT,
}


def r_gates(spark: SparkSession, root: str) -> DataFrame:
    """Which gates each document passes."""
    c = F.col("text")
    return read_table(spark, root, "documents").select("doc_id", *[F.coalesce(c.rlike(p), F.lit(False)).alias(n) for n, p in _GATES.items()])


def r13_currency_amounts(spark: SparkSession, root: str) -> DataFrame:
    """Amounts per document and value."""
    d = read_table(spark, root, "documents").filter(F.col("text").contains("$"))
    x = d.select("doc_id", F.explode(X.currency_amounts(F.col("text"))).alias("a"))
    return x.groupBy("doc_id", F.col("a.raw").alias("raw"), F.col("a.value_usd").alias("value_usd")).agg(F.count(F.lit(1)).alias("n"))


def r14_agreement_dates(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").select("doc_id", X.agreement_date(F.col("text")).alias("agreement_date"))
    return d.filter("agreement_date is not null")


def r8_sponsor_affiliations(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(P.SPONSOR_AFFILIATION), F.lit(1))).alias("s"))
    return d.groupBy("doc_id", F.trim("s").alias("sponsor_raw")).agg(F.count(F.lit(1)).alias("n"))


def r15_party_names(spark: SparkSession, root: str) -> DataFrame:
    """Distinct typed party names with their grouping and display forms."""
    d = read_table(spark, root, "deals")
    names = d.select(F.col("acquirer_name_raw").alias("raw")).unionByName(d.select(F.col("target_name_raw").alias("raw"))).filter("raw is not null").distinct()
    return names.select("raw", X.normalize_party(F.col("raw")).alias("normalized"), X.display_party(F.col("raw")).alias("display"))


def b2_bank_names(spark: SparkSession, root: str) -> DataFrame:
    """Distinct typed bank names without endings, and without pieces anywhere."""
    n = read_table(spark, root, "financing_participants").select(F.col("bank_name_raw").alias("raw")).filter("raw is not null").distinct()
    return n.select("raw", X.cut_bank_endings(F.col("raw")).alias("name_cut"), X.drop_bank_pieces(F.col("raw")).alias("name_dropped"))


def m6_roles(spark: SparkSession, root: str) -> DataFrame:
    r = read_table(spark, root, "financing_participants").filter("role is not null")
    return r.groupBy(X.canonical_role(F.col("role")).alias("role_normalized")).agg(F.count(F.lit(1)).alias("participants"))


def h1_table_cells(spark: SparkSession, root: str) -> DataFrame:
    """Grid places of every table of the stored pages."""
    return stored_cells(spark, root).select("key.record_table", "key.id", "table_no", "row_no", "col_no", "text", "is_header")


def _sql(pattern: str) -> str:
    """Pattern in RE2's spelling, quoted for SQL."""
    return "'" + pattern.replace("(?md)", "").replace("'", "''") + "'"


_T2 = f"translate(text, '{P.TYPOGRAPHIC}', '{P.PLAIN.replace(chr(39), chr(39) * 2)}')"
_SCALE = "case lower(s) when 'million' then 1e6 when 'mil' then 1e6 when 'm' then 1e6 when 'mm' then 1e6 when 'billion' then 1e9 when 'b' then 1e9 when 'bn' then 1e9 else 1.0 end"
_WORDS = "case when visual_text is null then null when regexp_replace(visual_text, '^\\s+|\\s+$', '', 'g') = '' then 0 else len(string_split_regex(regexp_replace(visual_text, '^\\s+|\\s+$', '', 'g'), '\\s+')) end"
_STRIP = "regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '^[ ,.\\-]+|[ ,.\\-]+$', '', 'g')"


def _norm_sql() -> str:
    c = "regexp_replace(raw, '\\([^)]*\\)', '', 'g')"
    for p in (P.JURISDICTION, P.COMPANY_SUFFIX, P.COMPANY_SUFFIX_COMMA):
        c = f"regexp_replace({c}, {_sql(p)}, '', 'g')"
    return f"lower({_STRIP.format(c)})"


def _endings_sql(c: str = "raw") -> str:
    c = f"lower(regexp_replace({c}, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g'))"
    for end in (
        ", n\\.a\\.", " n\\.a\\.", ", na", " na", ", inc\\.", " inc\\.", ", inc", " inc", ", llc", " llc", ", ltd", " ltd", " plc", " ag", " sa", " nv", " bv", " securities", " capital", " bank",
        "\\& co\\.", "\\& co", " \\& company",
    ):
        c = f"regexp_replace({c}, '{end}$', '')"
    return f"trim(regexp_replace({c}, '[\\s\u00a0]+', ' ', 'g'))"


def _pieces_sql() -> str:
    c = "lower(regexp_replace(raw, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g'))"
    for e in (", n.a.", " n.a.", ", na", ", inc", " inc", " llc", " ltd"):
        c = f"replace({c}, '{e}', '')"
    return f"trim(regexp_replace({c}, '[\\s\u00a0]+', ' ', 'g'))"


_ROLE_SQL = """case
  when contains(r, 'bookrunner') then case when contains(r, 'joint') then 'joint_bookrunner' else 'bookrunner' end
  when contains(r, 'co-manager') or contains(r, 'co manager') then 'co_manager'
  when contains(r, 'underwriter') then case when contains(r, 'lead') or contains(r, 'senior') then 'lead_underwriter' else 'underwriter' end
  when contains(r, 'arranger') then case when contains(r, 'joint') and contains(r, 'lead') then 'joint_lead_arranger'
    when contains(r, 'lead') or contains(r, 'mandated') then 'lead_arranger' else 'arranger' end
  when contains(r, 'admin') and contains(r, 'agent') then 'admin_agent'
  when contains(r, 'syndication') then 'syndication_agent'
  when contains(r, 'agent') then 'agent' else r end"""


_AMOUNT = "'(?i)\\$\\s?(\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?)\\s*(billion|million|b|m|bn|mm|mil)?'"
_AFFILIATION = "'(?i)(?:affiliates?\\s+of|funds?\\s+managed\\s+by|portfolio\\s+compan(?:y|ies)\\s+of|controlled\\s+by)\\s+([A-Z][A-Za-z0-9\\s,&.''-]{2,80}?)(?:\\.|,|;|\\s+and\\b|\\s+\\)|$)'"


def _date_sql() -> str:
    head = "left(text, 1000)"

    def month(x: str) -> str:
        return f"strftime(try_strptime(regexp_replace(replace({x}, ',', ''), '\\s+', ' ', 'g'), '%B %-d %Y'), '%Y-%m-%d')"

    g = lambda p, k=1: f"nullif(regexp_extract({head}, {_sql(p)}, {k}), '')"
    day_of = f"({g(P.DATE_DAY_OF, 2)} || ' ' || {g(P.DATE_DAY_OF, 1)} || ' ' || {g(P.DATE_DAY_OF, 3)})"
    return f"coalesce({month(g(P.DATE_DATED))}, {month(g(P.DATE_ENTERED))}, {month(day_of)}, {g(P.DATE_ISO)})"


QUERIES = {
    "t1_visual_text": t1_visual_text,
    "t2_normalized_text": t2_normalized_text,
    "t3_preambles": t3_preambles,
    "t4_quality": t4_quality,
    "t5_preamble_digest": t5_preamble_digest,
    "r_gates": r_gates,
    "r8_sponsor_affiliations": r8_sponsor_affiliations,
    "r13_currency_amounts": r13_currency_amounts,
    "r14_agreement_dates": r14_agreement_dates,
    "r15_party_names": r15_party_names,
    "b2_bank_names": b2_bank_names,
    "m6_roles": m6_roles,
    "h1_table_cells": h1_table_cells,
}
SQL = {
    "t2_normalized_text": f"""select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_T2}, '[ \\t]+', ' ', 'g'),
        '\\n{{3,}}', chr(10) || chr(10), 'g'), ' *\\n *', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') as normalized from documents""",
    "t3_preambles": "select id, left(visual_text, 5000) as preamble from exhibits",
    "t4_quality": f"""select id, words, case when coalesce(words, 0) = 0 then 'failed' when words < 50 then 'poor' else 'good' end as quality
        from (select id, cast({_WORDS} as bigint) as words from exhibits)""",
    "t5_preamble_digest": "select id, sha256(left(visual_text, 5000)) as preamble_hash, left(visual_text, 500) as preview from exhibits where visual_text is not null",
    "r_gates": "select doc_id, " + ", ".join(f"coalesce(regexp_matches(text, {_sql(p)}), false) as {n}" for n, p in _GATES.items()) + " from documents",
    "r8_sponsor_affiliations": f"""select doc_id, trim(s) as sponsor_raw, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(text, {_AFFILIATION}, 1)) as s from documents) group by 1, 2""",
    "r13_currency_amounts": f"""select doc_id, raw, try_cast(replace(num, ',', '') as double) * {_SCALE} as value_usd, count(*) as n from (
        select doc_id, unnest(regexp_extract_all(text, {_AMOUNT}, 0)) as raw, unnest(regexp_extract_all(text, {_AMOUNT}, 1)) as num,
          unnest(regexp_extract_all(text, {_AMOUNT}, 2)) as s from documents) group by 1, 2, 3""",
    "r14_agreement_dates": f"select * from (select doc_id, {_date_sql()} as agreement_date from documents) where agreement_date is not null",
    "r15_party_names": f"""select raw, {_norm_sql()} as normalized,
        {_STRIP.format(f"regexp_replace(regexp_replace(raw, '\\s*\\([^)]*\\)\\s*', ' ', 'g'), {_sql(P.JURISDICTION)}, '', 'g')")} as display
        from (select acquirer_name_raw as raw from deals union select target_name_raw from deals) where raw is not null""",
    "b2_bank_names": f"""select raw, {_endings_sql()} as name_cut, {_pieces_sql()} as name_dropped
        from (select distinct bank_name_raw as raw from financing_participants where bank_name_raw is not null)""",
    "m6_roles": f"""select {_ROLE_SQL} as role_normalized, count(*) as participants
        from (select lower(regexp_replace(role, '^[\\s\u00a0]+|[\\s\u00a0]+$', '', 'g')) as r from financing_participants where role is not null) group by 1""",
}
