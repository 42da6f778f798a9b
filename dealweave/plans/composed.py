"""Documents composed from the tables, read back by the document operators.

The stored texts hold few agreements, offerings or syndicate tables, so here
whole documents are written from the values of whole tables and taken apart
again.  The SQL of each query starts from the tables, not from the documents:
it states what must come back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.functions import markup
from dealweave.functions import patterns as P
from dealweave.functions import text as X
from dealweave.operators import cluster, facts, resolve, tables
from dealweave.plans.text_queries import _endings_sql
from dealweave.session import read_table
from dealweave.sources import edgar, files

# ------------------------------------------------------------------ documents


def agreements(spark: SparkSession, root: str) -> DataFrame:
    """(id, t): a merger preamble for every deal with an announcement and plain names of both parties."""
    plain = "acquirer_name_raw rlike '^[A-Za-z ]+$' and target_name_raw rlike '^[A-Za-z ]+$' and announcement_date is not null"
    d = read_table(spark, root, "deals").filter(plain)
    date = F.date_format("announcement_date", "MMMM d, yyyy")
    text = F.concat(
        F.lit("AGREEMENT AND PLAN OF MERGER dated as of "), date, F.lit(', by and among '), F.trim("acquirer_name_raw"), F.lit(' ("Parent") and '), F.trim("target_name_raw"),
        F.lit(' (hereinafter the "Company").'),
    )
    return d.select("id", text.alias("t"))


def _offer(kind: Column) -> Column:
    words = {"term_loan": "senior secured term loan", "rcf": "revolving credit facility", "bridge_loan": "bridge loan", "credit_facility": "credit facility"}
    return F.coalesce(X.lookup(kind, words), F.lit("Senior Notes due 2031"))


def offerings(spark: SparkSession, root: str) -> DataFrame:
    """(id, t): a notice for every financing event of a million or more, with its first plainly named bank if it has one."""
    e = read_table(spark, root, "financing_events").filter("amount_usd >= 1e6")
    p = read_table(spark, root, "financing_participants").filter("bank_name_raw rlike '^[A-Z][a-z]+( [A-Z][a-z]+)*$' and not lower(bank_name_raw) rlike 'lead|the|several'")
    first = p.groupBy(F.col("financing_event_id").alias("id")).agg(F.min_by("bank_name_raw", "id").alias("bank"))
    amount = F.concat(F.lit("$"), F.format_number(F.round(F.col("amount_usd") / 1e6).cast("bigint"), 0), F.lit(" million "))
    tail = F.coalesce(F.concat(F.lit(" with "), F.col("bank"), F.lit(", as representatives of the several underwriters.")), F.lit("."))
    text = F.concat(F.lit("Item 8.01 Other Events. The issuer entered into a purchase agreement for "), amount, _offer(F.col("instrument_type")), tail)
    return e.join(first, "id", "left").select("id", text.alias("t"))


def _escaped(c: Column) -> Column:
    for seen, meant in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(seen), F.lit(meant))
    return c


def syndicate_pages(spark: SparkSession, root: str) -> DataFrame:
    """(key, html): a page for every event with named participants; its table has a spanning first column."""
    p = read_table(spark, root, "financing_participants").filter("trim(bank_name_raw) <> '' and trim(role) <> ''")
    rows = p.groupBy(F.col("financing_event_id").alias("key")).agg(F.array_sort(F.collect_list(F.struct("id", "bank_name_raw", "role"))).alias("r"))
    cell = lambda c: F.concat(F.lit("<td>"), _escaped(c), F.lit("</td>"))
    span = F.concat(F.lit("<td rowspan=\""), F.size("r").cast("string"), F.lit("\">Tranche</td>"))
    line = F.transform("r", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, span).otherwise(""), cell(x["bank_name_raw"]), cell(x["role"]), F.lit("</tr>")))
    head = "<html><head><title>x</title><script>if (a<b) {}</script></head><body><p>Lenders &amp; roles</p><!-- no text --><table><tr><th>Part</th><th>Bank</th><th>Role</th></tr>"
    return rows.select("key", F.concat(F.lit(head), F.array_join(line, ""), F.lit("</table></body></html>")).alias("html"))


# ------------------------------------------------------------------ queries over them


def r1_parties(spark: SparkSession, root: str) -> DataFrame:
    """Parties of composed merger preambles with roles by defined term."""
    return facts.party_facts(agreements(spark, root), "id", "t")


def r5_terms(spark: SparkSession, root: str) -> DataFrame:
    """Defined terms of composed preambles."""
    terms = agreements(spark, root).select("id", F.explode(F.regexp_extract_all("t", F.lit(P.DEFINED_TERM), F.lit(1))).alias("label"))
    return terms.withColumn("role", X.role_of_label(F.col("label")))


def r7_labelled_parties(spark: SparkSession, root: str) -> DataFrame:
    return facts.labelled_parties(agreements(spark, root), "id", "t")


def r14_preamble_dates(spark: SparkSession, root: str) -> DataFrame:
    return agreements(spark, root).select("id", X.agreement_date(F.col("t")).alias("agreement_date"))


def r19_item_sections(spark: SparkSession, root: str) -> DataFrame:
    """The item 1.01 sections of composed bodies."""
    body = F.concat(F.lit("Item 1.01. Entry into a Material Definitive Agreement. "), F.col("t"), F.lit(" Item 8.01 Other Events. None."))
    return agreements(spark, root).select("id", facts.item_section(body).alias("section"))


def r22_offered_debt(spark: SparkSession, root: str) -> DataFrame:
    """Instruments of composed offering notices."""
    return facts.financing_facts(offerings(spark, root), "id", "t").select("id", "instrument_type", "amount_raw", "amount_usd", "maturity_year", "confidence")


def u3_named_underwriters(spark: SparkSession, root: str) -> DataFrame:
    return facts.underwriter_facts(offerings(spark, root), "id", "t").select("id", "name_raw", "name_normalized", "role", "confidence")


def f5_offer_participants(spark: SparkSession, root: str) -> DataFrame:
    """Each instrument of a notice with all underwriters of the notice."""
    notices = offerings(spark, root)
    debt = facts.financing_facts(notices, "id", "t").select("id", "instrument_type", "amount_usd")
    banks = facts.participants_of(facts._placed_underwriters(notices, "id", "t"), "id")
    shown = F.array_join(F.transform("participants", lambda x: F.concat(x["bank"], F.lit(": "), x["role"])), "; ")
    return debt.join(banks, "id", "left").select("id", "instrument_type", "amount_usd", shown.alias("underwriters"))


def t1_page_text(spark: SparkSession, root: str) -> DataFrame:
    """Visible text of composed pages."""
    return syndicate_pages(spark, root).select("key", X.normalize_text(markup.visual_text_udf("html")).alias("visual_text"))


def _cells(spark: SparkSession, root: str) -> DataFrame:
    return markup.cells_of(syndicate_pages(spark, root), "key", "html")


def h1_page_cells(spark: SparkSession, root: str) -> DataFrame:
    """Grid of the tables of composed pages, spanning cells repeated."""
    return _cells(spark, root)


def h3_header_rows(spark: SparkSession, root: str) -> DataFrame:
    return tables.header_rows(_cells(spark, root))


def h4_page_columns(spark: SparkSession, root: str) -> DataFrame:
    kinds = tables.column_kinds(_cells(spark, root))
    return kinds.withColumns({c: F.round(c, 6) for c in ("role_share", "bank_share")})


def h6_page_bank_roles(spark: SparkSession, root: str) -> DataFrame:
    return tables.bank_roles(_cells(spark, root))


def h9_plain_bank_rows(spark: SparkSession, root: str) -> DataFrame:
    return tables.plain_bank_rows(_cells(spark, root))


def s5_listed_filings(spark: SparkSession, root: str) -> DataFrame:
    """Filings read back from composed submission lists, one list per company and month."""
    f = read_table(spark, root, "filings").filter("cik is not null and accession_number is not null and form_type is not null and filing_date is not null")
    columns = {"accessionNumber": F.col("accession_number"), "form": F.col("form_type"), "filingDate": F.date_format("filing_date", "yyyy-MM-dd"), "primaryDocument": F.coalesce("filing_url", F.lit("")), "primaryDocDescription": F.lit("")}
    rows = f.groupBy("cik", F.date_trunc("month", "filing_date").alias("m")).agg(F.collect_list(F.struct(*[c.alias(n) for n, c in columns.items()])).alias("r"))
    recent = F.struct(*[F.col(f"r.{n}").alias(n) for n in columns])
    lists = rows.select(F.to_json(F.struct("cik", F.struct(recent.alias("recent")).alias("filings"))).alias("value"))
    return edgar.listed_filings(lists, "value", start="2023-01-01", end="2024-12-31").select("cik", "accessionNumber", "form", "filingDate")


def s8_index_exhibits(spark: SparkSession, root: str) -> DataFrame:
    """Exhibits read back from composed index pages of their filings."""
    x = read_table(spark, root, "exhibits").filter("description is not null and trim(filename) <> ''")
    row = F.concat(F.lit("<tr><td>1</td><td>"), _escaped(F.concat(F.lit("EX-"), F.col("id").cast("string"), F.lit(" "), F.col("description"))), F.lit("</td><td><a href=\"/x\">"), _escaped(F.trim("filename")), F.lit("</a></td></tr>"))
    pages = x.groupBy("filing_id").agg(F.concat(F.lit("<table><tr><th>Seq</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("page"))
    return edgar.scan_indexes(pages, "filing_id", "page").select("filing_id", "exhibit_type", "filename", "is_pdf")


def s9_arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Unprocessed filings that no processed one has the accession number of."""
    f = read_table(spark, root, "filings")
    return edgar.new_filings(f.filter("not processed"), f.filter("processed")).select("id", "accession_number")


def s18_submission_documents(spark: SparkSession, root: str) -> DataFrame:
    """Documents read back from composed full submissions, one for every filing with exhibits."""
    f = read_table(spark, root, "filings").filter("accession_number is not null and form_type is not null").select(F.col("id").alias("filing_id"), "accession_number", "form_type")
    x = read_table(spark, root, "exhibits").select("filing_id", "id", F.coalesce(F.regexp_replace("exhibit_type", "[<\r\n]", ""), F.lit("EX")).alias("kind"))
    doc = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), F.col("kind"), F.lit("\n<SEQUENCE>"), F.col("id").cast("string"), F.lit("\n<TEXT>\nbody of "), F.col("id").cast("string"), F.lit("\n</TEXT>\n</DOCUMENT>\n"))
    body = x.groupBy("filing_id").agg(F.array_join(F.collect_list(doc), "").alias("docs"))
    head = F.concat(F.lit("ACCESSION NUMBER:\t\t"), F.col("accession_number"), F.lit("\nCONFORMED SUBMISSION TYPE:\t"), F.col("form_type"), F.lit("\n"))
    whole = f.join(body, "filing_id").select("filing_id", F.concat(head, F.col("docs")).alias("value"))
    return files.parse_submissions(whole, "filing_id", "value").select("filing_id", "accession_number", "form_type", "sequence", "doc_type", "text")


# ------------------------------------------------------------------ queries over the tables themselves


def f9_pdf_outcomes(spark: SparkSession, root: str) -> DataFrame:
    return facts.pdf_outcomes(read_table(spark, root, "exhibits"))


def f10_financing_wording(spark: SparkSession, root: str) -> DataFrame:
    return facts.pdf_financing(read_table(spark, root, "exhibits"), "id", "visual_text")


def _assigned(spark: SparkSession, root: str) -> DataFrame:
    return cluster.assign_deals(read_table(spark, root, "atomic_facts"), read_table(spark, root, "deals"))


def c4_assigned_facts(spark: SparkSession, root: str) -> DataFrame:
    """Where each party fact without a deal goes."""
    return _assigned(spark, root)


def c3_created_deals(spark: SparkSession, root: str) -> DataFrame:
    return cluster.created_deals(_assigned(spark, root), read_table(spark, root, "atomic_facts"))


def c12_assignment_counts(spark: SparkSession, root: str) -> DataFrame:
    return cluster.assignment_counts(_assigned(spark, root))


def _merges(deals: DataFrame) -> DataFrame:
    """Deals of one key go into that with the smallest id."""
    keyed = deals.filter("deal_key is not null")
    first = keyed.groupBy("deal_key").agg(F.min("id").alias("target_id"))
    return keyed.join(first, "deal_key").filter("id <> target_id").select(F.col("id").alias("source_id"), "target_id", F.lit("same key").alias("reason"))


def _merged(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    deals = read_table(spark, root, "deals")
    return cluster.merge_deals(read_table(spark, root, "atomic_facts"), read_table(spark, root, "financing_events"), deals, _merges(deals))


def c10_merged_events(spark: SparkSession, root: str) -> DataFrame:
    return _merged(spark, root)[1].select("id", "deal_id")


def c10_merged_facts(spark: SparkSession, root: str) -> DataFrame:
    return _merged(spark, root)[0].select("id", "deal_id")


def c10_merge_alerts(spark: SparkSession, root: str) -> DataFrame:
    return _merged(spark, root)[3]


def b4_linked_names(spark: SparkSession, root: str) -> DataFrame:
    """Every typed bank name with a listed bank (by exact spelling) or a new one."""
    return resolve.link_banks(resolve.resolve_exact(read_table(spark, root, "financing_participants"), "bank_name_raw", read_table(spark, root, "banks"), read_table(spark, root, "bank_aliases")))


def b5_seeded_banks(spark: SparkSession, root: str) -> DataFrame:
    """Typed aliases that would be new banks if they were seeds."""
    seeds = read_table(spark, root, "bank_aliases").select(F.col("alias").alias("name"), F.lit(None).cast("string").alias("short_name"))
    return resolve.seed_banks(read_table(spark, root, "banks"), seeds).select("name", "name_normalized")


def a5_weighted_shares(spark: SparkSession, root: str) -> DataFrame:
    """Amount of every event shared among its participants by role weight, equally where no weight is above zero."""
    p = read_table(spark, root, "financing_participants").select("id", "financing_event_id", F.greatest(F.coalesce("role_weight", F.lit(0.0)), F.lit(0.0)).alias("w"))
    e = read_table(spark, root, "financing_events").filter("amount_usd is not null").select(F.col("id").alias("financing_event_id"), "amount_usd")
    sums = p.groupBy("financing_event_id").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("n")).join(e, "financing_event_id")
    share = F.when(F.col("total") > 0, F.col("w") / F.col("total")).otherwise(1 / F.col("n"))
    return p.join(sums, "financing_event_id").select("id", "financing_event_id", F.round(F.col("amount_usd") * share, 2).alias("amount_usd"))


def q17_pipeline_counts(spark: SparkSession, root: str) -> DataFrame:
    """(step, n) of one pipeline run: facts clustered, deals created, new events by direct links, names resolved."""
    from dealweave.operators import reconcile

    f, d, e = (read_table(spark, root, t) for t in ("atomic_facts", "deals", "financing_events"))
    assigned = cluster.assign_deals(f, d)
    placed = assigned.filter("deal_id is not null").groupBy("fact_id").agg(F.min("deal_id").alias("placed"))
    clustered = f.join(placed, f["id"] == placed["fact_id"], "left").withColumn("deal_id", F.coalesce("deal_id", "placed")).select(f.columns)
    follow = cluster.attach_secondary(clustered).select(F.col("fact_id").alias("_f"), F.col("deal_id").alias("_d"))
    attached = clustered.join(follow, F.col("id") == F.col("_f"), "left").withColumn("deal_id", F.coalesce("deal_id", "_d")).select(f.columns)
    names = resolve.resolve_exact(read_table(spark, root, "financing_participants"), "bank_name_raw", read_table(spark, root, "banks"), read_table(spark, root, "bank_aliases"))
    steps = {
        "clustered_facts": assigned.filter("action = 'attached'"), "created_deals": cluster.created_deals(assigned, f), "facts_with_deal": attached.filter("deal_id is not null"),
        "new_events": reconcile.unrecorded_links(attached, e), "resolved_names": names.filter("bank_id is not null"),
    }
    parts = [x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("step"), "n") for k, x in steps.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


# ------------------------------------------------------------------ SQL: what must come back

_D = """d as (select id, trim(acquirer_name_raw) as a, trim(target_name_raw) as t, announcement_date as w from deals
  where regexp_full_match(acquirer_name_raw, '[A-Za-z ]+') and regexp_full_match(target_name_raw, '[A-Za-z ]+') and announcement_date is not null)"""
_PREAMBLE = """'AGREEMENT AND PLAN OF MERGER dated as of ' || strftime(w, '%B %-d, %Y') || ', by and among ' || a || ' ("Parent") and ' || t || ' (hereinafter the "Company").'"""


def _bare_party(c: str) -> str:
    """A blank is left where the defined term was, so no legal form is cut."""
    return f"lower(regexp_replace({c}, '\\s+', ' ', 'g'))"


_E = """b as (select financing_event_id as id, arg_min(bank_name_raw, id) as bank from financing_participants
    where regexp_full_match(bank_name_raw, '[A-Z][a-z]+( [A-Z][a-z]+)*') and not regexp_matches(lower(bank_name_raw), 'lead|the|several') group by 1),
  e as (select e.id, round(amount_usd / 1e6) as m, bank, case instrument_type when 'term_loan' then 'term_loan' when 'rcf' then 'credit_facility' when 'bridge_loan' then 'bridge_loan'
    when 'credit_facility' then 'credit_facility' else 'bond' end as kind, coalesce(instrument_type in ('term_loan', 'rcf', 'bridge_loan', 'credit_facility'), false) as loan,
    coalesce(instrument_type = 'rcf', false) as revolving from financing_events e left join b using (id) where amount_usd >= 1e6)"""
_KIND = "case when revolving then 'rcf' else kind end"
_CELLS = """p as (select id, financing_event_id as key, bank_name_raw, role from financing_participants where trim(bank_name_raw) <> '' and trim(role) <> ''),
  r as (select key, row_number() over (partition by key order by id) as row_no, bank_name_raw, role from p),
  c as (select distinct key, 0 as row_no, unnest([0, 1, 2]) as col_no, unnest(['Part', 'Bank', 'Role']) as text, true as is_header from r
    union all select key, row_no, 0, 'Tranche', false from r
    union all select key, row_no, 1, trim(regexp_replace(bank_name_raw, '[\\s ]+', ' ', 'g')), false from r
    union all select key, row_no, 2, trim(regexp_replace(role, '[\\s ]+', ' ', 'g')), false from r)"""
_ROLE_WORD = "regexp_matches(lower(text), 'bookrunner|co-manager|co manager|manager|underwriter|arranger|administrative agent|admin agent|syndication agent|documentation agent|collateral agent|paying agent|advisor|adviser|fairness opinion')"
_LISTED = """regexp_matches(text, '(?i)\\b(?:J\\.?P\\.?\\s*Morgan|JPMorgan|Goldman\\s*Sachs|GS|Morgan\\s*Stanley|Bank\\s*of\\s*America|BofA|BAML|Citi(?:group|bank)?|Wells\\s*Fargo|Barclays|Deutsche\\s*Bank|Credit\\s*Suisse|UBS|HSBC|BNP\\s*Paribas|Societe\\s*Generale|RBC|Royal\\s*Bank\\s*of\\s*Canada|TD\\s*Securities|Mizuho|MUFG|Mitsubishi\\s*UFJ|SMBC|Sumitomo\\s*Mitsui)\\b')"""
_BANK_WORD = f"({_LISTED} or (regexp_matches(text, '(?i)(?:LLC|Inc\\.?|N\\.?A\\.?|Bank|Securities|Capital)$') and not regexp_full_match(text, '[\\d,.$%\\s]+')))"
_SHARES = f"""s as (select key, col_no, avg(cast({_ROLE_WORD} as int)) as role_share, avg(cast({_LISTED} as int)) as bank_share from c where row_no > 0 group by 1, 2)"""
_SCOPE = "case when exhibit_id is not null then 'e' || exhibit_id else 'f' || filing_id end"
_ASSIGN = f"""p as (select id, {_SCOPE} as scope, case when lower(party.role_label) in ('company', 'target', 'seller') then 'target'
      when lower(party.role_label) in ('parent', 'buyer', 'purchaser', 'acquirer', 'acquiror') then 'acquirer' end as side,
      nullif(party.party_name_normalized, '') as name, nullif(party.cik, '') as cik, party.party_name_raw as raw, party.cik as typed_cik from atomic_facts where party is not null and deal_id is null),
  f as (select scope, side, arg_min(struct_pack(name := name, cik := cik), id) as f from p where side is not null group by 1, 2),
  k as (select p.id, p.side, p.raw, p.typed_cik, case p.side when 'target' then f.f.cik else p.cik end as ac, case p.side when 'target' then f.f.name else p.name end as an,
      case p.side when 'target' then p.cik else f.f.cik end as tc, case p.side when 'target' then p.name else f.f.name end as tn
      from p join f on f.scope = p.scope and f.side = case p.side when 'target' then 'acquirer' else 'target' end where p.side is not null),
  x as (select id, side, raw, typed_cik, coalesce('cik:' || ac || ':cik:' || tc, 'cik:' || ac || ':name:' || tn, 'name:' || an || ':name:' || tn) as deal_key from k),
  h as (select deal_key, min(id) as deal_id, arg_min(state, id) as state from deals where deal_key is not null group by 1),
  n as (select distinct deal_key from x where side = 'target' and deal_key not in (select deal_key from h)),
  a as (select x.id as fact_id, x.side, x.deal_key, case when coalesce(h.state, '') <> 'LOCKED' then h.deal_id end as deal_id, x.raw, x.typed_cik,
      case when h.state = 'LOCKED' then 'locked' when h.deal_id is not null then 'attached' when x.side = 'target' then 'created' when n.deal_key is not null then 'attached' else 'waiting' end as action
      from x left join h using (deal_key) left join n using (deal_key) where x.deal_key is not null)"""
_MERGE = "m as (select id, first from (select id, min(id) over (partition by deal_key) as first from deals where deal_key is not null) where id <> first)"
_EXACT = f"""names as (select distinct bank_name_raw as raw, {_endings_sql("bank_name_raw")} as k from financing_participants where bank_name_raw is not null),
  l as (select k, min(id) as name_id from (select id, {_endings_sql("name")} as k from banks) group by 1),
  al as (select k, min(bank_id) as alias_id from (select bank_id, {_endings_sql("alias")} as k from bank_aliases where bank_id is not null) group by 1),
  z as (select raw, k, coalesce(name_id, alias_id) as bank_id from names left join l using (k) left join al using (k))"""

QUERIES = {
    f.__name__: f
    for f in (
        r1_parties, r5_terms, r7_labelled_parties, r14_preamble_dates, r19_item_sections, r22_offered_debt, u3_named_underwriters, f5_offer_participants, t1_page_text, h1_page_cells, h3_header_rows,
        h4_page_columns, h6_page_bank_roles, h9_plain_bank_rows, s5_listed_filings, s8_index_exhibits, s9_arrivals, s18_submission_documents, f9_pdf_outcomes, f10_financing_wording, c4_assigned_facts,
        c3_created_deals, c12_assignment_counts, c10_merged_events, c10_merged_facts, c10_merge_alerts, b4_linked_names, b5_seeded_banks, a5_weighted_shares, q17_pipeline_counts,
    )
}
SQL = {
    "r1_parties": f"""with {_D} select id, 0 as position, regexp_replace(a, '\\s+', ' ', 'g') || ' ("Parent")' as party_name_raw, {_bare_party("a")} as party_name_normalized, 'Parent' as role_label, 0.9 as confidence from d
      union all select id, 1, regexp_replace(t, '\\s+', ' ', 'g') || ' (hereinafter the "Company")', {_bare_party("t")}, 'Company', 0.9 from d""",
    "r5_terms": f"with {_D} select id, unnest(['Parent', 'Company']) as label, unnest(['acquirer', 'target']) as role from d",
    "r7_labelled_parties": f"""with {_D} select id, length('AGREEMENT AND PLAN OF MERGER dated as of ' || strftime(w, '%B %-d, %Y') || ', by and among ' || a) + 1 as start,
        'by and among ' || a as party, 'Parent' as label, 'acquirer' as role from d
      union all select id, length('AGREEMENT AND PLAN OF MERGER dated as of ' || strftime(w, '%B %-d, %Y') || ', by and among ' || a || ' ("Parent") and ' || t) + 1,
        'by and among ' || a || ' ("Parent") and ' || t, 'Company', 'target' from d""",
    "r14_preamble_dates": f"with {_D} select id, strftime(w, '%Y-%m-%d') as agreement_date from d",
    "r19_item_sections": f"with {_D} select id, 'Item 1.01. Entry into a Material Definitive Agreement. ' || {_PREAMBLE} || ' ' as section from d",
    "r22_offered_debt": f"""with {_E} select id, {_KIND} as instrument_type, '$' || format('{{:,}}', cast(m as bigint)) || ' million' as amount_raw, m * 1e6 as amount_usd,
        case when not loan then '2031' end as maturity_year, case when loan then 0.85 else 0.9 end as confidence from e""",
    "u3_named_underwriters": f"with {_E} select id, bank as name_raw, lower(bank) as name_normalized, 'representative' as role, 0.85 as confidence from e where bank is not null",
    "f5_offer_participants": f"with {_E} select id, {_KIND} as instrument_type, m * 1e6 as amount_usd, bank || ': representative' as underwriters from e",
    "t1_page_text": f"""with p as (select id, financing_event_id as key, bank_name_raw, role from financing_participants where trim(bank_name_raw) <> '' and trim(role) <> ''),
      l as (select key, row_number() over (partition by key order by id) as n, bank_name_raw || case when regexp_matches(bank_name_raw, '[.!?;:|]\\s*$') then '' else ' | ' end
        || role || case when regexp_matches(role, '[.!?;:|]\\s*$') then '' else ' |' end as line from p)
      select key, 'Lenders & roles' || chr(10) || chr(10) || 'Part | Bank | Role |' || chr(10) || string_agg(
        trim(regexp_replace(translate(case when n = 1 then 'Tranche | ' else '' end || line, '{P.TYPOGRAPHIC}', '{P.PLAIN.replace("'", "''")}'), '[ \\t]+', ' ', 'g')), chr(10) order by n) as visual_text from l group by key""",
    "h1_page_cells": f"with {_CELLS} select key, 0 as table_no, row_no, col_no, text, is_header from c",
    "h3_header_rows": f"with {_CELLS} select distinct key, 0 as table_no, 0 as row_no from r",
    "h4_page_columns": f"""with {_CELLS}, {_SHARES} select key, 0 as table_no, col_no, round(role_share, 6) as role_share, round(bank_share, 6) as bank_share,
        coalesce(col_no = min(col_no) filter (role_share > 0.3) over (partition by key), false) as is_role, bank_share > 0.2 as is_bank from s""",
    "h6_page_bank_roles": f"""with {_CELLS}, {_SHARES}, k as (select key, min(col_no) as role_col from s where role_share > 0.3 group by 1),
      b as (select key, row_no, min(col_no) as col_no, arg_min(text, col_no) as bank from c where row_no > 0 and {_BANK_WORD} group by 1, 2),
      j as (select b.key, b.row_no, b.col_no, b.bank, max(case when c.col_no = k.role_col then c.text end) as by_col, arg_min(c.text, c.col_no) filter (c.col_no <> b.col_no and {_ROLE_WORD.replace("text", "c.text")}) as by_word
        from b join c on c.key = b.key and c.row_no = b.row_no left join k on k.key = b.key group by 1, 2, 3, 4)
      select key, 0 as table_no, row_no, col_no, bank, coalesce(by_col, by_word, 'participant') as role from j""",
    "h9_plain_bank_rows": f"""with {_CELLS} select * from (select key, 0 as table_no, row_no, arg_max(text, col_no) filter ({_BANK_WORD}) as bank, coalesce(arg_max(text, col_no) filter ({_ROLE_WORD}), 'unknown') as role
        from c group by key, row_no) where bank is not null""",
    "s5_listed_filings": """select cik, accession_number as "accessionNumber", form_type as form, strftime(filing_date, '%Y-%m-%d') as "filingDate" from filings
      where cik is not null and accession_number is not null and filing_date >= timestamp '2023-01-01' and filing_date < timestamp '2025-01-01'
        and form_type in ("""
    + ", ".join(f"'{x}'" for x in edgar.MERGER_FORMS)
    + ")",
    "s8_index_exhibits": """select filing_id, 'EX-' || id as exhibit_type, trim(filename) as filename, ends_with(lower(trim(filename)), '.pdf') as is_pdf from exhibits
      where description is not null and trim(filename) <> ''""",
    "s9_arrivals": """select min(id) as id, accession_number from filings where not processed and accession_number is not null
      and accession_number not in (select accession_number from filings where processed and accession_number is not null) group by 2""",
    "s18_submission_documents": """select f.id as filing_id, f.accession_number, f.form_type, cast(x.id as int) as sequence, coalesce(x.exhibit_type, 'EX') as doc_type, 'body of ' || x.id as text
      from filings f join exhibits x on x.filing_id = f.id where f.accession_number is not null and f.form_type is not null""",
    "f9_pdf_outcomes": """with q as (select id, is_material, case when visual_text is null or trim(regexp_replace(visual_text, '\\s+', ' ', 'g')) = '' then 0
        else len(string_split(trim(regexp_replace(visual_text, '\\s+', ' ', 'g')), ' ')) end as n from exhibits where is_pdf)
      select id, case when n = 0 then 'failed' when n < 50 then 'poor' else 'good' end as quality, case when n >= 50 then 'processed' when is_material then 'alert' else 'skipped' end as outcome from q""",
    "f10_financing_wording": """with x as (select id, lower(visual_text) as l, regexp_extract_all(visual_text, '(?i)\\$\\s?(\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?)\\s*(billion|million|b|m|bn|mm|mil)?', 1) as a,
        regexp_extract_all(visual_text, '(?i)\\$\\s?(\\d{1,3}(?:,\\d{3})*(?:\\.\\d+)?)\\s*(billion|million|b|m|bn|mm|mil)?', 2) as s from exhibits where visual_text <> '')
      select id, case when contains(l, 'term loan') then 'term_loan' when contains(l, 'revolving') then 'rcf' when contains(l, 'bridge') then 'bridge'
        when contains(l, 'bond') or contains(l, 'note') then 'bond' when contains(l, 'credit') then 'loan' end as facility_type, cast(len(a) as int) as amounts,
        list_max([cast(replace(a[i], ',', '') as double) * case when lower(s[i]) in ('million', 'm', 'mm', 'mil') then 1e6 when lower(s[i]) in ('billion', 'b', 'bn') then 1e9 else 1 end for i in range(1, len(a) + 1)]) as amount_usd from x""",
    "c4_assigned_facts": f"with {_ASSIGN} select fact_id, side, deal_key, deal_id, action from a",
    "c3_created_deals": f"""with {_ASSIGN} select deal_key, arg_min(struct_pack(r := raw), fact_id).r as target_name_raw, arg_min(struct_pack(c := typed_cik), fact_id).c as target_cik, min(fact_id) as first_fact_id
      from a where action = 'created' group by 1""",
    "c12_assignment_counts": f"with {_ASSIGN} select action, count(*) as facts, count(distinct deal_key) as deals from a group by 1",
    "c10_merged_events": f"with {_MERGE} select e.id, coalesce(m.first, e.deal_id) as deal_id from financing_events e left join m on m.id = e.deal_id",
    "c10_merged_facts": f"with {_MERGE} select f.id, coalesce(m.first, f.deal_id) as deal_id from atomic_facts f left join m on m.id = f.deal_id",
    "c10_merge_alerts": f"with {_MERGE} select 'DEAL_MERGE_CANDIDATE' as alert_type, first as deal_id, id as merged_deal_id, 'same key' as description, true as is_resolved from m",
    "b4_linked_names": f"with {_EXACT} select raw, coalesce(cast(bank_id as varchar), 'new:' || nullif(k, '')) as bank_key from z",
    "b5_seeded_banks": """select min(alias) as name, k as name_normalized from (select alias, trim(regexp_replace(lower(alias), '[,.]', '', 'g')) as k from bank_aliases where alias is not null)
      where k not in (select trim(regexp_replace(lower(name), '[,.]', '', 'g')) from banks where name is not null) group by 2""",
    "a5_weighted_shares": """with p as (select id, financing_event_id, greatest(coalesce(role_weight, 0), 0) as w from financing_participants)
      select p.id, p.financing_event_id, round(e.amount_usd * case when sum(w) over q > 0 then w / sum(w) over q else 1.0 / count(*) over q end, 2) as amount_usd
      from p join financing_events e on e.id = p.financing_event_id and e.amount_usd is not null window q as (partition by p.financing_event_id)""",
    "q17_pipeline_counts": f"""with {_ASSIGN}, {_EXACT}, placed as (select fact_id, min(deal_id) as d from a where deal_id is not null group by 1),
      g as (select id, {_SCOPE} as scope, party is not null as has_party, financing is not null as has_money, coalesce(deal_id, placed.d) as deal_id from atomic_facts left join placed on placed.fact_id = id),
      o as (select scope, min(deal_id) as d from g where has_party and deal_id is not null group by 1),
      w as (select g.id, g.has_money, coalesce(g.deal_id, case when not g.has_party then o.d end) as deal_id from g left join o using (scope)),
      used as (select distinct unnest(source_fact_ids) as id from financing_events)
      select 'clustered_facts' as step, count(*) as n from a where action = 'attached'
      union all select 'created_deals', count(distinct deal_key) from a where action = 'created'
      union all select 'facts_with_deal', count(*) from w where deal_id is not null
      union all select 'new_events', count(*) from w where has_money and deal_id is not null and id not in (select id from used where id is not null)
      union all select 'resolved_names', count(*) from z where bank_id is not null""",
}
