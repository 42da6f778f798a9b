"""Facts, clustering, reconciliation and resolution over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dealweave.functions import patterns as P
from dealweave.operators import cluster, facts, reconcile, resolve, tables
from dealweave.plans.text_queries import _AFFILIATION, _endings_sql, _pieces_sql, _ROLE_SQL, stored_cells
from dealweave.session import read_table


def f1_extracted_facts(spark: SparkSession, root: str) -> DataFrame:
    return facts.extract_facts(read_table(spark, root, "filings"), read_table(spark, root, "exhibits"))


def f8_sponsor_facts(spark: SparkSession, root: str) -> DataFrame:
    """Sponsor mentions of all documents."""
    return facts.sponsor_facts(read_table(spark, root, "documents"), "doc_id", "text").drop("context_snippet")


def f3_missing_parties(spark: SparkSession, root: str) -> DataFrame:
    return facts.missing_party_alerts(read_table(spark, root, "exhibits"), "id", "visual_text")


def h4_column_kinds(spark: SparkSession, root: str) -> DataFrame:
    kinds = tables.column_kinds(stored_cells(spark, root))
    return kinds.select("key.record_table", F.col("key.id").alias("key"), *kinds.columns[1:])


def c3_party_clusters(spark: SparkSession, root: str) -> DataFrame:
    return cluster.cluster_parties(read_table(spark, root, "atomic_facts"))


def c6_deal_keys(spark: SparkSession, root: str) -> DataFrame:
    d = read_table(spark, root, "deals")
    key = cluster.deal_key(F.col("acquirer_cik"), F.col("acquirer_name_normalized"), F.col("target_cik"), F.col("target_name_normalized"))
    return d.select("id", key.alias("built_key"))


def c7_secondary_facts(spark: SparkSession, root: str) -> DataFrame:
    return cluster.attach_secondary(read_table(spark, root, "atomic_facts"))


def c8_sponsor_fold(spark: SparkSession, root: str) -> DataFrame:
    return cluster.fold_sponsors(read_table(spark, root, "atomic_facts"))


def c9_date_fold(spark: SparkSession, root: str) -> DataFrame:
    return cluster.fold_dates(read_table(spark, root, "atomic_facts"))


def c11_merge_candidates(spark: SparkSession, root: str) -> DataFrame:
    return cluster.merge_candidates(read_table(spark, root, "deals"))


def c11_members(spark: SparkSession, root: str) -> DataFrame:
    return cluster.candidate_members(read_table(spark, root, "deals"))


def m1_unrecorded_links(spark: SparkSession, root: str) -> DataFrame:
    return reconcile.unrecorded_links(read_table(spark, root, "atomic_facts"), read_table(spark, root, "financing_events"))


def m2_matched_facts(spark: SparkSession, root: str) -> DataFrame:
    """Financing facts whose deal is hidden and whose evidence names its parties, matched again."""
    f, d = read_table(spark, root, "atomic_facts").filter("financing is not null"), read_table(spark, root, "deals")
    said = d.select(F.col("id").alias("deal_id"), F.concat_ws(" ", F.lit("Financing for the purchase of"), "target_name_normalized", F.lit("by"), "acquirer_name_normalized", F.lit("with"), "sponsor_name_raw").alias("said"))
    named = f.join(said, "deal_id", "left").withColumn("evidence_snippet", F.coalesce("said", "evidence_snippet")).withColumn("deal_id", F.lit(None).cast("bigint"))
    return reconcile.match_unlinked(named.select(f.columns), d).withColumn("confidence", F.round("confidence", 9))


def m4_event_participants(spark: SparkSession, root: str) -> DataFrame:
    return reconcile.event_participants(read_table(spark, root, "atomic_facts"))


def b1_exact_banks(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_exact(read_table(spark, root, "financing_participants"), "bank_name_raw", read_table(spark, root, "banks"), read_table(spark, root, "bank_aliases"))


def b3_resolved_banks(spark: SparkSession, root: str) -> DataFrame:
    return resolve.resolve_banks(read_table(spark, root, "financing_participants"), "bank_name_raw", read_table(spark, root, "banks"), read_table(spark, root, "bank_aliases"))


def b4_unlisted_banks(spark: SparkSession, root: str) -> DataFrame:
    return resolve.unlisted_banks(b3_resolved_banks(spark, root))


def a5_bank_league_table(spark: SparkSession, root: str) -> DataFrame:
    """Amounts per listed bank, each event shared equally among its participants, with share and rank.

    Events are counted per bank before the shares are joined, so the most
    frequent bank is aggregated map-side; the amounts join on the event id.
    """
    p = read_table(spark, root, "financing_participants").select("financing_event_id", "bank_id")
    e = read_table(spark, root, "financing_events").filter("amount_usd is not null").select(F.col("id").alias("financing_event_id"), "amount_usd")
    per = p.groupBy("financing_event_id", "bank_id").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy("financing_event_id"))
    shared = per.withColumn("share", F.col("n") / size).filter("bank_id is not null").join(e, "financing_event_id")
    totals = shared.groupBy("bank_id").agg(F.round(F.sum(F.col("amount_usd") * F.col("share")) / 1e6, 3).alias("amount_musd"), F.count(F.lit(1)).alias("events"))
    banks = read_table(spark, root, "banks").select(F.col("id").alias("bank_id"), "name")
    named = totals.join(banks, "bank_id", "left")
    # One row per listed bank: the ranking window is as small as the bank list.
    return named.withColumn("place", F.rank().over(Window.orderBy(F.desc("amount_musd")))).select("bank_id", "name", "amount_musd", "events", "place")


_SCOPE = "case when exhibit_id is not null then 'e' || exhibit_id else 'f' || filing_id end"
_T, _A = (", ".join(f"'{x}'" for x in xs) for xs in (P.TARGET_ROLES, P.ACQUIRER_ROLES))
_PARTIES = f"""p as (select id, {_SCOPE} as scope, case when lower(party.role_label) in ({_T}) then 'target' when lower(party.role_label) in ({_A}) then 'acquirer' end as side,
    party.party_name_normalized as name, party.cik as cik from atomic_facts where party is not null)"""


def _key_sql(ac: str, an: str, tc: str, tn: str) -> str:
    ac, an, tc, tn = (f"nullif({x}, '')" for x in (ac, an, tc, tn))
    return f"coalesce('cik:' || {ac} || ':cik:' || {tc}, 'cik:' || {ac} || ':name:' || {tn}, 'name:' || {an} || ':name:' || {tn})"


_KNOWN = ", ".join("'" + k.replace("'", "''") + "'" for k in P.SPONSORS)
_CUT = _endings_sql()

QUERIES = {
    "f1_extracted_facts": f1_extracted_facts,
    "f3_missing_parties": f3_missing_parties,
    "f8_sponsor_facts": f8_sponsor_facts,
    "h4_column_kinds": h4_column_kinds,
    "c3_party_clusters": c3_party_clusters,
    "c6_deal_keys": c6_deal_keys,
    "c7_secondary_facts": c7_secondary_facts,
    "c8_sponsor_fold": c8_sponsor_fold,
    "c9_date_fold": c9_date_fold,
    "c11_merge_candidates": c11_merge_candidates,
    "c11_members": c11_members,
    "m1_unrecorded_links": m1_unrecorded_links,
    "m2_matched_facts": m2_matched_facts,
    "m4_event_participants": m4_event_participants,
    "b1_exact_banks": b1_exact_banks,
    "b3_resolved_banks": b3_resolved_banks,
    "b4_unlisted_banks": b4_unlisted_banks,
    "a5_bank_league_table": a5_bank_league_table,
}
_NEGATED = "'(?i)\\b(?:not\\s+a\\s+(?:financial\\s+)?sponsor|independent\\s+of\\s+(?:any\\s+)?sponsor|no\\s+sponsor|without\\s+(?:any\\s+)?sponsor|non-sponsored)\\b'"
_ALIASES = ", ".join("('" + k.replace("'", "''") + "')" for k in P.SPONSORS)
SQL = {
    "f3_missing_parties": """select id, sha256(left(visual_text, 5000)) as preamble_hash, left(visual_text, 500) as preamble_preview from exhibits
      where regexp_matches(left(visual_text, 5000), '(?i)(?:AGREEMENT\\s+AND\\s+PLAN\\s+OF\\s+MERGER|PLAN\\s+OF\\s+MERGER|MERGER\\s+AGREEMENT)')
        and not regexp_matches(left(visual_text, 5000), '(?ism)\\bby\\s+and\\s+(?:among|between)\\b\\s+(.+)\\.\\s*$')
        and not regexp_matches(left(visual_text, 5000), '(?ism)(?:entered\\s+into|made)\\s+(?:by\\s+and\\s+)?(?:among|between)\\s+(.+)\\.\\s*$')""",
    "f8_sponsor_facts": f"""with a as (select * from (values {_ALIASES}) as v(alias)),
      s as (select doc_id, text, alias, strpos(lower(text), alias) as pos from documents join a on contains(lower(text), alias)),
      p as (select doc_id, text, trim(x) as raw from (select doc_id, text, unnest(regexp_extract_all(text, {_AFFILIATION}, 1)) as x from documents) where trim(x) <> ''),
      q as (select *, trim(regexp_replace(regexp_replace(lower(raw), '[,.\\-'']', '', 'g'), '\\s+', ' ', 'g')) as norm from p)
      select doc_id, substring(text, pos, length(alias)) as sponsor_name_raw, alias as sponsor_name_normalized, 'seed_list' as source_pattern, 0.95 as confidence from s
        where not regexp_matches(substring(text, greatest(pos - 150, 1), pos + length(alias) + 150 - greatest(pos - 150, 1)), {_NEGATED})
      union all select doc_id, raw, norm, case when norm in (select alias from a) then 'seed_list' else 'affiliation_pattern' end, case when norm in (select alias from a) then 0.95 else 0.85 end
        from q where not regexp_matches(text, {_NEGATED})""",
    "c11_members": """select id as deal_id, min(id) over (partition by lower(target_name_normalized), deal_key) as representative from deals
      where target_name_normalized is not null and deal_key is not null""",
    "c3_party_clusters": f"""with {_PARTIES}, f as (select scope, side, arg_min(struct_pack(name := name, cik := cik), id) as f from p where side is not null group by 1, 2)
      select * from (
        select p.id as fact_id, {_key_sql("f.f.cik", "f.f.name", "p.cik", "p.name")} as deal_key from p join f on f.scope = p.scope and f.side = 'acquirer' where p.side = 'target'
        union all
        select p.id, {_key_sql("p.cik", "p.name", "f.f.cik", "f.f.name")} from p join f on f.scope = p.scope and f.side = 'target' where p.side = 'acquirer')
      where deal_key is not null""",
    "c6_deal_keys": f"select id, {_key_sql('acquirer_cik', 'acquirer_name_normalized', 'target_cik', 'target_name_normalized')} as built_key from deals",
    "c7_secondary_facts": f"""select l.id as fact_id, o.deal_id from (select id, {_SCOPE} as scope from atomic_facts where party is null and deal_id is null) l
      join (select {_SCOPE} as scope, min(deal_id) as deal_id from atomic_facts where party is not null and deal_id is not null group by 1) o using (scope)""",
    "c8_sponsor_fold": f"""with s as (select deal_id, id, sponsor.sponsor_name_raw as raw, coalesce(confidence, 0.0) as conf, lower(sponsor.sponsor_name_normalized) as norm
        from atomic_facts where deal_id is not null and sponsor is not null and not coalesce(sponsor.is_negated, false)),
      w as (select *, max(conf) over (partition by deal_id order by id rows between unbounded preceding and 1 preceding) as before from s)
      select deal_id, arg_max(raw, struct_pack(c := conf, i := -id)) as sponsor_name_raw, max(conf) as sponsor_confidence,
        bool_or((before is null or conf > before) and not coalesce(norm in ({_KNOWN}), false)) as unresolved from w group by 1""",
    "c9_date_fold": """select deal_id, date_type, arg_min(d, id) as date_value from (
        select deal_id, id, deal_date.date_type as date_type, try_cast(try_strptime(left(deal_date.date_value, 10), '%Y-%m-%d') as date) as d
        from atomic_facts where deal_id is not null and deal_date is not null) where d is not null and date_type is not null group by 1, 2""",
    "m1_unrecorded_links": """select id as fact_id, deal_id, coalesce(financing.instrument_type, 'unknown') as instrument_family, financing.amount_usd as amount_usd,
        financing.amount_raw as amount_raw, coalesce(financing.currency, 'USD') as currency, cast(coalesce(len(financing.participants), 0) as bigint) as participants
      from atomic_facts where financing is not null and deal_id is not null
        and id not in (select x from (select unnest(source_fact_ids) as x from financing_events) where x is not null)""",
    "m4_event_participants": f"""select fact_id, cast(position as integer) as position, raw as bank_name_raw, {_pieces_sql()} as bank_name_normalized, role, {_ROLE_SQL} as role_normalized from (
        select fact_id, position, p.bank as raw, p.role as role, lower(trim(p.role)) as r from (
          select id as fact_id, generate_subscripts(financing.participants, 1) - 1 as position, unnest(financing.participants) as p from atomic_facts where financing is not null))""",
    "b1_exact_banks": f"""with n as (select raw, {_CUT} as k from (select distinct bank_name_raw as raw from financing_participants where bank_name_raw is not null)),
      b as (select k, min(id) as name_id from (select id, {_CUT} as k from (select id, name as raw from banks)) group by 1),
      a as (select k, min(bank_id) as alias_id from (select bank_id, {_CUT} as k from (select bank_id, alias as raw from bank_aliases where bank_id is not null)) group by 1)
      select raw, coalesce(name_id, alias_id) as bank_id, case when name_id is not null then 1.0 when alias_id is not null then 0.95 end as confidence,
        case when name_id is not null then 'exact' when alias_id is not null then 'alias' end as method
      from n left join b using (k) left join a using (k)""",
    "a5_bank_league_table": """with p as (select financing_event_id, bank_id, count(*) as n from financing_participants group by 1, 2),
      s as (select *, n / sum(n) over (partition by financing_event_id) as share from p),
      t as (select s.bank_id, round(sum(e.amount_usd * s.share) / 1e6, 3) as amount_musd, count(*) as events
        from s join financing_events e on e.id = s.financing_event_id and e.amount_usd is not null where s.bank_id is not null group by 1)
      select t.bank_id, b.name, amount_musd, events, rank() over (order by amount_musd desc) as place from t left join banks b on b.id = t.bank_id""",
}
