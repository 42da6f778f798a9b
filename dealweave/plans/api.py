"""The read surface: lists, details, statistics and search over the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.session import read_table

# States, alert kinds and forms that statistics list.
DEAL_STATES = ("CANDIDATE", "OPEN", "CLOSED", "LOCKED", "NEEDS_REVIEW")
COUNTED_FORMS = ("8-K", "8-K/A", "S-4", "DEFM14A")
SEARCHED = ("target_name_normalized", "acquirer_name_normalized", "target_name_display", "acquirer_name_display")
LARGEST_PAGE = 200


def _like(df: DataFrame, columns: tuple[str, ...], text: str) -> Column:
    """Whether any column matches the text anywhere in any letter case; % and _ in it are wildcards.

    A display name that the table does not have is the name as typed.
    """
    out = F.lit(False)
    for c in columns:
        c = c if c in df.columns else c.replace("_display", "_raw")
        out = out | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return out


def _check_page(skip: int, limit: int) -> None:
    if not 1 <= limit <= LARGEST_PAGE or skip < 0:
        raise ValueError(f"limit must lie between 1 and {LARGEST_PAGE}, skip must not be negative")


def _page(df: DataFrame, order: list[Column], skip: int, limit: int) -> DataFrame:
    _check_page(skip, limit)
    return df.orderBy(*order).offset(skip).limit(limit)


def list_deals(
    deals: DataFrame,
    text: str | None = None,
    sponsor_backed: bool | None = None,
    market_tag: str | None = None,
    state: str | None = None,
    min_value: float | None = None,
    max_value: float | None = None,
    announced_from: str | None = None,
    announced_to: str | None = None,
    skip: int = 0,
    limit: int = 50,
) -> DataFrame:
    """A page of deals, latest announcement first, without announcement last; ties by id."""
    _check_page(skip, limit)
    if text:
        deals = deals.filter(_like(deals, SEARCHED, text))
    for column, value in (("is_sponsor_backed", sponsor_backed), ("market_tag", market_tag), ("state", state)):
        if value is not None:
            deals = deals.filter(F.col(column) == value)
    if min_value is not None:
        deals = deals.filter(F.col("deal_value_usd") >= min_value)
    if max_value is not None:
        deals = deals.filter(F.col("deal_value_usd") <= max_value)
    if announced_from is not None:
        deals = deals.filter(F.col("announcement_date") >= F.lit(announced_from).cast("timestamp_ntz"))
    if announced_to is not None:
        deals = deals.filter(F.col("announcement_date") <= F.lit(announced_to).cast("timestamp_ntz"))
    shown = deals.select("id", "state", "acquirer_name_raw", "target_name_raw", "deal_key", "announcement_date", "deal_value_usd", "is_sponsor_backed", "market_tag")
    return _page(shown, [F.col("announcement_date").desc_nulls_last(), F.col("id")], skip, limit)


def deal_by_id(deals: DataFrame, deal_id: int) -> DataFrame:
    return deals.filter(F.col("id") == deal_id).withColumn("display_name", display_name())


def display_name() -> Column:
    return F.concat(F.coalesce("acquirer_name_raw", F.lit("Unknown")), F.lit(" / "), F.coalesce("target_name_display", "target_name_raw", F.lit("Unknown")))


def deals_with_financing(deals: DataFrame, events: DataFrame, participants: DataFrame) -> DataFrame:
    """Per deal with events: their number, amount and participants, aggregated before each join."""
    p = participants.groupBy("financing_event_id").agg(F.count(F.lit(1)).alias("n"))
    e = events.join(p, events["id"] == p["financing_event_id"], "left").groupBy("deal_id").agg(
        F.count(F.lit(1)).alias("events"), F.round(F.sum("amount_usd"), 2).alias("amount_usd"), F.sum(F.coalesce("n", F.lit(0))).alias("participants")
    )
    return deals.select("id", "deal_key").join(e, deals["id"] == e["deal_id"]).drop("deal_id")


def financing_of(events: DataFrame, participants: DataFrame, deal_id: int) -> DataFrame:
    """Events of a deal with their participants nested, in id order."""
    mine = events.filter(F.col("deal_id") == deal_id)
    p = participants.join(mine.select(F.col("id").alias("financing_event_id")), "financing_event_id", "left_semi")
    nested = p.groupBy("financing_event_id").agg(F.array_sort(F.collect_list(F.struct("id", "bank_name_raw", "role"))).alias("participants"))
    return mine.join(nested, mine["id"] == nested["financing_event_id"], "left").drop("financing_event_id").orderBy("id")


def advisors_of(facts: DataFrame) -> DataFrame:
    """Advisors of all deals, with unknown for what a fact leaves out."""
    a = facts.filter("advisor is not null and deal_id is not null")
    part = lambda f: F.coalesce(F.col(f"advisor.{f}"), F.lit("unknown")).alias(f)
    return a.select("id", "deal_id", part("bank_name_raw"), part("role"), part("client_side"))


def deal_stats(deals: DataFrame, events: DataFrame) -> DataFrame:
    """(measure, n): all deals, each state (zero if none), sponsor-backed, with financing."""
    base = deals.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("state") == s).alias(f"state:{s}") for s in DEAL_STATES],
        F.count_if("is_sponsor_backed").alias("sponsor_backed"),
    )
    rows = base.select(F.explode(F.create_map(*[x for c in base.columns for x in (F.lit(c), F.col(f"`{c}`"))])).alias("measure", "n"))
    linked = events.join(deals.select(F.col("id").alias("deal_id")), "deal_id", "left_semi").agg(F.countDistinct("deal_id").alias("n"))
    return rows.unionByName(linked.select(F.lit("with_financing").alias("measure"), "n"))


def list_filings(filings: DataFrame, cik: str | None = None, form: str | None = None, processed: bool | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    for column, value in (("cik", cik), ("form_type", form), ("processed", processed)):
        if value is not None:
            filings = filings.filter(F.col(column) == value)
    shown = filings.select("id", "accession_number", "cik", "form_type", "filing_date", "company_name", "processed")
    return _page(shown, [F.col("filing_date").desc_nulls_first(), F.col("id")], skip, limit)


def filing_stats(filings: DataFrame, exhibits: DataFrame) -> DataFrame:
    """(measure, n): filings, processed or not, each counted form (left out if none), exhibits, material ones."""
    f = filings.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("processed").alias("processed"),
        F.count_if(~F.col("processed")).alias("unprocessed"),
        *[F.nullif(F.count_if(F.col("form_type") == t), F.lit(0).cast("bigint")).alias(f"form:{t}") for t in COUNTED_FORMS],
    )
    x = exhibits.agg(F.count(F.lit(1)).alias("exhibits"), F.count_if("is_material").alias("material"))
    tall = lambda d: d.select(F.explode(F.create_map(*[y for c in d.columns for y in (F.lit(c), F.col(f"`{c}`"))])).alias("measure", "n"))
    return tall(f).unionByName(tall(x)).filter("n is not null")


def list_alerts(alerts: DataFrame, kind: str | None = None, resolved: bool | None = None, skip: int = 0, limit: int = 50) -> DataFrame:
    """A page of alerts, latest first and those of unknown time before them."""
    if kind is not None:
        alerts = alerts.filter(F.col("alert_type") == kind)
    if resolved is not None:
        alerts = alerts.filter(F.col("is_resolved") == resolved)
    shown = alerts.select("id", "alert_type", "filing_id", "exhibit_id", "deal_id", "title", "is_resolved", "created_at")
    return _page(shown, [F.col("created_at").desc_nulls_first(), F.col("id")], skip, limit)


def alert_stats(alerts: DataFrame) -> DataFrame:
    """(measure, n): all, unresolved, and unresolved per kind (left out if none)."""
    open_ = alerts.filter("not is_resolved")
    totals = alerts.agg(F.count(F.lit(1)).alias("t"), F.count_if(~F.col("is_resolved")).alias("u"))
    rows = totals.select(F.explode(F.create_map(F.lit("total"), F.col("t"), F.lit("unresolved"), F.col("u"))).alias("measure", "n"))
    return rows.unionByName(open_.groupBy(F.concat(F.lit("type:"), F.col("alert_type")).alias("measure")).agg(F.count(F.lit(1)).alias("n")))


def resolve_alerts(alerts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Alerts with decisions (alert_id, resolved_by, resolved_at, resolution_notes) applied; the latest decision counts."""
    last = decisions.groupBy("alert_id").agg(F.max_by(F.struct("resolved_by", "resolved_at", "resolution_notes"), "resolved_at").alias("d"))
    j = alerts.join(last, alerts["id"] == last["alert_id"], "left")
    decided = F.col("alert_id").isNotNull()
    return j.select(
        *[c for c in alerts.columns if c not in ("is_resolved", "resolved_at")],
        F.when(decided, True).otherwise(F.col("is_resolved")).alias("is_resolved"),
        F.when(decided, F.col("d.resolved_at")).otherwise(F.col("resolved_at")).alias("resolved_at"),
        F.col("d.resolved_by").alias("resolved_by"),
        F.col("d.resolution_notes").alias("resolution_notes"),
    )


def manual_inputs(alerts: DataFrame, inputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inputs (alert_id, field_name, value, entered_by, entered_at) that belong to an alert, and the alerts with those resolved."""
    kept = inputs.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_semi").select(inputs.columns)
    decisions = kept.groupBy("alert_id").agg(
        F.max_by("entered_by", "entered_at").alias("resolved_by"), F.max("entered_at").alias("resolved_at"), F.concat(F.lit("manual input: "), F.count(F.lit(1)).cast("string")).alias("resolution_notes")
    )
    return kept, resolve_alerts(alerts, decisions)


def search(deals: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Deals whose acquirer, target (as shown) or sponsor matches the text; smallest ids first."""
    hit = deals.filter(_like(deals, ("target_name_display", "acquirer_name_display", "sponsor_name_raw"), text))
    return hit.select("id", display_name().alias("title"), "state").orderBy("id").limit(limit)


def money_label(c: Column) -> Column:
    """$x.xxB from a billion, $x.xM from a million, else whole dollars; null stays null."""
    shown = lambda x, places: F.round(x, places).cast(f"decimal(20,{places})").cast("string")
    return (
        F.when(c >= 1e9, F.concat(F.lit("$"), shown(c / 1e9, 2), F.lit("B")))
        .when(c >= 1e6, F.concat(F.lit("$"), shown(c / 1e6, 1), F.lit("M")))
        .when(c.isNotNull(), F.concat(F.lit("$"), shown(c, 0)))
    )


def _deals(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "deals")


def _t(name: str):  # noqa: ANN202
    return lambda spark, root: read_table(spark, root, name)


_EVENTS, _PARTS, _FACTS, _FILINGS, _EXHIBITS, _ALERTS = map(_t, ("financing_events", "financing_participants", "atomic_facts", "filings", "exhibits", "processing_alerts"))

def nested_financing(events: DataFrame, participants: DataFrame) -> DataFrame:
    """Every event with its participants nested, shown in one line."""
    one = F.struct("id", F.concat(F.coalesce("bank_name_raw", F.lit("?")), F.lit(" ("), F.coalesce("role", F.lit("?")), F.lit(")")).alias("shown"))
    nested = participants.groupBy("financing_event_id").agg(F.array_sort(F.collect_list(one)).alias("p"))
    lines = nested.select(F.col("financing_event_id").alias("id"), F.array_join(F.transform("p", lambda x: x["shown"]), "; ").alias("participants"))
    return events.select("id", "deal_id", "instrument_type", "amount_usd").join(lines, "id", "left")


def q14_manual_inputs(spark: SparkSession, root: str) -> DataFrame:
    """Alerts resolved by an input for each field they need."""
    alerts = _ALERTS(spark, root)
    wanted = alerts.filter("not is_resolved").select(F.col("id").alias("alert_id"), F.explode("fields_needed").alias("field_name"), F.coalesce("updated_at", "created_at").alias("entered_at"))
    inputs = wanted.select("alert_id", "field_name", F.lit("entered").alias("value"), F.lit("reviewer").alias("entered_by"), "entered_at")
    resolved = manual_inputs(alerts, inputs)[1].filter("resolved_by is not null")
    return resolved.select("id", "alert_type", "is_resolved", "resolved_at", "resolved_by", "resolution_notes")


QUERIES = {
    "q1_list_deals": lambda s, r: list_deals(_deals(s, r), text="hold_ngs", skip=5, limit=50),
    "q1_sponsor_deals": lambda s, r: list_deals(_deals(s, r), sponsor_backed=True, limit=100),
    "q2_deal": lambda s, r: deal_by_id(_deals(s, r), 4).select("id", "state", "display_name", "deal_key"),
    "q3_deal_financing": lambda s, r: deals_with_financing(_deals(s, r), _EVENTS(s, r), _PARTS(s, r)),
    "q4_advisors": lambda s, r: advisors_of(_FACTS(s, r)),
    "q5_facts_per_deal": lambda s, r: _FACTS(s, r).filter("deal_id is not null").groupBy("deal_id", "fact_type").agg(F.count(F.lit(1)).alias("facts"), F.max("confidence").alias("max_confidence")),
    "q5_deal_facts": lambda s, r: _FACTS(s, r).filter("deal_id is not null").select("id", "deal_id", "fact_type", "filing_id", "exhibit_id", "evidence_snippet", "source_section", "extraction_method", "confidence"),
    "q3_nested_financing": lambda s, r: nested_financing(_EVENTS(s, r), _PARTS(s, r)),
    "q14_manual_inputs": q14_manual_inputs,
    "q6_deal_stats": lambda s, r: deal_stats(_deals(s, r), _EVENTS(s, r)),
    "q7_list_filings": lambda s, r: list_filings(_FILINGS(s, r), form="8-K", limit=200),
    "q8_filing_exhibits": lambda s, r: _FILINGS(s, r).select(F.col("id").alias("filing_id"), "accession_number").join(
        _EXHIBITS(s, r).select("filing_id", F.col("id").alias("exhibit_id"), "exhibit_type", "filename"), "filing_id"
    ),
    "q10_filing_stats": lambda s, r: filing_stats(_FILINGS(s, r), _EXHIBITS(s, r)),
    "q11_list_alerts": lambda s, r: list_alerts(_ALERTS(s, r), resolved=False, limit=200),
    "q12_unresolved_alerts": lambda s, r: _ALERTS(s, r).filter("not is_resolved").select("id", "alert_type", "title", "created_at"),
    "q15_alert_stats": lambda s, r: alert_stats(_ALERTS(s, r)),
    "q16_search": lambda s, r: search(_deals(s, r), "group"),
    "q19_value_and_dates": lambda s, r: list_deals(_deals(s, r), min_value=1e8, max_value=5e9, announced_from="2023-01-01 00:00:00", announced_to="2024-12-31 00:00:00", limit=200),
    "q20_money_labels": lambda s, r: _deals(s, r).select("id", money_label(F.col("deal_value_usd")).alias("label")),
}
_LIST = "select id, state, acquirer_name_raw, target_name_raw, deal_key, announcement_date, deal_value_usd, is_sponsor_backed, market_tag from deals"
_LAST = " order by announcement_date desc nulls last, id"
_HIT = " or ".join(f"coalesce({c} ilike '%hold_ngs%', false)" for c in ("target_name_normalized", "acquirer_name_normalized", "target_name_display", "acquirer_name_raw"))
_NAME = "coalesce(acquirer_name_raw, 'Unknown') || ' / ' || coalesce(target_name_display, target_name_raw, 'Unknown')"
SQL = {
    "q1_list_deals": f"{_LIST} where {_HIT}{_LAST} limit 50 offset 5",
    "q1_sponsor_deals": f"{_LIST} where is_sponsor_backed{_LAST} limit 100",
    "q2_deal": f"select id, state, {_NAME} as display_name, deal_key from deals where id = 4",
    "q3_deal_financing": """select d.id, d.deal_key, e.events, e.amount_usd, e.participants from deals d join (
        select deal_id, count(*) as events, round(sum(amount_usd), 2) as amount_usd, cast(sum(coalesce(n, 0)) as bigint) as participants
        from financing_events e left join (select financing_event_id, count(*) as n from financing_participants group by 1) p on p.financing_event_id = e.id group by 1) e on e.deal_id = d.id""",
    "q4_advisors": """select id, deal_id, coalesce(advisor.bank_name_raw, 'unknown') as bank_name_raw, coalesce(advisor.role, 'unknown') as role,
        coalesce(advisor.client_side, 'unknown') as client_side from atomic_facts where advisor is not null and deal_id is not null""",
    "q5_facts_per_deal": "select deal_id, fact_type, count(*) as facts, max(confidence) as max_confidence from atomic_facts where deal_id is not null group by 1, 2",
    "q5_deal_facts": "select id, deal_id, fact_type, filing_id, exhibit_id, evidence_snippet, source_section, extraction_method, confidence from atomic_facts where deal_id is not null",
    "q3_nested_financing": """select e.id, e.deal_id, e.instrument_type, e.amount_usd, p.participants from financing_events e left join (
        select financing_event_id, string_agg(coalesce(bank_name_raw, '?') || ' (' || coalesce(role, '?') || ')', '; ' order by id) as participants
        from financing_participants group by 1) p on p.financing_event_id = e.id""",
    "q14_manual_inputs": """select id, alert_type, true as is_resolved, coalesce(updated_at, created_at) as resolved_at, 'reviewer' as resolved_by,
        'manual input: ' || len(fields_needed) as resolution_notes from processing_alerts where not is_resolved and len(fields_needed) > 0""",
    "q6_deal_stats": "select 'total' as measure, count(*) as n from deals"
    + "".join(f" union all select 'state:{s}', count(*) filter (state = '{s}') from deals" for s in DEAL_STATES)
    + " union all select 'sponsor_backed', count(*) filter (is_sponsor_backed) from deals"
    + " union all select 'with_financing', count(distinct deal_id) from financing_events where deal_id in (select id from deals)",
    "q7_list_filings": """select id, accession_number, cik, form_type, filing_date, company_name, processed from filings where form_type = '8-K'
        order by filing_date desc nulls first, id limit 200""",
    "q8_filing_exhibits": "select f.id as filing_id, f.accession_number, e.id as exhibit_id, e.exhibit_type, e.filename from filings f join exhibits e on e.filing_id = f.id",
    "q10_filing_stats": "select * from (select 'total' as measure, count(*) as n from filings union all select 'processed', count(*) filter (processed) from filings"
    + " union all select 'unprocessed', count(*) filter (not processed) from filings"
    + "".join(f" union all select 'form:{t}', nullif(count(*) filter (form_type = '{t}'), 0) from filings" for t in COUNTED_FORMS)
    + " union all select 'exhibits', count(*) from exhibits union all select 'material', count(*) filter (is_material) from exhibits) where n is not null",
    "q11_list_alerts": """select id, alert_type, filing_id, exhibit_id, deal_id, title, is_resolved, created_at from processing_alerts where not is_resolved
        order by created_at desc nulls first, id limit 200""",
    "q12_unresolved_alerts": "select id, alert_type, title, created_at from processing_alerts where not is_resolved",
    "q15_alert_stats": """select 'total' as measure, count(*) as n from processing_alerts union all select 'unresolved', count(*) from processing_alerts where not is_resolved
        union all select 'type:' || alert_type, count(*) from processing_alerts where not is_resolved group by 1""",
    "q16_search": f"""select id, {_NAME} as title, state from deals where """
    + " or ".join(f"coalesce(contains(lower({c}), 'group'), false)" for c in ("acquirer_name_raw", "target_name_display", "sponsor_name_raw"))
    + " order by id limit 20",
    "q19_value_and_dates": f"""{_LIST} where deal_value_usd >= 1e8 and deal_value_usd <= 5e9 and announcement_date >= timestamp '2023-01-01'
        and announcement_date <= timestamp '2024-12-31'{_LAST} limit 200""",
    "q20_money_labels": """select id, case when deal_value_usd >= 1e9 then '$' || cast(round(deal_value_usd / 1e9, 2) as decimal(20, 2)) || 'B'
        when deal_value_usd >= 1e6 then '$' || cast(round(deal_value_usd / 1e6, 1) as decimal(20, 1)) || 'M'
        when deal_value_usd is not null then '$' || cast(round(deal_value_usd, 0) as decimal(20, 0)) end as label from deals""",
}
