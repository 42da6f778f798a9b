"""Documents to facts with evidence: parties, dates, sponsors, financing, underwriters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealweave.functions import patterns as P
from dealweave.functions import text as X
from dealweave.functions.markup import visual_text_udf
from dealweave.session import cut_lineage

_MASK = re.compile(r"\([^()]*\)")
_SEPARATOR = re.compile(
    r",\s+and\s+|,(?!\s*a\s+[A-Za-z]+\s)\s+(?=[A-Z][a-z]+\s+(?:Inc|Corp|LLC|Ltd|Co|LP|Holdings|Group|Merger))|(?<=[)\"'])\s+and\s+",
    re.IGNORECASE,
)


def split_parties(span: str | None) -> list[str] | None:
    """Parties of a list; what stands in parentheses never separates, nor does a jurisdiction."""
    if span is None:
        return None
    flat = " ".join(span.split())
    masked = flat
    while (hidden := _MASK.sub(lambda m: "\x01" * (len(m.group(0)) - 1) + ")", masked)) != masked:
        if hidden.count("(") == 0:
            masked = hidden
            break
        masked = hidden
    out, at = [], 0
    for m in _SEPARATOR.finditer(masked):
        out.append(flat[at : m.start()].strip())
        at = m.end()
    out.append(flat[at:].strip())
    return [p for p in out if p]


@F.pandas_udf(T.ArrayType(T.StringType()))
def split_parties_udf(spans: pd.Series) -> pd.Series:
    return spans.map(split_parties, na_action="ignore")


def party_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, party_name_raw, party_name_normalized, role_label, confidence) of merger-agreement preambles.

    Roles come from the defined term inside the party; without one, from the
    position: the last of three is the Company, the first of several the Parent.
    """
    head = X.preamble(F.col(text))
    span = F.coalesce(X.first_group(head, P.PARTY_LIST), X.first_group(head, P.PARTY_LIST_ALT))
    listed = docs.filter(head.rlike(P.MERGER_HEADER)).select(key, span.alias("span")).filter("span is not null")
    parties = listed.select(key, split_parties_udf("span").alias("parties"))
    each = parties.select(key, F.size("parties").alias("n"), F.posexplode("parties").alias("position", "raw"))
    label = X.first_group(F.col("raw"), P.DEFINED_TERM)
    by_place = F.when((F.col("n") == 3) & (F.col("position") == 2), "Company").when((F.col("n") >= 2) & (F.col("position") == 0), "Parent").otherwise("Unknown")
    known = X.role_of_label(label).isNotNull()
    return each.select(
        key,
        "position",
        F.col("raw").alias("party_name_raw"),
        X.normalize_party(F.col("raw")).alias("party_name_normalized"),
        F.when(known, label).otherwise(by_place).alias("role_label"),
        F.when(known, 0.9).otherwise(0.6).alias("confidence"),
    )


def party_mentions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, party_name_raw, role_label, evidence_snippet, confidence) of the party list in announcements."""
    head = X.preamble(F.col(text))
    span = F.coalesce(X.first_group(head, P.PARTY_LIST), X.first_group(head, P.PARTY_LIST_ALT))
    listed = docs.select(key, span.alias("span")).filter("span is not null")
    parties = listed.select(key, F.substring("span", 1, 500).alias("evidence_snippet"), split_parties_udf("span").alias("parties"))
    return parties.select(key, F.explode("parties").alias("party_name_raw"), F.lit("Unknown").alias("role_label"), "evidence_snippet", F.lit(0.7).alias("confidence"))


def labelled_parties(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, party, label, role): each known defined term and the last segment between commas or semicolons before it."""
    c = F.col(text)
    x = docs.filter(c.rlike(P.DEFINED_TERM)).select(key, c.alias("_t"), F.explode(X.spans(c, P.DEFINED_TERM)).alias("m"))
    label = F.regexp_extract("m.text", P.DEFINED_TERM, 1)
    before = F.regexp_extract(F.trim(F.expr("substring(_t, 1, m.start)")), r"(?s)([^,;]*)$", 1)
    out = x.select(key, F.col("m.start").alias("start"), F.trim(before).alias("party"), label.alias("label"), X.role_of_label(label).alias("role"))
    return out.filter("party <> '' and role is not null")


def item_section(text: Column, item: str = P.ITEM_101) -> Column:
    """The section of an item up to the next numbered item or the end; null without it."""
    section = F.regexp_extract(text, rf"(?s)({item}.*?)(?=(?-i:Item)\s+\d+\.\d+|\z)", 1)
    return F.nullif(section, F.lit(""))


def pdf_outcomes(exhibits: DataFrame) -> DataFrame:
    """(id, quality, outcome) of PDF exhibits: good text is ``processed``; of the rest material ones are an ``alert``, others ``skipped``."""
    pdf = exhibits.filter("is_pdf").select("id", "is_material", X.quality(F.col("visual_text")).alias("quality"))
    outcome = F.when(F.col("quality") == "good", "processed").when(F.col("is_material"), "alert").otherwise("skipped")
    return pdf.select("id", "quality", outcome.alias("outcome"))


def pdf_financing(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, facility_type, amounts, amount_usd): kind of the first wording that occurs, number and largest of the amounts."""
    low = F.lower(text)
    has = low.contains
    kind = (
        F.when(has("term loan"), "term_loan").when(has("revolving"), "rcf").when(has("bridge"), "bridge")
        .when(has("bond") | has("note"), "bond").when(has("credit"), "loan")
    )
    found = X.currency_amounts(F.col(text))
    return docs.filter(F.col(text) != "").select(key, kind.alias("facility_type"), F.size(found).alias("amounts"), F.array_max(F.transform(found, lambda a: a["value_usd"])).alias("amount_usd"))


def missing_party_alerts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, preamble_hash, preamble_preview) of merger agreements whose parties were not found."""
    head = X.preamble(F.col(text))
    none = X.first_group(head, P.PARTY_LIST).isNull() & X.first_group(head, P.PARTY_LIST_ALT).isNull()
    return docs.filter(head.rlike(P.MERGER_HEADER) & none).select(key, F.sha2(head, 256).alias("preamble_hash"), F.substring(text, 1, 500).alias("preamble_preview"))


def sponsor_facts(docs: DataFrame, key: str, text: str, window: int = 150) -> DataFrame:
    """Sponsor mentions: known names (first occurrence each) and affiliation phrases, unless negated nearby."""
    c = F.col(text)
    low = F.lower(c)
    known = F.array(*[F.struct(F.lit(k).alias("alias"), F.lit(v).alias("display")) for k, v in P.SPONSORS.items()])
    seeds = docs.select(key, c.alias("_t"), F.explode(F.filter(known, lambda a: low.contains(a["alias"]))).alias("a"))
    start = F.expr("instr(lower(_t), a.alias) - 1")
    seeds = seeds.select(
        key,
        F.expr("substring(_t, instr(lower(_t), a.alias), length(a.alias))").alias("sponsor_name_raw"),
        F.col("a.alias").alias("sponsor_name_normalized"),
        F.lit("seed_list").alias("source_pattern"),
        X.context(F.col("_t"), start, F.length("a.alias"), window).alias("context_snippet"),
        F.lit(0.95).alias("confidence"),
    )
    hits = docs.filter(c.rlike(P.SPONSOR_AFFILIATION)).select(key, c.alias("_t"), F.explode(X.spans(c, P.SPONSOR_AFFILIATION)).alias("m"))
    raw = F.trim(F.regexp_extract("m.text", P.SPONSOR_AFFILIATION, 1))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(raw), r"[,.\-']", ""), r"\s+", " "))
    is_known = norm.isin(*P.SPONSORS)
    phrases = hits.select(
        key,
        raw.alias("sponsor_name_raw"),
        norm.alias("sponsor_name_normalized"),
        F.when(is_known, "seed_list").otherwise("affiliation_pattern").alias("source_pattern"),
        X.context(F.col("_t"), F.col("m.start"), F.length("m.text"), window).alias("context_snippet"),
        F.when(is_known, 0.95).otherwise(0.85).alias("confidence"),
    ).filter("sponsor_name_raw <> ''")
    return seeds.unionByName(phrases).filter(~F.col("context_snippet").rlike(P.SPONSOR_NEGATION))


def financing_facts(docs: DataFrame, key: str, text: str, window: int = 200) -> DataFrame:
    """Debt instruments with amount, type, rate, maturity and evidence."""

    def part(pattern: str, group: int, default: str, confidence: float, rated: bool) -> DataFrame:
        c = F.col(text)
        x = docs.filter(c.rlike(pattern)).select(key, c.alias("_t"), F.explode(X.spans(c, pattern)).alias("m"))
        amount, raw = F.regexp_extract("m.text", pattern, 1), F.regexp_extract("m.text", pattern, group)
        num, scale = X.first_group(amount, P.CURRENCY, 1), F.regexp_extract(amount, P.CURRENCY, 2)
        return x.select(
            key,
            X.instrument_type(raw, default).alias("instrument_type"),
            raw.alias("instrument_raw"),
            X.amount_usd(num, scale).alias("amount_usd"),
            amount.alias("amount_raw"),
            (F.trim(X.first_group(F.col("m.text"), pattern, 2)) if rated else F.lit(None).cast("string")).alias("interest_rate"),
            (X.first_group(F.col("m.text"), pattern, 4) if rated else F.lit(None).cast("string")).alias("maturity_year"),
            F.col("m.start").alias("evidence_start_offset"),
            X.context(F.col("_t"), F.col("m.start"), F.length("m.text"), window).alias("evidence_snippet"),
            F.lit(confidence).alias("confidence"),
        )

    return part(P.DEBT_INSTRUMENT, 3, "bond", 0.9, True).unionByName(part(P.CREDIT_FACILITY, 2, "credit_facility", 0.85, False))


def underwriter_facts(docs: DataFrame, key: str, text: str, window: int = 150) -> DataFrame:
    """Underwriters named in purchase agreements, with the role their surroundings tell."""
    return _placed_underwriters(docs, key, text, window).drop("place")


def _placed_underwriters(docs: DataFrame, key: str, text: str, window: int = 150) -> DataFrame:
    """Underwriters with their place: pattern, start of the match, position in it."""

    def part(number: int, pattern: str) -> DataFrame:
        c = F.col(text)
        x = docs.filter(c.rlike(pattern)).select(key, c.alias("_t"), F.explode(X.spans(c, pattern)).alias("m"))
        around = X.context(F.col("_t"), F.col("m.start"), F.length("m.text"), window)
        names = F.split(F.regexp_extract("m.text", pattern, 1), r"(?i)\s+and\s+|,\s*")
        each = x.select(key, F.col("m.start").alias("start"), F.posexplode(names).alias("position", "n"), around.alias("evidence_snippet"))
        return each.select(key, F.struct(F.lit(number).alias("pattern"), "start", "position").alias("place"), "evidence_snippet", F.trim("n").alias("name_raw"))

    both = part(1, P.UNDERWRITERS).unionByName(part(2, P.UNDERWRITERS_SIMPLE))
    low = F.lower("evidence_snippet")
    role = F.when(low.contains("lead") | low.contains("book-running"), "lead_manager").when(low.contains("representative"), "representative").otherwise("underwriter")
    kept = both.filter((F.length("name_raw") >= 3) & ~F.lower("name_raw").isin("the", "as", "of", "several", "representatives"))
    return kept.select(key, "name_raw", F.lower("name_raw").alias("name_normalized"), role.alias("role"), "evidence_snippet", F.lit(0.85).alias("confidence"), "place")


_PARTICIPANTS = "array<struct<bank:string,bank_normalized:string,role:string,evidence:string>>"


def participants_of(banks: DataFrame, key: str) -> DataFrame:
    """(key, participants): all underwriters of a document in the order of their places."""
    one = F.struct("place", F.col("name_raw").alias("bank"), F.col("name_normalized").alias("bank_normalized"), "role", F.substring("evidence_snippet", 1, 200).alias("evidence"))
    ordered = F.array_sort(F.collect_list(one))
    return banks.groupBy(key).agg(F.transform(ordered, lambda x: x.dropFields("place")).alias("participants"))


def is_form(form: Column) -> Column:
    return form.isin("8-K", "8-K/A")


def exhibit_class(kind: Column) -> Column:
    """EX-2, EX-10 or EX-99 of an exhibit type, spelt either way; null for others."""
    code = F.regexp_extract(F.upper(kind), r"^(?:EX-|EXHIBIT\s+)(\d+)", 1)
    return F.when(code == "2", "EX-2").when(code == "10", "EX-10").when(code == "99", "EX-99")


def with_text(docs: DataFrame, keep: list[Column], markup: str) -> DataFrame:
    """The kept columns and ``t``: the stored visual text, or the text of the markup where none is stored.

    Derived texts are written once, because several extractors read them.
    """
    stored = F.coalesce(F.col("visual_text"), F.lit("")) != ""
    made = docs.filter(~stored & (F.col(markup) != "")).select(*keep, X.normalize_text(visual_text_udf(markup)).alias("t"))
    return docs.filter(stored).select(*keep, F.col("visual_text").alias("t")).unionByName(cut_lineage(made))


def extract_facts(filings: DataFrame, exhibits: DataFrame) -> DataFrame:
    """All facts of 8-K bodies and exhibits: (fact_type, filing_id, exhibit_id, name, value, evidence_snippet, confidence, participants).

    ``name`` is the party, sponsor, instrument, bank or date kind, ``value`` its
    role, source, amount or date.  ``participants`` of a FINANCING_MENTION are all
    underwriters of its document; other facts have none.  Documents without stored visual text are read
    from their markup.  Each document yields facts on its own; only instruments
    and underwriters of one document are joined.
    """
    body = with_text(filings.filter(is_form(F.col("form_type"))), [F.col("id").alias("filing_id"), F.lit(None).cast("bigint").alias("exhibit_id")], "raw_html")
    kind = exhibit_class(F.col("exhibit_type"))
    kinds = with_text(exhibits.filter(kind.isNotNull()), [F.col("filing_id"), F.col("id").alias("exhibit_id"), F.col("description"), kind.alias("kind")], "raw_content")
    ids = F.struct("filing_id", "exhibit_id").alias("k")

    def shaped(df: DataFrame, kind: str, name: str, value: str, evidence: str, confidence: str | Column) -> DataFrame:
        conf = F.col(confidence) if isinstance(confidence, str) else confidence
        return df.select(F.lit(kind).alias("fact_type"), "k.filing_id", "k.exhibit_id", F.col(name).alias("name"), F.col(value).cast("string").alias("value"), F.col(evidence).alias("evidence_snippet"), conf.alias("confidence"), F.col("participants") if "participants" in df.columns else F.lit(None).cast(_PARTICIPANTS).alias("participants"))

    merger = kinds.filter("kind = 'EX-2'").select(ids, "t")
    material = kinds.filter((F.col("kind") == "EX-99") | ((F.col("kind") == "EX-10") & F.lower("description").rlike("commitment|equity"))).select(ids, "t")
    events = body.filter(F.col("t").rlike(P.ITEM_801) | F.col("t").rlike(P.PURCHASE_AGREEMENT)).select(ids, "t")
    debt, banks = financing_facts(events, "k", "t"), _placed_underwriters(events, "k", "t")
    financed = debt.join(participants_of(banks, "k"), "k", "left").withColumn("participants", F.coalesce("participants", F.array().cast(_PARTICIPANTS)))
    alone = banks.join(debt.select("k").distinct(), "k", "left_anti")
    announced = body.filter(F.col("t").rlike(P.ITEM_101) & F.col("t").rlike(P.DEFINITIVE_AGREEMENT)).select(ids, "t")
    dated = events.unionByName(announced).unionByName(merger)
    dates = dated.select("k", F.lit("agreement_date").alias("n"), X.agreement_date(F.col("t")).alias("v")).filter("v is not null").distinct()
    return (
        shaped(party_facts(merger, "k", "t"), "PARTY_DEFINITION", "party_name_raw", "role_label", "party_name_raw", "confidence")
        .unionByName(shaped(party_mentions(announced, "k", "t"), "PARTY_MENTION", "party_name_raw", "role_label", "evidence_snippet", "confidence"))
        .unionByName(shaped(sponsor_facts(material, "k", "t"), "SPONSOR_MENTION", "sponsor_name_raw", "source_pattern", "context_snippet", "confidence"))
        .unionByName(shaped(financed, "FINANCING_MENTION", "instrument_type", "amount_usd", "evidence_snippet", "confidence"))
        .unionByName(shaped(alone, "ADVISOR_MENTION", "name_raw", "role", "evidence_snippet", "confidence"))
        .unionByName(shaped(dates, "DEAL_DATE", "n", "v", "v", F.lit(0.9)))
    )
