"""Text normalisation and scalar extraction as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealweave.functions import patterns as P


def normalize_text(c: Column) -> Column:
    """Plain quotes, dashes and spaces; single spaces; at most one blank line (before line trimming)."""
    c = F.translate(c, P.TYPOGRAPHIC, P.PLAIN)
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r" *\n *", "\n")
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def preamble(c: Column, chars: int = 5000) -> Column:
    return F.substring(c, 1, chars)


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank text."""
    trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.isNull(), None).when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def quality(c: Column) -> Column:
    """failed without words, poor below 50 words, else good."""
    n = F.coalesce(word_count(c), F.lit(0))
    return F.when(n == 0, "failed").when(n < 50, "poor").otherwise("good")


def spans(text: Column, pattern: str) -> Column:
    """All matches with their positions: array of (start, text), start from 0.

    Position i is the length of all gaps up to i and all matches before i; the
    gaps come from splitting at the same pattern.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    lens = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda m, i: F.struct((lens(gaps, i + 1) + lens(found, i)).alias("start"), m.alias("text")))


def context(text: Column, start: Column, length: Column, window: int) -> Column:
    """Text from ``window`` characters before the match to ``window`` after it."""
    begin = F.greatest(start - window, F.lit(0))
    return F.substring(text, begin + 1, start + length + window - begin)


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def lookup(c: Column, table: dict[str, str | float]) -> Column:
    """Value of a small fixed table; null where it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def amount_usd(num: Column, scale: Column) -> Column:
    value = F.replace(num, F.lit(","), F.lit("")).try_cast("double")
    return value * F.coalesce(lookup(F.lower(scale), P.SCALES), F.lit(1.0))


def currency_amounts(text: Column) -> Column:
    """Array of (raw, value_usd) of all amounts."""
    raw = F.regexp_extract_all(text, F.lit(P.CURRENCY), F.lit(0))
    num = F.regexp_extract_all(text, F.lit(P.CURRENCY), F.lit(1))
    scale = F.regexp_extract_all(text, F.lit(P.CURRENCY), F.lit(2))
    zipped = F.arrays_zip(raw.alias("raw"), num.alias("num"), scale.alias("scale"))
    return F.transform(zipped, lambda x: F.struct(x["raw"].alias("raw"), amount_usd(x["num"], x["scale"]).alias("value_usd")))


def _month_day(c: Column) -> Column:
    tidy = F.regexp_replace(F.regexp_replace(c, ",", ""), r"\s+", " ")
    return F.date_format(F.try_to_date(F.initcap(tidy), "MMMM d yyyy"), "yyyy-MM-dd")


def agreement_date(text: Column, chars: int = 1000) -> Column:
    """ISO date of the first pattern with a valid date in the first characters; ISO dates are not validated."""
    head = F.substring(text, 1, chars)
    day_of = F.concat_ws(" ", first_group(head, P.DATE_DAY_OF, 2), first_group(head, P.DATE_DAY_OF, 1), first_group(head, P.DATE_DAY_OF, 3))
    return F.coalesce(
        _month_day(first_group(head, P.DATE_DATED)),
        _month_day(first_group(head, P.DATE_ENTERED)),
        _month_day(F.nullif(day_of, F.lit(""))),
        first_group(head, P.DATE_ISO),
    )


def instrument_type(raw: Column, default: str) -> Column:
    low = F.lower(F.trim(raw))
    out = F.lit(default)
    for word, kind in reversed(P.INSTRUMENT_TYPES):
        out = F.when(low.contains(word), kind).otherwise(out)
    return out


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ ,.\-]+|[ ,.\-]+$", "")


def normalize_party(c: Column) -> Column:
    """Party name for grouping: parentheses, jurisdiction and legal form cut in this order, lower case."""
    c = F.regexp_replace(c, r"\([^)]*\)", "")
    for pattern in (P.JURISDICTION, P.COMPANY_SUFFIX, P.COMPANY_SUFFIX_COMMA):
        c = F.regexp_replace(c, pattern, "")
    return F.lower(_strip(c))


def display_party(c: Column) -> Column:
    c = F.regexp_replace(c, r"\s*\([^)]*\)\s*", " ")
    return _strip(F.regexp_replace(c, P.JURISDICTION, ""))


def role_of_label(c: Column) -> Column:
    return lookup(F.lower(F.trim(c)), P.ROLE_LABELS)


def _bare(c: Column) -> Column:
    """Trimmed of all white space, no-break spaces included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _single_spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def cut_bank_endings(c: Column) -> Column:
    """Bank name without its usual endings, each cut at most once."""
    name = F.lower(_bare(c))
    name = reduce(lambda n, ending: F.regexp_replace(n, _quoted(ending) + "$", ""), P.BANK_ENDINGS, name)
    return _single_spaced(name)


def _quoted(text: str) -> str:
    return "".join("\\" + ch if ch in ".&" else ch for ch in text)


def drop_bank_pieces(c: Column) -> Column:
    name = F.lower(_bare(c))
    for piece in P.BANK_PIECES:
        name = F.replace(name, F.lit(piece), F.lit(""))
    return _single_spaced(name)


def canonical_role(c: Column) -> Column:
    """Role by contained words; other roles stay, in lower case."""
    r = F.lower(_bare(c))
    has = r.contains
    return (
        F.when(has("bookrunner"), F.when(has("joint"), "joint_bookrunner").otherwise("bookrunner"))
        .when(has("co-manager") | has("co manager"), "co_manager")
        .when(has("underwriter"), F.when(has("lead") | has("senior"), "lead_underwriter").otherwise("underwriter"))
        .when(
            has("arranger"),
            F.when(has("joint") & has("lead"), "joint_lead_arranger").when(has("lead") | has("mandated"), "lead_arranger").otherwise("arranger"),
        )
        .when(has("admin") & has("agent"), "admin_agent")
        .when(has("syndication"), "syndication_agent")
        .when(has("agent"), "agent")
        .otherwise(r)
    )
