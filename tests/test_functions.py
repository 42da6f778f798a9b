from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealweave.functions import patterns as P
from dealweave.functions import text as X
from dealweave.functions.fuzzy import common_subsequence, partial_ratio, ratio
from dealweave.functions.markup import cells_of, table_cells, visual_text
from dealweave.operators import facts, tables


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("$731,250,000", [7.3125e8]),
        ("from $3.25 billion down to $40 million", [3.25e9, 4e7]),
        ("$9.1bn", [9.1e9]),
        ("$63M", [6.3e7]),
        ("$4812", [481.0]),
        ("$20 by", [2e10]),
        ("none", []),
    ],
)
def test_amounts(spark, raw, want):
    assert [a["value_usd"] for a in one(spark, raw, X.currency_amounts)] == pytest.approx(want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("dated as of October 9, 2021", "2021-10-09"),
        ("entered into on June 30 2022", "2022-06-30"),
        ("dated as of the 2nd day of August, 2019", "2019-08-02"),
        ("dated 2024-13-45", "2024-13-45"),
        ("entered into as of July 4, 2020", None),
        ("dated as of February 31, 2024", None),
        (None, None),
    ],
)
def test_dates(spark, raw, want):
    assert one(spark, raw, X.agreement_date) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Quorvane Mills, Inc.", "quorvane mills"),
        ("Ov, Inc., a Nevada corporation", "ov"),
        ('Ov, Inc., a Nevada corporation ("Buyer")', "ov, inc., a nevada corporation"),
        ("Visa", "vi"),
        ("Tessamo Corp.", "tessamo corp"),
        ("Ildra, Corp.", "ildra"),
    ],
)
def test_party_names(spark, raw, want):
    assert one(spark, raw, X.normalize_party) == want


def test_normalize_text(spark):
    assert one(spark, "“A” – b  c​\n\n\n\nd \n e", X.normalize_text) == '"A" - b c\n\nd\ne'


def test_spans_are_positions(spark):
    text = "ab $5 xx $6.5 billion"
    got = spark.createDataFrame([(text,)], "x string").select(X.spans(F.col("x"), P.CURRENCY).alias("s")).first()["s"]
    assert [(s["start"], text[s["start"] :].startswith(s["text"])) for s in got] == [(3, True), (9, True)]


def test_roles(spark):
    rows = {"Joint Bookrunner": "joint_bookrunner", "Mandated Lead Arranger": "lead_arranger", "Admin. Agent": "admin_agent", "Notary": "notary", "co manager": "co_manager"}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", X.canonical_role(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == rows


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_ratio_is_symmetric_and_bounded(a, b):
    assert ratio(a, b) == ratio(b, a)
    assert 0 <= ratio(a, b) <= 100
    assert (ratio(a, b) == 100) == (a == b)
    assert partial_ratio(a, b) >= 0


def test_ratio_values():
    assert common_subsequence("harbor lines", "harbor lines north") == 12
    assert ratio("harbor lines", "harbor lines north") == pytest.approx(80.0)
    assert partial_ratio("abc", "xxabcx") == 100


def test_visual_text():
    page = "<head><title>t</title></head><p>A <b>B</b></p><script>x</script><table><tr><td>Bank</td><td>Role.</td></tr></table><!-- c -->"
    out = visual_text(page)
    assert "A B" in out and "x" not in out and "t" != out and "Bank | Role." in out
    assert visual_text(None) is None and visual_text("") == ""


@given(st.lists(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3)), min_size=1, max_size=4), min_size=1, max_size=4))
def test_grid_is_complete(rows):
    page = "<table>" + "".join("<tr>" + "".join(f'<td rowspan="{d}" colspan="{a}">x</td>' for d, a in r) + "</tr>" for r in rows) + "</table>"
    cells = table_cells(page)
    width = max(sum(a for _, a in r) for r in rows)
    assert len(cells) == len(rows) * width
    assert len({(r, c) for _, r, c, _, _ in cells}) == len(cells)


SYNDICATE = """<table><tr><th>Name</th><th>Role</th><th>Amount</th></tr>
<tr><td>Goldman Sachs</td><td>Joint Bookrunner</td><td>$10</td></tr><tr><td>Ildra Capital</td><td>Co-Manager</td><td>$5</td></tr>
<tr><td>Total</td><td></td><td>$15</td></tr></table>"""


def test_bank_roles(spark):
    pages = spark.createDataFrame([(1, SYNDICATE), (2, None), (3, "<p>none</p>")], "id bigint, html string")
    cells = cells_of(pages, "id", "html").withColumnRenamed("id", "key")
    got = {(r["bank"], r["role"]) for r in tables.bank_roles(cells).collect()}
    assert got == {("Goldman Sachs", "Joint Bookrunner"), ("Ildra Capital", "Co-Manager")}
    kinds = {r["col_no"]: (r["is_role"], r["is_bank"]) for r in tables.column_kinds(cells).collect()}
    assert kinds[1] == (True, False) and kinds[0][1]


@pytest.mark.parametrize(
    ("span", "want"),
    [
        ("Quorvane Inc., Ildra Corp., and Tessamo LLC", ["Quorvane Inc.", "Ildra Corp.", "Tessamo LLC"]),
        ("Quorvane Inc. (organised in Nevada, and elsewhere), and Ildra Corp.", ["Quorvane Inc. (organised in Nevada, and elsewhere)", "Ildra Corp."]),
        ('Ov Inc., a Nevada corporation ("Buyer") and Um LLC', ['Ov Inc., a Nevada corporation ("Buyer")', "Um LLC"]),
        ("", []),
    ],
)
def test_split_parties(span, want):
    assert facts.split_parties(span) == want


def test_facts_of_documents(spark):
    text = (
        'PLAN OF MERGER dated as of October 9, 2021, by and among Quorvane Holdings Inc. (the "Parent"), Ildra Merger Sub Inc. '
        '("Merger Sub"), and Tessamo Corp. (the "Company").'
    )
    docs = spark.createDataFrame([(1, text), (2, "MERGER AGREEMENT without parties"), (3, None)], "id bigint, t string")
    got = {r["position"]: (r["role_label"], r["confidence"]) for r in facts.party_facts(docs, "id", "t").collect()}
    assert got == {0: ("Parent", 0.9), 1: ("Merger Sub", 0.9), 2: ("Company", 0.9)}
    assert [r["id"] for r in facts.missing_party_alerts(docs, "id", "t").collect()] == [2]
    debt = spark.createDataFrame([(1, "sold $731 million aggregate principal amount of 6.5% Senior Notes due 2029 beside a $2.4 billion revolving credit facility")], "id bigint, t string")
    rows = {(r["instrument_type"], r["amount_usd"], r["interest_rate"], r["maturity_year"]) for r in facts.financing_facts(debt, "id", "t").collect()}
    assert rows == {("bond", 7.31e8, "6.5%", "2029"), ("rcf", 2.4e9, None, None)}
    banks = spark.createDataFrame([(1, "terms set with Quorvane Securities and Ildra Bank, as representatives of the several underwriters")], "id bigint, t string")
    assert {(r["name_raw"], r["role"]) for r in facts.underwriter_facts(banks, "id", "t").collect()} == {("Quorvane Securities", "representative"), ("Ildra Bank", "representative")}
    sponsor = spark.createDataFrame([(1, "a portfolio company of Thoma Bravo, which"), (2, "KKR is not a financial sponsor here")], "id bigint, t string")
    found = facts.sponsor_facts(sponsor, "id", "t").collect()
    assert {r["id"] for r in found} == {1} and {r["source_pattern"] for r in found} == {"seed_list"}
