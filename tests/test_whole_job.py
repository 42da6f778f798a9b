"""Cases that an operator once left out."""

from __future__ import annotations

import random

from dealweave.functions.fuzzy import ratio
from dealweave.operators import cluster, facts
from dealweave.plans import graph_queries, text_queries

NOTES = "Item 8.01 Other Events. On May 2 it sold $500 million aggregate principal amount of 5.25% Senior Notes due 2030."


def pages(spark, filings, exhibits=()):
    f = spark.createDataFrame(filings, "id bigint, form_type string, raw_html string, visual_text string")
    return f, spark.createDataFrame(list(exhibits), "id bigint, filing_id bigint, exhibit_type string, description string, raw_content string, visual_text string")


def test_facts_of_documents_without_stored_text(spark):
    release = "The buyer is an entity that is controlled by Blackstone, it said."
    got = facts.extract_facts(*pages(
        spark,
        [(1, "8-K", f"<p>{NOTES}</p>", None), (2, "8-K/A", f"<p>{NOTES}</p>", ""), (3, "8-K", "<p>old</p>", NOTES), (4, "8-K", None, None), (5, "10-K", f"<p>{NOTES}</p>", None)],
        [(7, 4, "EX-99.1", None, f"<p>{release}</p>", None), (8, 4, "EX-99.1", None, None, None), (9, 4, "EX-3", None, f"<p>{release}</p>", None)],
    )).collect()
    assert sorted(r["filing_id"] for r in got if r["fact_type"] == "FINANCING_MENTION") == [1, 2, 3]
    assert {r["exhibit_id"] for r in got if r["fact_type"] == "SPONSOR_MENTION"} == {7}


def test_financing_facts_carry_the_underwriters_of_their_document(spark):
    deal = " It entered into a purchase agreement with Zeta Bank and Acme Securities, as representatives of the several underwriters."
    f, e = pages(spark, [(1, "8-K", None, NOTES + deal + " It drew a $20 million term loan."), (2, "8-K", None, deal), (3, "8-K", None, NOTES)])
    got = facts.extract_facts(f, e).collect()
    financing = [(r["filing_id"], [(p["bank"], p["bank_normalized"], p["role"]) for p in r["participants"]]) for r in got if r["fact_type"] == "FINANCING_MENTION"]
    both = [("Zeta Bank", "zeta bank", "representative"), ("Acme Securities", "acme securities", "representative")]
    assert sorted(financing) == [(1, both), (1, both), (3, [])]
    alone = [(r["filing_id"], r["name"], r["participants"]) for r in got if r["fact_type"] == "ADVISOR_MENTION"]
    assert sorted(alone) == [(2, "Acme Securities", None), (2, "Zeta Bank", None)]


def test_parties_of_announcements(spark):
    item = "Item 1.01 Entry into a Material Definitive Agreement. "
    parties = "Alpha Foods, Inc. (a Delaware corporation), and Beta Rail Corp."
    deal = "It entered into a definitive agreement, dated as of May 2, 2024, by and among " + parties
    f, e = pages(spark, [(1, "8-K", None, item + deal), (2, "8-K", None, deal), (3, "8-K", None, item + "by and among " + parties), (4, "8-K", f"<p>{item}{deal}</p>", None), (5, "8-K", None, item + deal.replace("by and", "x" * 5000 + " by and"))])
    got = [r for r in facts.extract_facts(f, e).collect() if r["fact_type"] == "PARTY_MENTION"]
    names = ["Alpha Foods, Inc. (a Delaware corporation)", "Beta Rail Corp"]
    assert sorted((r["filing_id"], r["name"]) for r in got) == [(i, n) for i in (1, 4) for n in names]
    assert {(r["value"], r["confidence"], r["evidence_snippet"]) for r in got} == {("Unknown", 0.7, parties[:-1])}


def test_candidates_are_all_pairs(spark):
    names = ["ferfutru rail holdings", "ferfutrurail holdings", "kubepen resins holdings", "kubrpen rrsins holdings", "ab", "a", "", "rail holdings"]
    rng = random.Random(3)
    for base in ["northwind steel", "halden foods group", "omega"] * 12:
        at = rng.randrange(len(base))
        names.append(base[:at] + rng.choice("xyz e") * rng.randrange(3) + base[at + rng.randrange(3) :])
    rows = [(i, f"k{i % 70}", n) for i, n in enumerate([*names, *names[:20], names[0], names[2]])]
    deals = spark.createDataFrame(rows, "id bigint, deal_key string, target_name_normalized string")
    for least in (85.0, 60.0):
        got = {tuple(r) for r in cluster.merge_candidates(deals, least).collect()}
        key, name = {i: k for i, k, _ in rows}, {i: n for i, _, n in rows}
        # Every row is true, and every two alike names of different keys are linked once.
        assert all(i < j and key[i] != key[j] and (s == 100.0 if name[i] == name[j] else s == ratio(name[i], name[j]) > least) for i, j, s in got)
        alike = {frozenset((m, n)) for i, k, m in rows for j, l, n in rows if m != n and k != l and ratio(m, n) > least}
        assert sorted(map(sorted, alike)) == sorted(sorted((name[i], name[j])) for i, j, _ in got if name[i] != name[j])
        keys = {(n, k) for _, k, n in rows}
        assert sum(name[i] == name[j] for i, j, _ in got) == len(keys) - len({n for n, _ in keys})
    members = {r["deal_id"]: r["representative"] for r in cluster.candidate_members(deals).collect()}
    assert len(members) == len(rows) and all(members[i] == min(j for j, l, m in rows if (l, m) == (k, n)) for i, k, n in rows)


def test_pages_of_exhibits_are_read_too(spark, tmp_path):
    page = "<p>Lenders</p><table><tr><th>Name</th><th>Role</th></tr><tr><td>Goldman Sachs</td><td>Arranger</td></tr></table>"
    root = str(tmp_path)
    spark.createDataFrame([(1, page), (2, None)], "id bigint, raw_html string").write.parquet(f"{root}/filings.parquet")
    spark.createDataFrame([(1, page), (3, page)], "id bigint, raw_content string").write.parquet(f"{root}/exhibits.parquet")
    want = [("exhibits", 1), ("exhibits", 3), ("filings", 1)]
    assert sorted((r["record_table"], r["id"]) for r in text_queries.t1_visual_text(spark, root).collect()) == want
    assert sorted({(r["record_table"], r["id"]) for r in text_queries.h1_table_cells(spark, root).collect()}) == want
    assert sorted({(r["record_table"], r["key"]) for r in graph_queries.h4_column_kinds(spark, root).collect()}) == want
