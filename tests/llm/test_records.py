from __future__ import annotations

import datetime as dt
import itertools
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealweave.llm import canonical, queries, survivors, variants
from dealweave.llm.lexicon import damerau_pairs, damerau_within, encode, name_tokens, osa_within, strip_legal, true_damerau

D = dt.datetime


def brute_osa(a, b):
    d = [[max(i, j) if not min(i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


short = st.text("abc", max_size=7)


@settings(max_examples=200, deadline=None)
@given(short, short, st.integers(0, 4))
def test_bounded_distance(a, b, limit):
    assert osa_within(a, b, limit) == min(brute_osa(a, b), limit + 1)


@settings(max_examples=200, deadline=None)
@given(short, short, short)
def test_true_metric(a, b, c):
    assert true_damerau(a, b) == true_damerau(b, a) and (true_damerau(a, b) == 0) == (a == b)
    assert true_damerau(a, c) <= true_damerau(a, b) + true_damerau(b, c)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=9), st.text("abcd", max_size=9)), min_size=1, max_size=12), st.integers(0, 4))
def test_banded_and_vector_metric(pairs, limit):
    left, right = encode([a for a, _ in pairs]), encode([b for _, b in pairs])
    assert damerau_pairs(*left, *right).tolist() == [true_damerau(a, b) for a, b in pairs]
    assert [damerau_within(a, b, limit) for a, b in pairs] == [min(true_damerau(a, b), limit + 1) for a, b in pairs]


@settings(max_examples=80, deadline=None)
@given(st.lists(short, min_size=1, max_size=25), st.lists(short, max_size=4), st.integers(0, 3))
def test_tree_equals_scan(words, probes, limit):
    words = [*words, "ab" * 150, "ba" * 150]
    probes = [*probes, "ab" * 149 + "b", "x" * 5000]
    tree = canonical.BKTree([(w, w) for w in words])
    wanted = [sorted((d, w) for w in set(words) if (d := damerau_within(p, w, limit)) <= limit) for p in probes]
    assert [sorted(found) for found in tree.within(probes, [limit] * len(probes))] == wanted


def test_near_words_equal_scan(spark):
    """Two deletions find every pair within the edits allowed, one deletion every pair within one edit."""
    random.seed(4)
    letters = "abcdefgh"
    words = {"".join(random.choice(letters) for _ in range(n)) for n in (2, 3, 4, 5, 6, 7, 8, 9, 12, 30, 31, 32, 33, 34, 50) for _ in range(6)}
    for w in sorted(words):
        for _ in range(2):
            x = list(w)
            for _ in range(random.randint(1, 2)):
                at = random.randrange(len(x))
                match random.randint(0, 3):
                    case 0:
                        x[at] = random.choice(letters)
                    case 1 if len(x) > 2:
                        del x[at]
                    case 2 if at:
                        x[at - 1], x[at] = x[at], x[at - 1]
                    case _:
                        x.insert(at, random.choice(letters))
            words.add("".join(x))
    words = sorted(w for w in words if len(w) > 1)
    df = spark.createDataFrame([("f", w) for w in words] + [("g", "abcdefgh"), ("g", ""), ("g", "a")], "field string, word string")
    two = {(r["word"], r["other"]) for r in variants.near_words(df, ["field"], 2).collect()}
    one = {(r["word"], r["other"]) for r in variants.near_words(df, ["field"], 1).collect()}
    within = {(a, b): brute_osa(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 3}
    assert two == {p for p, d in within.items() if d <= variants.edits_allowed(*p)}
    assert one <= two and {p for p in two if within[p] == 1} <= one


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["&", "and", "co", "company", "inc", "x", "corp", "the", ",", "A.", "N.A.", "(1)", ""]), max_size=7))
def test_no_name_raises(parts):
    name = " ".join(parts)
    words = name_tokens(name)
    assert bool(strip_legal(words)) == bool(words)
    variants.words_of_name(name), variants.anchor_words(name), variants.brief_keys(name), variants.brief_probe(name), variants.is_formal(name)
    canonical.bank_forms(name), canonical.role_forms(name), canonical.bank_entries(name, name), canonical.role_entries(name, name)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_no_text_raises(name):
    variants.words_of_name(name), variants.anchor_words(name), variants.brief_keys(name), variants.brief_probe(name), variants.is_formal(name)
    canonical.bank_forms(name), canonical.role_forms(name)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 5).flatmap(lambda n: st.lists(st.lists(st.sampled_from([0.0, 0.25, 0.5, 1.0, 2.0, 1e6]), min_size=n, max_size=n), min_size=n, max_size=n)))
def test_assignment_is_least(cost):
    n = len(cost)
    assert abs(variants.assignment(cost) - min(sum(cost[i][p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-6


def test_long_names_align():
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet".split()
    assert variants.align_cost(tuple(words), tuple(reversed(words))) == 0.0
    assert variants.align_cost(tuple(words), (*reversed(words[1:]), "alphs")) == 1.0
    assert variants.align_cost(tuple("abcdefghijklmnopqrst") + ("river", "bank"), ("river", "bank")) == 0.25
    assert variants.align_cost(tuple(f"w{k}x" for k in range(3000)), tuple(f"v{k}y" for k in range(3000))) is None


def test_tokens():
    assert name_tokens("The Glörne & Co., N.A. (the “Firm”) *") == ["glorne", "&", "co", "na"]
    assert strip_legal(name_tokens("Glorne and Company LLC")) == ["glorne"]
    assert name_tokens("Renpavale, Edward") == ["edward", "renpavale"]
    assert name_tokens("Mr./Ms. A. D. Zorstoshaw")[-1] == "zorstoshaw"
    assert name_tokens(None) == [] and name_tokens("???") == []


def same(a, b):
    return variants.aligned(variants.words_of_name(a), variants.words_of_name(b))


def test_alignment():
    assert same("Moligard Trust Company plc", "Company, Moligard Trust")
    assert same("Glostuholt Capital Markets plc", "Glosthuolt Cap. Mkts")
    assert same("Drudostead Razaley National Bank", "Drudostead RNB")
    assert same("Alexander Goboquist", "Sandy Goboqiist") and same("A. D. Zorstoshaw", "Alexander Zorstoshaw")
    assert not same("Mupastead National Bank", "Mupastead Securities International")
    assert not same("Alpha Foods", "Omega Foods") and not same("Drudostead", "Drudostead Razaley National Bank")


def test_links(spark):
    a = ["Moligard Trust Company plc", "MOLIGARD TRUST COMPANY", "Mollgard Trust Co", "Moligárd Trust Company LLC", "MoligardTrust", "Moligard", "MTC plc"]
    b = ["Verstiholt Credit Partners AG", "Verstiholt Cr. Part.", "Partners, Verstiholt Credit", "VCP"]
    rows = [("f", n, 1) for n in [*a, *b, *a, "Zogholt Lending Group", "x" * 20_000, "", "???", None]] + [(None, "Moligard", 1), ("g", "Moligard Trust Company", 1)]
    df = spark.createDataFrame(rows, "field string, name string, entity int")
    got = {(r["field"], r["name"]): r["entity"] for r in variants.link_variants(df).collect()}
    assert len({got["f", n] for n in a}) == 1 and len({got["f", n] for n in b}) == 1 and got["f", a[0]] != got["f", b[0]]
    assert got["g", "Moligard Trust Company"] == "Moligard Trust Company" and len(got) == len(a) + len(b) + 5
    pairs = variants.variant_pairs(variants.link_variants(df)).collect()
    assert len(pairs) == len(a) * (len(a) - 1) // 2 + len(b) * (len(b) - 1) // 2 and all(p["name_a"] < p["name_b"] for p in pairs)
    assert variants.link_variants(df.limit(0)).count() == 0


def test_links_against_all_pairs(spark):
    """Names with one typo each: every two names of one base that a scan of all pairs would align are linked."""
    random.seed(6)
    firsts = sorted({"".join(random.sample(["bra", "dol", "gan", "ver", "sti", "mop", "lun", "tek", "fuz", "wix"], 3)) for _ in range(25)})
    base_of = {}
    for f in firsts:
        kind = random.choice(["trust", "securities", "partners"])
        base_of[f"{f} {kind} group"] = base_of[f"{f} {kind} group inc"] = base_of[f"The {f} {kind} group"] = f
        for _ in range(4):
            at = random.randrange(len(f))
            base_of[f"{f[:at]}{random.choice('xyz')}{f[at + 1:]} {kind} group"] = f
    df = spark.createDataFrame([("f", n) for n in base_of], "field string, name string")
    got = {r["name"]: r["entity"] for r in variants.link_variants(df).collect()}
    names = sorted(base_of)
    pairs = [(x, y) for i, x in enumerate(names) for y in names[i + 1 :]]
    wanted = sum(base_of[x] == base_of[y] and same(x, y) for x, y in pairs)
    right = sum(got[x] == got[y] and base_of[x] == base_of[y] for x, y in pairs)
    wrong = sum(got[x] == got[y] and base_of[x] != base_of[y] for x, y in pairs)
    assert right >= 0.97 * wanted and wrong <= 0.03 * right


def test_roles_and_banks(spark):
    roles = spark.createDataFrame([("lead_arranger", "Lead Arranger"), ("joint_lead_arranger", "Joint Lead Arranger"), ("underwriter", "Underwriter"), ("lender", "Lender")], "role_code string, role_label string")
    typed = ["Lead Arranger*", "lead_arranger", "arranger (lead)", "Lead Artanger", "L/A", "JLA", "jt. ld. arr.", "U/W", "under-writer", "Lenders", "Notary", "", None, "Lead Arranger*"]
    got = {r["raw_value"]: r["canonical_id"] for r in canonical.map_roles(spark.createDataFrame([(t,) for t in typed], "role string"), roles).collect()}
    assert got == {
        "Lead Arranger*": "lead_arranger", "lead_arranger": "lead_arranger", "arranger (lead)": "lead_arranger", "Lead Artanger": "lead_arranger", "L/A": "lead_arranger",
        "JLA": "joint_lead_arranger", "jt. ld. arr.": "joint_lead_arranger", "U/W": "underwriter", "under-writer": "underwriter", "Lenders": "lender", "Notary": "UNMATCHED", "": "UNMATCHED",
    }
    banks = spark.createDataFrame([(1, "Moligard Trust Company plc", "Moligard"), (2, "Mupastead National Bank, Inc.", "Mupastead"), (3, "Mupastead Securities International AG", "Mupastead")], "id bigint, name string, short_name string")
    names = spark.createDataFrame([(n, 0) for n in ("Moligard Trst Co", "Mupastead Natl Bk", "Mupastead Secs Int'l", "Mupastead", "Other Trust Company", "MSI AG", "x" * 5000)], "n string, raw_value int")
    entries = canonical.reference_forms(banks, F.col("id"), ["name", "short_name"], canonical.bank_entries)
    for size in (20_000, 3):
        found = canonical.map_to_reference(names, "n", entries, canonical.bank_forms, size)
        assert {r["raw_value"][:30]: r["canonical_id"] for r in found.collect()} == {
            "Moligard Trst Co": "1", "Mupastead Natl Bk": "2", "Mupastead Secs Int'l": "3", "Mupastead": "UNMATCHED", "Other Trust Company": "UNMATCHED", "MSI AG": "3", "x" * 30: "UNMATCHED",
        }
    assert {r["canonical_id"] for r in canonical.map_banks(names, banks.limit(0), "n").collect()} == {"UNMATCHED"}


DEALS = (
    "id bigint, state string, acquirer_cik string, acquirer_name_raw string, target_cik string, target_name_raw string, target_name_normalized string, deal_key string, "
    "announcement_date timestamp_ntz, agreement_date timestamp_ntz, expected_close_date timestamp_ntz, actual_close_date timestamp_ntz, deal_value_usd double, is_sponsor_backed boolean, "
    "sponsor_name_raw string, market_tag string, is_cross_border boolean, created_at timestamp_ntz, updated_at timestamp_ntz, transaction string"
)


def deal(i, state="OPEN", ac=None, an=None, tc=None, tn=None, when=None, agreed=None, value=None, updated=None, key=None):
    return (i, state, ac, an, tc, tn, None, key, when, agreed, None, None, value, None, None, None, None, when, updated, "clash")


def deals_table(spark):
    d = lambda m, n: D(2024, m, n)
    return spark.createDataFrame(
        [
            deal(1, ac="0900", an="Buyer Foods Inc.", tc="077", tn="Zanodrel Water Corp.", when=d(1, 5), value=5.0, updated=d(2, 1)),
            deal(2, ac="900", an=None, tn="Zanodrel Watr", when=d(1, 9), value=5.0, updated=d(2, 2)),
            deal(3, ac="900", tn="ZANODREL WATER", when=None, agreed=d(1, 4), value=6.0),
            deal(4, ac="900", tc="77", tn="Zanodrel Water", when=d(6, 1)),
            deal(5, ac="123", an="Rival Rail", tc="77", tn="Zanodrel Water", when=d(1, 7)),
            deal(6, an=None, tc="77", tn="Zanodrel Water", when=d(6, 2), updated=d(6, 3)),
            deal(7, "LOCKED", ac="5", an="Kobrunet Steel", tc="6", tn="Mintofal Toys", when=d(3, 1)),
            deal(8, ac="5", an="Kobrunet Steel", tc="6", tn="Mintofal Toys", when=d(3, 2), value=1.0, agreed=d(3, 1)),
            deal(8, ac="5", an="Kobrunet Steel", tc="6", tn="Mintofal Toys", when=d(3, 2), value=1.0, agreed=d(3, 1)),
            deal(9),
            deal(10, key="cik:5:cik:6", when=d(3, 4)),
        ],
        DEALS,
    )


def test_transactions_and_survivors(spark):
    deals = deals_table(spark)
    groups: dict[str, set[int]] = {}
    for r in survivors.transaction_groups(deals).collect():
        groups.setdefault(r["transaction"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 6], [5], [7, 8, 10]]
    got = {r["deal_id"]: (r["records"], r["deal_value_usd"]) for r in survivors.surviving_deals(deals).collect()}
    assert got == {1: (3, 5.0), 6: (2, None), 7: (3, 1.0)} or got == {1: (3, 5.0), 4: (2, None), 7: (3, 1.0)}
    assert survivors.surviving_deals(deals.limit(0)).count() == 0


def test_truth_follows_reliable_sources(spark):
    rows = []
    for g in range(40):
        rows += [(g, "good", f"t{g}"), (g, "fine", f"t{g}"), (g, "bad", f"wrong{g}")]
    rows += [(100, "good", "right"), (100, "bad", "false"), (101, None, None), (None, "good", "lost")]
    df = spark.createDataFrame(rows, "g int, s string, v string")
    truth, weights = survivors.discover_truth(df, "g", "s", ["v"])
    won = {r["g"]: r["value"] for r in truth.collect()}
    assert won[100] == "right" and all(won[g] == f"t{g}" for g in range(40)) and 101 not in won
    w = {r["source"]: r["weight"] for r in weights.collect()}
    assert w["good"] > w["bad"]


def test_truth_beats_majority(spark):
    """One careful source against four careless ones that share their usual mistakes."""
    random.seed(11)
    sources = {"careful": 0.97, "a": 0.45, "b": 0.45, "c": 0.4, "d": 0.4}
    rows, right = [], {}
    for g in range(400):
        right[g] = f"v{random.randrange(50)}"
        for s, accuracy in sources.items():
            rows.append((g, s, right[g] if random.random() < accuracy else f"{right[g]}-usual-{random.randrange(2)}"))
    df = spark.createDataFrame(rows, "g int, s string, v string")
    truth, weights = survivors.discover_truth(df, "g", "s", ["v"])
    found = {r["g"]: r["value"] for r in truth.collect()}
    by_truth = sum(found[g] == v for g, v in right.items())
    votes = df.groupBy("g", "v").count().groupBy("g").agg(F.max_by("v", F.struct("count", F.length("v"))).alias("v"))
    by_majority = sum(right[r["g"]] == r["v"] for r in votes.collect())
    w = {r["source"]: r["weight"] for r in weights.collect()}
    assert by_truth >= 0.95 * 400 and by_truth > by_majority + 40 and max(w, key=w.get) == "careful"


def test_one_group_and_days(spark):
    """A group of all records is aggregated, and attempts split only where more than a week lies between."""
    d = D(2024, 1, 1, 23, 0)
    rows = [deal(i, ac="1", tc="2", when=d + dt.timedelta(days=k)) for i, k in enumerate([0, 6.9, 13.8, 20.9, 20.9, 28.5])]
    got: dict[str, set[int]] = {}
    for r in survivors.transaction_groups(spark.createDataFrame(rows, DEALS)).collect():
        got.setdefault(r["transaction"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [[0, 1, 2], [3, 4], [5]]


def test_truth_places_open_records(spark, tmp_path):
    """Rival bids and attempts that fit a record alike: the one whose values it shares takes it, also in p1_found."""
    d = lambda m, n: D(2024, m, n)
    rows = [
        deal(1, ac="900", tc="77", tn="Zanodrel Water", when=d(1, 5), value=5.0),
        deal(2, ac="123", tc="77", tn="Zanodrel Water", when=d(1, 7), agreed=d(1, 6), value=9.0),
        deal(3, tc="77", tn="Zanodrel Water", when=d(1, 6), value=9.0),
        deal(4, tc="77", tn="Zanodrel Water", when=d(1, 6), value=7.0),
        deal(11, ac="1", tc="2", tn="Mintofal Toys", when=d(1, 1), value=5.0),
        deal(12, ac="1", tc="2", tn="Mintofal Toys", when=d(6, 1), value=6.0),
        deal(13, ac="1", tc="2", tn="Mintofal Toys", value=6.0),
        deal(14, ac="1", tc="2", tn="Mintofal Toys", agreed=d(1, 2), value=6.0),
    ]
    deals = spark.createDataFrame(rows, DEALS)
    groups: dict[str, set[int]] = {}
    for r in survivors.transaction_groups(deals).collect():
        groups.setdefault(r["transaction"], set()).add(r["id"])
    assert sorted(map(sorted, groups.values())) == [[1], [2, 3], [11, 14], [12, 13]]
    deals.write.parquet(str(tmp_path / "deals.parquet"))
    assert {r["deal_id"] for r in queries.p1_found(spark, str(tmp_path)).collect()} == {2, 11, 12}
