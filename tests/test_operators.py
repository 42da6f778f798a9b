from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dealweave.functions.fuzzy import NearIndex, near_in_texts, partial_ratio, partial_ratio_above, ratio, similar_pairs
from dealweave.operators import cluster, facts, reconcile, resolve, tables
from dealweave.operators.graph import connected_components
from dealweave.operators.orphans import advance, open_state, orphan_counts, orphan_rows, parents_from, references_from
from dealweave.plans import api
from dealweave.sources import edgar, files
from dealweave.streaming.orphan_ledger import OrphanLedger, run_ledger
from dealweave.streaming import windows

D = dt.datetime


def refs(spark, rows):
    return spark.createDataFrame(rows, "record_table string, record_id bigint, parent_table string, missing_id bigint, referred_at timestamp_ntz")


def parents(spark, rows):
    return spark.createDataFrame([(*r, r[2] is None) for r in rows], "parent_table string, parent_id bigint, arrived_at timestamp_ntz, dateless boolean")


def test_orphans_open_resolve_and_reopen(spark):
    day = lambda n: D(2024, 1, n)
    state = open_state(
        refs(spark, [("f", 1, "d", 10, day(5)), ("f", 2, "d", 11, day(5)), ("f", 3, "d", 12, day(5)), ("f", 4, "d", 13, None)]),
        parents(spark, [("d", 10, day(1)), ("d", 11, day(9)), ("d", 13, None)]),
    )
    assert {(r["record_id"], r["missing_id"]) for r in orphan_rows(state).collect()} == {(2, 11), (3, 12)}
    later = advance(state, parents=parents(spark, [("d", 12, day(20))]))
    assert {r["record_id"]: r["resolved_at"] for r in later.orphans.collect()} == {2: day(9), 3: day(20)}
    gone = advance(later, deleted=spark.createDataFrame([("d", 10), ("d", 10)], "parent_table string, parent_id bigint"))
    assert {r["record_id"] for r in gone.orphans.filter("resolved_at is null").collect()} == {1}
    more = advance(gone, references=refs(spark, [("f", 1, "d", 10, day(5)), ("f", 9, "d", 11, day(30))]))
    assert {r["record_id"] for r in more.orphans.collect()} == {1, 2, 3}
    counts = orphan_counts(more).collect()
    assert sum(r["orphans"] for r in counts) == 3 and sum(r["late"] for r in counts) == 2
    # A parent older than the reference settles it even if it is delivered later; so does one without a date.
    state = open_state(refs(spark, [("f", 1, "d", 1, day(5)), ("f", 2, "d", 2, day(5)), ("f", 3, "d", 3, day(5))]), parents(spark, []))
    came = parents(spark, [("d", 1, day(3)), ("d", 2, None), ("d", 3, day(9)), ("d", 3, day(7)), ("d", 3, day(7))])
    assert [(r["record_id"], r["resolved_at"]) for r in advance(state, parents=came).orphans.collect()] == [(3, day(7))]


def random_changes(rng):
    """Changes of one history: few records and keys, so that most meet; later ones may repeal earlier ones."""
    day = lambda: None if rng.random() < 0.15 else D(2024, 1, rng.randint(1, 9))
    out = []
    for _ in range(rng.randint(5, 40)):
        kind = rng.choice(["reference"] * 4 + ["parent"] * 3 + ["delete", "withdraw"])
        record, table, at = rng.randint(1, 6), rng.choice("de"), day()
        missing = rng.randint(1, 5)
        out.append((kind, "f" if kind in ("reference", "withdraw") else None, record if kind in ("reference", "withdraw") else None, table, missing, at if kind in ("reference", "parent") else None))
    return out


def in_batches(rng, changes, most):
    """Contiguous batches; inside one, withdrawals and deletions take effect before arrivals and references."""
    cuts = sorted(rng.randint(0, len(changes)) for _ in range(most - 1))
    return [changes[i:j] for i, j in zip([0, *cuts], [*cuts, len(changes)])]


def still_live(batches):
    references, index = set(), {}
    for batch in batches:
        for kind, *row, _ in batch:
            if kind == "withdraw":
                references = {r for r in references if r[:4] != tuple(row)}
            elif kind == "delete":
                index.pop(tuple(row[2:]), None)
        for kind, t, r, table, missing, at in batch:
            if kind == "reference":
                references.add((t, r, table, missing, at))
            elif kind == "parent":
                index.setdefault((table, missing), []).append(at)
    return references, index


def expected_orphans(references, index):
    out = set()
    for ref in references:
        dates = index.get(ref[2:4])
        if dates is None:
            out.add((*ref, None))
        elif None not in dates and ref[4] is not None and min(dates) > ref[4]:
            out.add((*ref, min(dates)))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_state_and_ledger_equal_one_batch(spark, tmp_path, seed):
    """Any cut of a history into batches ends in the state that what is still live gives at once."""
    rng = random.Random(seed)
    batches = in_batches(rng, random_changes(rng), 4)
    schema = "kind string, record_table string, record_id bigint, parent_table string, missing_id bigint, at timestamp_ntz"
    ledger = OrphanLedger(spark, str(tmp_path / "state"), buckets=4)
    state = None
    for k, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema)
        of = lambda kind: [c[1:] for c in batch if c[0] == kind]  # noqa: B023, E731
        r, p = refs(spark, of("reference")), parents(spark, [c[2:] for c in of("parent")])
        if state is None:
            state = open_state(r, p)
        else:
            gone = spark.createDataFrame([c[2:4] for c in of("delete")], "parent_table string, parent_id bigint")
            past = spark.createDataFrame([c[:4] for c in of("withdraw")], "record_table string, record_id bigint, parent_table string, missing_id bigint")
            state = advance(state, r, p, gone, past)
        after = ledger.apply(k, df)
        if k == len(batches) - 1:
            wanted = expected_orphans(*still_live(batches))
            assert {tuple(x) for x in state.orphans.collect()} == wanted
            assert {tuple(x) for x in after.orphans.collect()} == wanted and after.orphans.count() == len(wanted)


def test_orphans_nulls_repeats_empty_and_clashing_columns(spark):
    table = spark.createDataFrame([(1, [5, 5, None], D(2024, 1, 1), "x"), (2, None, None, "y"), (3, [], None, "z")], "id bigint, ids array<bigint>, updated_at timestamp_ntz, missing_id string")
    r = references_from(table, "e", "id", "f", "ids", "updated_at", is_array=True)
    p = parents_from(spark.createDataFrame([], "id bigint, created_at timestamp_ntz, parent_id string"), "f", "id", "created_at")
    assert [tuple(x) for x in orphan_rows(open_state(r, p)).collect()] == [("e", 1, 5)]
    empty = open_state(r.limit(0), p)
    assert orphan_counts(empty).count() == 0


def test_ledger_streams_in_batches(spark, tmp_path):
    rows = [
        [("reference", "f", 1, "d", 10, D(2024, 1, 5)), ("parent", None, None, "d", 11, D(2024, 1, 9)), ("reference", "f", 2, "d", 11, D(2024, 1, 5)), ("reference", "f", 3, "d", 10, None), ("delete", None, None, "d", 99, None)],
        [("parent", None, None, "d", 10, D(2024, 1, 3)), ("odd", None, None, "d", 10, None)],
        [("delete", None, None, "d", 11, None), ("reference", "f", 4, "d", None, None)],
    ]
    schema = "kind string, record_table string, record_id bigint, parent_table string, missing_id bigint, at timestamp_ntz"
    ledger, stream = OrphanLedger(spark, str(tmp_path / "state"), buckets=8), spark.readStream.schema(schema)
    wanted = [{(1, None), (2, D(2024, 1, 9)), (3, None)}, {(2, D(2024, 1, 9))}, {(2, None)}]
    for k, batch in enumerate(rows):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_ledger(stream.parquet(str(tmp_path / "in")), ledger, str(tmp_path / "cp")).awaitTermination(120)
        assert {(r["record_id"], r["resolved_at"]) for r in ledger.load(k).orphans.collect()} == wanted[k]
    # A replayed batch changes nothing, a gap raises, versions two back are gone, the buckets they share stay.
    assert ledger.apply(2, spark.createDataFrame(rows[0], schema)).orphans.count() == 1
    with pytest.raises(ValueError):
        ledger.apply(7, spark.createDataFrame(rows[0], schema))
    assert ledger.load(0) is None and ledger.load(1).orphans.count() == 1
    assert spark.read.parquet(str(tmp_path / "state" / "snapshots")).groupBy("batch").agg(F.sum("orphans").alias("n")).filter("n is not null").count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=12))
def test_components_equal_union_find(spark, edges):
    top = list(range(10))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    nodes = spark.createDataFrame([(i,) for i in range(10)] + [(None,), (3,)], "node bigint")
    e = spark.createDataFrame([*edges, (None, 1)], "src bigint, dst bigint")
    got = {r["node"]: r["component"] for r in connected_components(nodes, e).collect()}
    assert got == {i: find(i) for i in range(10)}


PARTY = "struct<party_name_raw:string,party_name_normalized:string,role_label:string,cik:string>"


def test_cluster_against_loop(spark):
    rows = [(1, None, 7, ("A", "a", "Parent", None)), (2, None, 7, ("T", "t", "Company", None)), (3, None, 7, ("B", "b", "Buyer", "9")), (4, 5, 7, ("U", "u", "Target", None)), (5, None, 8, ("Z", "z", "Notary", None))]
    f = spark.createDataFrame(rows, f"id bigint, exhibit_id bigint, filing_id bigint, party {PARTY}")
    assert {r["fact_id"]: r["deal_key"] for r in cluster.cluster_parties(f).collect()} == {1: "name:a:name:t", 2: "name:a:name:t", 3: "cik:9:name:t"}


def test_sponsor_fold_against_loop(spark):
    rows = [(1, 1, 0.6, "X", "x"), (2, 1, 0.9, "KKR", "kkr"), (3, 1, 0.9, "Y", "y"), (4, 2, None, "Z", None)]
    f = spark.createDataFrame([(i, d, c, (r, n, None, False)) for i, d, c, r, n in rows], "id bigint, deal_id bigint, confidence double, sponsor struct<sponsor_name_raw:string,sponsor_name_normalized:string,source_pattern:string,is_negated:boolean>")
    got = {r["deal_id"]: (r["sponsor_name_raw"], r["unresolved"]) for r in cluster.fold_sponsors(f).collect()}
    assert got == {1: ("KKR", True), 2: ("Z", True)}


def test_merge_deals_and_candidates(spark):
    deals = spark.createDataFrame([(1, "k1", "alpha foods holdings"), (2, "k2", "alpha food holdings"), (3, "k3", "omega rail"), (4, "k4", None)], "id bigint, deal_key string, target_name_normalized string")
    assert [(r["deal_a"], r["deal_b"]) for r in cluster.merge_candidates(deals).collect()] == [(1, 2)]
    facts = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id bigint, deal_id bigint")
    events = spark.createDataFrame([(7, 2, "x"), (8, 3, "y")], "id bigint, deal_id bigint, target_id string")
    moved, put, left, alerts = cluster.merge_deals(facts, events, deals, spark.createDataFrame([(2, 1, "same"), (2, 1, "same")], "source_id bigint, target_id bigint, reason string"))
    assert {r["id"]: r["deal_id"] for r in moved.collect()} == {1: 1, 2: 1, 3: None}
    assert {r["id"]: r["deal_id"] for r in put.select("id", "deal_id").collect()} == {7: 1, 8: 3}
    assert {r["id"] for r in left.collect()} == {1, 3, 4}
    assert [(r["deal_id"], r["merged_deal_id"], r["description"], r["is_resolved"]) for r in alerts.collect()] == [(1, 2, "same", True)]


def test_matching(spark):
    fin = "struct<instrument_type:string,amount_usd:double,amount_raw:string,currency:string,participants:array<struct<bank:string,role:string>>>"
    facts = spark.createDataFrame(
        [(1, None, "Notes to fund the purchase of Alpha Foods by Big Buyer.", ("bond", 1.0, "$1", None, [("X, N.A.", "Lead Arranger")])), (2, 9, "linked", ("bond", 2.0, "$2", "EUR", None)), (3, None, "nothing", ("bond", 3.0, None, None, None))],
        f"id bigint, deal_id bigint, evidence_snippet string, financing {fin}",
    )
    columns = "id bigint, state string, target_name_normalized string, acquirer_name_normalized string, sponsor_name_raw string"
    deals = spark.createDataFrame([(5, "OPEN", "alpha foods", "big buyer", None), (6, "OPEN", "alpha foods", "other", "Fund LP"), (7, "OPEN", "foods", None, None), (4, "LOCKED", "alpha foods", "big buyer", None)], columns)
    got = [(r["fact_id"], r["deal_id"], r["confidence"]) for r in reconcile.match_unlinked(facts, deals).collect()]
    assert got == [(1, 5, pytest.approx(0.8))]
    assert [r["deal_id"] for r in reconcile.match_unlinked(facts, deals, states=None).collect()] == [4]
    assert reconcile.match_unlinked(facts, deals.limit(0)).count() == 0 and reconcile.match_unlinked(facts.limit(0), deals).count() == 0
    with pytest.raises(ValueError):
        reconcile.match_unlinked(facts, deals, 0.4)
    events = spark.createDataFrame([([2, None],), (None,)], "source_fact_ids array<bigint>")
    assert reconcile.unrecorded_links(facts, events).count() == 0
    assert [(r["bank_name_normalized"], r["role_normalized"]) for r in reconcile.event_participants(facts).collect()] == [("x", "lead_arranger")]


def score(deal, evidence):
    """Confidence of one deal by the stated weights, all names against the whole evidence."""
    total = 0.0
    for side, name in zip(("target", "acquirer", "sponsor"), deal[2:]):
        full, part, above = reconcile.SIDES[side]
        if name:
            name = name.lower()
            near = partial_ratio(name, evidence)
            total += full if name in evidence else part * near / 100 if near > above else 0.0
    return min(total, 1.0)


def test_matching_equals_all_pairs(spark):
    """Named, misspelt and glued names, names longer than the evidence, ties: as if every fact met every deal."""
    rng = random.Random(12)
    words = ["northwind", "halden", "omega", "steel", "foods", "rail", "capital", "partners", "group", "verstol", "kibrun", "tessamo"]
    name = lambda k: " ".join(rng.sample(words, k))
    deals = [(i, "OPEN", name(rng.randint(1, 3)), name(2), rng.choice([None, name(2).title(), "", "x"])) for i in range(40)]

    def typo(text):
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(["", "q", "zz", " "]) + text[at + rng.randint(0, 1) :]
        return text

    evidences = [f"{'lead in ' * rng.randint(0, 8)}{typo(d[2])} bought by {typo(d[3])}{' ' + typo(d[4] or 'nobody')}{' and more' * rng.randint(0, 9)}" for d in deals for _ in range(2)]
    evidences += ["om", "", "steel", "Northwin", typo(deals[0][2])]
    fin = "struct<instrument_type:string>"
    facts = spark.createDataFrame([(i, None, e, ("bond",)) for i, e in enumerate(evidences)] + [(900, None, None, ("bond",))], f"id bigint, deal_id bigint, evidence_snippet string, financing {fin}")
    table = spark.createDataFrame(deals, "id bigint, state string, target_name_normalized string, acquirer_name_normalized string, sponsor_name_raw string")
    want = {}
    for i, e in enumerate(evidences):
        best = max(((round(score(d, e.lower()), 9), -d[0]) for d in deals), default=(0, 0))
        if best[0] >= 0.5:
            want[i] = (-best[1], best[0])
    got = {r["fact_id"]: (r["deal_id"], round(r["confidence"], 9)) for r in reconcile.match_unlinked(facts, table).collect()}
    assert len(want) > 50 and got == want
    texts, names = facts.select(F.lower("evidence_snippet").alias("e")).filter("e is not null").distinct(), table.select(F.col("target_name_normalized").alias("name"), F.lit(True).alias("target")).distinct()
    whole = {tuple(r) for r in reconcile.names_in_texts(texts, names, 85.0).collect()}
    assert whole == {tuple(r) for r in reconcile.names_in_texts(texts, names, 85.0, block_chars=60).collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc ", max_size=12), max_size=8), st.lists(st.text("abc ", max_size=40), max_size=5), st.sampled_from([60.0, 80.0, 85.0, 92.0]))
def test_bigram_bounds_lose_nothing(names, texts, least):
    got = {(i, j): r for i, j, r in near_in_texts(names, texts, least)}
    assert got == {(i, j): partial_ratio(n, t) for i, n in enumerate(names) for j, t in enumerate(texts) if len(n) > 2 and t and partial_ratio(n, t) > least}
    for n in names:
        for t in texts:
            r = partial_ratio(n, t)
            assert partial_ratio_above(n, t, least) == (r if r > least and n and t else 0.0)
    pairs = {(i, j) for i, j, _ in similar_pairs(names, texts, least)}
    assert pairs == {(i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if ratio(n, t) >= least and (n or t)} | {(i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if not n and not t}


def test_name_pieces_spare_most_pairs():
    """Names and texts meet by pieces of the names: few of all pairs are left to compare, and no near one is lost."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("bcdfgklmnprstvz") + rng.choice("aeiou") for _ in range(4))
    names = [f"{word()} {word()}" for _ in range(300)]
    texts = []
    for name in names[:60]:
        at = rng.randrange(len(name))
        texts.append(f"notes for {name[:at]}q{name[at + 1 :]} due {word()}")
    one, two = NearIndex(names, 85.0).candidates(texts)
    pairs = set(zip(one.tolist(), two.tolist()))
    assert len(pairs) == len(one) < len(names) * len(texts) / 10
    near = {(i, j) for i, n in enumerate(names) for j, t in enumerate(texts) if partial_ratio_above(n, t, 85.0)}
    assert {(j, j) for j in range(60)} <= near <= pairs and {(i, j) for i, j, _ in near_in_texts(names, texts, 85.0)} == near


def test_assigned_deals(spark):
    party = "struct<party_name_raw:string,party_name_normalized:string,role_label:string,cik:string>"
    row = lambda i, ex, role, name, cik=None, deal=None: (i, ex, 1, deal, (name, name, role, cik))
    rows = [
        row(1, 10, "Company", "t1"), row(2, 10, "Parent", "a1"), row(3, 10, "Buyer", "a2"),  # new deal a1/t1; a2 makes another key
        row(4, 11, "Target", "t2", "2"), row(5, 11, "Parent", "b", "1"),  # attached to deal 50
        row(6, 12, "Company", "t3"), row(7, 12, "Parent", "c"),  # deal 51 is locked
        row(8, 13, "Company", "alone"), row(9, 14, "Parent", "alone"), row(10, 15, "Company", "t1", None, 7), (11, 16, 1, None, None),
    ]
    f = spark.createDataFrame(rows, f"id bigint, exhibit_id bigint, filing_id bigint, deal_id bigint, party {party}")
    d = spark.createDataFrame([(51, "name:c:name:t3", "LOCKED"), (50, "cik:1:cik:2", "OPEN"), (52, "cik:1:cik:2", "LOCKED"), (53, None, "OPEN")], "id bigint, deal_key string, state string")
    got = cluster.assign_deals(f, d)
    assert {r["fact_id"]: (r["deal_id"], r["action"]) for r in got.collect()} == {
        1: (None, "created"), 2: (None, "attached"), 3: (None, "waiting"), 4: (50, "attached"), 5: (50, "attached"), 6: (None, "locked"), 7: (None, "locked"),
    }
    assert [tuple(r) for r in cluster.created_deals(got, f).collect()] == [("name:a1:name:t1", "t1", None, 1)]
    assert {r["action"]: (r["facts"], r["deals"]) for r in cluster.assignment_counts(got).collect()} == {"created": (1, 1), "attached": (3, 2), "waiting": (1, 1), "locked": (2, 1)}
    assert cluster.assign_deals(f.limit(0), d).count() == 0 and cluster.assign_deals(f, d.limit(0)).filter("action = 'created'").count() == 3


def test_links_and_seeds(spark):
    resolved = spark.createDataFrame([("A Bank", 3), ("New One, Inc.", None), ("new one inc", None), ("???", None), ("", None)], "raw string, bank_id bigint")
    got = {r["raw"]: r["bank_key"] for r in resolve.link_banks(resolved).collect()}
    assert got["A Bank"] == "3" and got["New One, Inc."] == got["new one inc"] == "new:new one" and got[""] is None
    banks = spark.createDataFrame([(1, "A. Bank, Inc", "A")], "id bigint, name string, short_name string")
    seeds = spark.createDataFrame([("a bank inc", None), ("B Bank", "B"), ("b bank\u00a0", None), (None, "x")], "name string, short_name string")
    fresh = resolve.seed_banks(banks, seeds)
    assert [tuple(r) for r in fresh.collect()] == [("B Bank", "B", "b bank")]
    assert resolve.seed_banks(banks.unionByName(fresh.select(F.lit(2).cast("bigint").alias("id"), "name", "short_name")), seeds).count() == 0


def test_item_sections_and_pdf(spark):
    one = "Item 1.01 Entry into a Material Definitive Agreement\nWe did. See item 5.02 too.\nItem 9.01 Exhibits"
    df = spark.createDataFrame([(1, one), (2, one.split("Item 9.01")[0]), (3, "Item 8.01 Other"), (4, None)], "id bigint, t string")
    got = {r["id"]: r["s"] for r in df.select("id", facts.item_section(F.col("t")).alias("s")).collect()}
    assert got == {1: one.split("Item 9.01")[0], 2: one.split("Item 9.01")[0], 3: None, 4: None}
    pdf = spark.createDataFrame([(1, True, True, "w " * 60), (2, True, True, "w"), (3, True, False, None), (4, False, True, "w")], "id bigint, is_pdf boolean, is_material boolean, visual_text string")
    assert {r["id"]: r["outcome"] for r in facts.pdf_outcomes(pdf).collect()} == {1: "processed", 2: "alert", 3: "skipped"}
    docs = spark.createDataFrame([(1, "A Term Loan of $5 million and $2 billion notes"), (2, "notes"), (3, ""), (4, "plain")], "id bigint, t string")
    assert {r["id"]: tuple(r)[1:] for r in facts.pdf_financing(docs, "id", "t").collect()} == {1: ("term_loan", 2, 2e9), 2: ("bond", 0, None), 4: (None, 0, None)}
    labels = spark.createDataFrame([(1, 'by Alpha, Beta Inc (the "Parent") and x ("Unheard"); Gamma (the "Company")'), (2, None)], "id bigint, t string")
    assert sorted((r["party"], r["label"], r["role"]) for r in facts.labelled_parties(labels, "id", "t").collect()) == [("Beta Inc", "Parent", "acquirer"), ("Gamma", "Company", "target")]


def test_plain_bank_rows(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "Alpha Bank", False), (1, 0, 0, 1, "Beta Securities", False), (1, 0, 0, 2, "Arranger", False), (1, 0, 1, 0, "Gamma Capital", False), (1, 0, 2, 0, "Total", False), (1, 0, 2, 1, "", False)], "key bigint, table_no int, row_no int, col_no int, text string, is_header boolean")
    assert sorted((r["bank"], r["role"]) for r in tables.plain_bank_rows(cells).collect()) == [("Beta Securities", "Arranger"), ("Gamma Capital", "unknown")]


def test_search_and_inputs(spark):
    deals = spark.createDataFrame([(1, "A_B Corp", "Shown 50%", "t", "S"), (2, "AXB Corp", None, "t", None), (3, None, None, None, None)], "id bigint, acquirer_name_raw string, target_name_display string, target_name_raw string, sponsor_name_raw string").withColumn("state", F.lit("OPEN"))
    assert [r["id"] for r in api.search(deals, "a_b").collect()] == [1, 2] and [r["id"] for r in api.search(deals, "shown").collect()] == [1]
    alerts = spark.createDataFrame([(1, False, None), (2, False, None)], "id bigint, is_resolved boolean, resolved_at timestamp_ntz")
    inputs = spark.createDataFrame([(1, "f", "v", "me", D(2024, 1, 1)), (1, "g", "v", "you", D(2024, 1, 2)), (9, "f", "v", "me", D(2024, 1, 1))], "alert_id bigint, field_name string, value string, entered_by string, entered_at timestamp_ntz")
    kept, after = api.manual_inputs(alerts, inputs)
    assert kept.count() == 2 and {r["id"]: (r["is_resolved"], r["resolved_by"]) for r in after.collect()} == {1: (True, "you"), 2: (False, None)}


def test_resolution(spark):
    banks = spark.createDataFrame([(1, "Alpha Trust Holdings LLC")], "id bigint, name string")
    aliases = spark.createDataFrame([(1, "AT Group"), (None, "Nobody")], "bank_id bigint, alias string")
    names = spark.createDataFrame([("Alpha Trust Holdings",), ("at group",), ("Alpha Trast Holdings",), ("Zeta",), (None,), ("Zeta",)], "n string")
    got = {r["raw"]: (r["bank_id"], r["method"]) for r in resolve.resolve_banks(names, "n", banks, aliases, block=1).collect()}
    assert got == {"Alpha Trust Holdings": (1, "exact"), "at group": (1, "alias"), "Alpha Trast Holdings": (1, "similar"), "Zeta": (None, None)}
    assert [r["name"] for r in resolve.unlisted_banks(resolve.resolve_exact(names, "n", banks, aliases)).orderBy("name").collect()] == ["Alpha Trast Holdings", "Zeta"]


def test_lists_and_alerts(spark):
    with pytest.raises(ValueError):
        api.list_deals(spark.range(1), limit=0)
    alerts = spark.createDataFrame([(1, "A", None, False, None), (2, "B", None, None, None)], "id bigint, alert_type string, created_at timestamp_ntz, is_resolved boolean, resolved_at timestamp_ntz")
    decisions = spark.createDataFrame([(1, "me", D(2024, 1, 1), "done"), (1, "you", D(2024, 1, 2), None)], "alert_id bigint, resolved_by string, resolved_at timestamp_ntz, resolution_notes string")
    got = {r["id"]: (r["is_resolved"], r["resolved_by"]) for r in api.resolve_alerts(alerts, decisions).collect()}
    assert got == {1: (True, "you"), 2: (None, None)}
    assert {r["measure"]: r["n"] for r in api.alert_stats(alerts).collect()} == {"total": 2, "unresolved": 1, "type:A": 1}


def test_fetcher():
    now, asked, pauses = [0.0], [], []

    def sleep(s):
        pauses.append(s)
        now[0] += s

    answers = iter([(429, ""), (200, "one"), (403, "")])

    def get(url):
        asked.append(url)
        return next(answers)

    f = edgar.Fetcher(get, "http://site", clock=lambda: now[0], sleep=sleep)
    assert f.fetch("a") == "one" and f.fetch("/a") == "one" and asked == ["http://site/a"] * 2 and pauses == [2]
    now[0] += 3601
    with pytest.raises(edgar.BlockedError):
        f.fetch("a")
    limiter = edgar.RateLimiter(2, 1.0, lambda: now[0], sleep)
    for _ in range(5):
        limiter.wait()
    assert sum(pauses[1:]) == pytest.approx(2.0)


def test_sources(spark, tmp_path):
    page = '<table><tr><td>1</td><td>EX-2.1 AGREEMENT</td><td><a href="/x.htm">x.htm</a></td></tr><tr><td>2</td><td>cover</td><td><a href="/c">c</a></td></tr></table>'
    got = edgar.scan_indexes(spark.createDataFrame([(1, page), (2, None)], "id bigint, m string"), "id", "m").collect()
    assert [(r["exhibit_type"], r["url"], r["is_pdf"]) for r in got] == [("EX-2.1", "/x.htm", False)]
    (tmp_path / "s.txt").write_text("ACCESSION NUMBER: 1-2\nCONFORMED SUBMISSION TYPE: 8-K\n<DOCUMENT>\n<TYPE>8-K\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>\nbody\n</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99.1\n<SEQUENCE>2\n<TEXT>two</TEXT>\n</DOCUMENT>")
    docs = files.read_submissions(spark, str(tmp_path / "s.txt")).orderBy("sequence").collect()
    assert [(d["accession_number"], d["doc_type"], d["text"]) for d in docs] == [("1-2", "8-K", "body"), ("1-2", "EX-99.1", "two")]
    (tmp_path / "seed.json").write_text(json.dumps({"seed_deals": [{"name": "n", "acquirer": {"cik": "1"}}]}))
    assert files.read_seed_deals(spark, str(tmp_path / "seed.json")).first()["name"] == "n"
    (tmp_path / "list.json").write_text(json.dumps({"cik": "1", "filings": {"recent": {"accessionNumber": ["a", "b"], "form": ["8-K", "10-K"], "filingDate": ["2024-01-01", "2024-01-02"], "primaryDocument": ["x", "y"], "primaryDocDescription": ["", ""]}}}))
    assert [r["accessionNumber"] for r in edgar.filing_list(spark, str(tmp_path / "list.json"), start="2023-01-01", end="2024-12-31").collect()] == ["a"]
    with pytest.raises(ValueError):
        files.Settings("x", "not an address")
    (tmp_path / "c.json").write_text("{}")
    with pytest.raises(ValueError):
        files.load_config(str(tmp_path / "c.json"), ("needed",))
    files.write_layer(spark.range(3).withColumn("p", F.lit(1)), str(tmp_path / "layer"), ["p"])
    assert spark.read.parquet(str(tmp_path / "layer")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, D(2024, 1, 1, i % 5, 7 * i % 60), i % 2) for i in range(40)] + [(0, D(2024, 1, 1, 0, 0), 0)]
    spark.createDataFrame(rows, "id bigint, ts timestamp_ntz, k bigint").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = windows.tumbling_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "k")
    stream = windows.tumbling_counts(spark.readStream.schema("id bigint, ts timestamp_ntz, k bigint").parquet(str(tmp_path / "in")), "ts", "k")
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, batch.collect()))
    first = windows.first_arrivals(spark.readStream.schema("id bigint, ts timestamp_ntz, k bigint").parquet(str(tmp_path / "in")), "ts", "id")
    q = first.writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 40
    assert windows.session_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "k").agg(F.sum("n")).first()[0] == 41
