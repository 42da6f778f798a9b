"""Grouping of party facts into deals by keys, as joins and ordered folds instead of row loops."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.functions import patterns as P
from dealweave.functions.fuzzy import similar_pairs


def scope_of(exhibit: Column, filing: Column) -> Column:
    """Facts belong together by exhibit if they have one, else by filing."""
    return F.when(exhibit.isNotNull(), F.concat(F.lit("e"), exhibit.cast("string"))).otherwise(F.concat(F.lit("f"), filing.cast("string")))


def deal_key(a_cik: Column, a_name: Column, t_cik: Column, t_name: Column) -> Column:
    """cik:cik, else cik:name, else name:name; null if a side is missing. Empty strings are missing."""
    ac, an, tc, tn = (F.nullif(c, F.lit("")) for c in (a_cik, a_name, t_cik, t_name))
    return F.coalesce(
        F.concat(F.lit("cik:"), ac, F.lit(":cik:"), tc),
        F.concat(F.lit("cik:"), ac, F.lit(":name:"), tn),
        F.concat(F.lit("name:"), an, F.lit(":name:"), tn),
    )


def party_roles(facts: DataFrame) -> DataFrame:
    """(id, scope, side, name, cik) of facts with a party whose role label names a side."""
    role = F.lower(F.col("party.role_label"))
    side = F.when(role.isin(*P.TARGET_ROLES), "target").when(role.isin(*P.ACQUIRER_ROLES), "acquirer")
    return facts.filter(F.col("party").isNotNull()).select(
        "id",
        scope_of(F.col("exhibit_id"), F.col("filing_id")).alias("scope"),
        side.alias("side"),
        F.col("party.party_name_normalized").alias("name"),
        F.col("party.cik").alias("cik"),
    ).filter("side is not null")


def cluster_parties(facts: DataFrame) -> DataFrame:
    """(fact_id, deal_key) of party facts.

    A target takes the first acquirer of its scope (by id) to make its key, an
    acquirer the first target; a side without the other stays out.
    """
    p = party_roles(facts)
    firsts = p.groupBy("scope", "side").agg(F.min_by(F.struct("name", "cik"), "id").alias("first"))
    t, a = p.filter("side = 'target'"), p.filter("side = 'acquirer'")
    fa = firsts.filter("side = 'acquirer'").select("scope", "first")
    ft = firsts.filter("side = 'target'").select("scope", "first")
    one = t.join(fa, "scope").select("id", deal_key(F.col("first.cik"), F.col("first.name"), F.col("cik"), F.col("name")).alias("deal_key"))
    two = a.join(ft, "scope").select("id", deal_key(F.col("cik"), F.col("name"), F.col("first.cik"), F.col("first.name")).alias("deal_key"))
    return one.unionByName(two).filter("deal_key is not null").withColumnRenamed("id", "fact_id")


def attach_secondary(facts: DataFrame) -> DataFrame:
    """(fact_id, deal_id): facts without party and deal take the smallest deal of the party facts in their scope."""
    scope = scope_of(F.col("exhibit_id"), F.col("filing_id")).alias("scope")
    owners = facts.filter("party is not null and deal_id is not null").select(scope, "deal_id").groupBy("scope").agg(F.min("deal_id").alias("deal_id"))
    loose = facts.filter("party is null and deal_id is null").select(F.col("id").alias("fact_id"), scope)
    return loose.join(owners, "scope").select("fact_id", "deal_id")


def fold_sponsors(facts: DataFrame) -> DataFrame:
    """(deal_id, sponsor_name_raw, sponsor_confidence, unresolved): the most confident mention, the earliest among equals.

    ``unresolved`` tells whether any mention that was applied on the way - one more
    confident than all before it - is of a name outside the known list.
    """
    s = facts.filter("deal_id is not null and sponsor is not null and not coalesce(sponsor.is_negated, false)").select(
        "deal_id", "id", F.col("sponsor.sponsor_name_raw").alias("raw"), F.coalesce("confidence", F.lit(0.0)).alias("conf"), F.lower(F.col("sponsor.sponsor_name_normalized")).alias("norm")
    )
    # A mention is applied if no earlier one is as confident.  Only the first of each confidence can be, so one row for
    # each confidence is enough, and it is applied if all that are more confident come later.
    first = s.groupBy("deal_id", "conf").agg(F.min("id").alias("id"), F.min_by(F.struct("raw", "norm"), "id").alias("m"))
    later = F.min("id").over(Window.partitionBy("deal_id").orderBy(F.desc("conf")).rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("applied", later.isNull() | (F.col("id") < later))
    unknown = F.col("applied") & ~F.coalesce(F.col("m.norm").isin(*P.SPONSORS), F.lit(False))
    return first.groupBy("deal_id").agg(
        F.max_by("m.raw", "conf").alias("sponsor_name_raw"), F.max("conf").alias("sponsor_confidence"), F.bool_or(unknown).alias("unresolved")
    )


def fold_dates(facts: DataFrame) -> DataFrame:
    """(deal_id, date_type, date_value): the first valid date of each type."""
    d = facts.filter("deal_id is not null and deal_date is not null").select("deal_id", "id", F.col("deal_date.date_type").alias("date_type"), F.try_to_date(F.substring("deal_date.date_value", 1, 10), "yyyy-MM-dd").alias("d"))
    return d.filter("d is not null and date_type is not null").groupBy("deal_id", "date_type").agg(F.min_by("d", "id").alias("date_value"))


def assign_deals(facts: DataFrame, deals: DataFrame) -> DataFrame:
    """(fact_id, side, deal_key, deal_id, action) of party facts without a deal.

    A target whose key no deal has creates one, else it is attached to it, or
    held back (``locked``) if that deal is LOCKED.  An acquirer goes where the
    target of its key goes, or to an existing deal that is not LOCKED; it never
    creates one (``waiting``).  Of several deals with one key the smallest id
    counts.  ``deal_id`` is null for deals still to be created.
    """
    loose = facts.filter("deal_id is null")
    keyed = cluster_parties(loose).join(party_roles(loose).select(F.col("id").alias("fact_id"), "side"), "fact_id")
    held = deals.filter("deal_key is not null").groupBy("deal_key").agg(F.min("id").alias("deal_id"), F.min_by("state", "id").alias("state"))
    created = keyed.filter("side = 'target'").select("deal_key").distinct().join(held.select("deal_key"), "deal_key", "left_anti").withColumn("fresh", F.lit(True))
    x = keyed.join(held, "deal_key", "left").join(created, "deal_key", "left")
    action = (
        F.when(F.col("state") == "LOCKED", "locked").when(F.col("deal_id").isNotNull(), "attached")
        .when(F.col("side") == "target", "created").when(F.col("fresh"), "attached").otherwise("waiting")
    )
    return x.select("fact_id", "side", "deal_key", F.when(action != "locked", F.col("deal_id")).alias("deal_id"), action.alias("action"))


def created_deals(assigned: DataFrame, facts: DataFrame) -> DataFrame:
    """(deal_key, target_name_raw, target_cik, first_fact_id) of deals to create, from the first target fact of each key."""
    first = assigned.filter("action = 'created'").groupBy("deal_key").agg(F.min("fact_id").alias("first_fact_id"))
    party = facts.select(F.col("id").alias("first_fact_id"), F.col("party.party_name_raw").alias("target_name_raw"), F.col("party.cik").alias("target_cik"))
    return first.join(party, "first_fact_id").select("deal_key", "target_name_raw", "target_cik", "first_fact_id")


def assignment_counts(assigned: DataFrame) -> DataFrame:
    """(action, facts, deals): how many facts each action took and how many keys they are of."""
    return assigned.groupBy("action").agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("deal_key").alias("deals"))


def merge_deals(facts: DataFrame, events: DataFrame, deals: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Facts and events moved from ``source_id`` to ``target_id``, deals without the sources, and one resolved alert per merge.

    Each source may be listed once; a target that is itself a source is not
    followed.  ``merges`` may hold a ``reason`` for the alert.
    """
    why = F.col("reason") if "reason" in merges.columns else F.lit(None).cast("string")
    m = merges.select(F.col("source_id").alias("deal_id"), "target_id", why.alias("reason")).dropDuplicates(["deal_id"])

    def moved(rows: DataFrame) -> DataFrame:
        to = m.select("deal_id", F.col("target_id").alias("_moved_to"))
        return rows.join(to, "deal_id", "left").withColumn("deal_id", F.coalesce("_moved_to", "deal_id")).select(rows.columns)

    kept = deals.join(m.select(F.col("deal_id").alias("id")), "id", "left_anti").select(deals.columns)
    alerts = m.select(
        F.lit("DEAL_MERGE_CANDIDATE").alias("alert_type"), F.col("target_id").alias("deal_id"), F.col("deal_id").alias("merged_deal_id"), F.col("reason").alias("description"), F.lit(True).alias("is_resolved")
    )
    return moved(facts), moved(events), kept, alerts


#: Names of one length that are compared as a block.
BLOCK_NAMES = 1_000


def near_in_blocks(one: list[str], two: list[str], least: float) -> Iterator[tuple[str, str, float]]:
    """Pairs (smaller, larger, ratio) of different names of two blocks with a ratio above ``least``."""
    for i, j, r in similar_pairs(one, two, least):
        if one[i] != two[j] and r > least:
            yield min(one[i], two[j]), max(one[i], two[j]), r


def near_names(names: DataFrame, least: float) -> DataFrame:
    """(name, other, similarity) of all pairs of distinct names above ``least``, once each with name < other.

    All blocks whose lengths allow the similarity meet, so the work grows with the square of the distinct names.
    """
    sized = names.select("name", F.length("name").alias("len"))
    chunks = sized.groupBy("len").agg(F.ceil(F.count(F.lit(1)) / BLOCK_NAMES).alias("chunks"))
    blocks = sized.join(chunks, "len").groupBy("len", F.pmod(F.xxhash64("name"), F.col("chunks")).alias("chunk")).agg(F.collect_list("name").alias("names"))
    a, b = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in ("len", "chunk", "names")]) for x in "ab")
    ordered = F.struct("len_a", "chunk_a") <= F.struct("len_b", "chunk_b")
    met = a.join(b, ordered & (F.col("len_a") * (200 - least) >= F.col("len_b") * least)).select("names_a", "names_b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {r for x, y in zip(pdf["names_a"], pdf["names_b"]) for r in near_in_blocks(list(x), list(y), least)}
            yield pd.DataFrame(list(rows), columns=["name", "other", "similarity"])

    spread = met.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInPandas(run, "name string, other string, similarity double").distinct()


def merge_candidates(deals: DataFrame, least: float = 85.0) -> DataFrame:
    """(deal_a, deal_b, similarity): deals of different keys whose target names are more alike than ``least``.

    Deals are told apart by name and key; the one with the smallest id stands for
    its copies (``candidate_members``).  Of one name, the first deal meets the
    first of every other key; of two names that are alike, the first two deals
    of different keys meet.  So rows grow with the names that are alike, not with
    the deals that have them, and every two alike names are linked.
    """
    d = deals.filter("target_name_normalized is not null and deal_key is not null").select("id", "deal_key", F.lower("target_name_normalized").alias("name"))
    kinds = d.groupBy("name", "deal_key").agg(F.min("id").alias("id"))
    first = kinds.groupBy("name").agg(F.min(F.struct("id", "deal_key")).alias("one"))
    others = kinds.join(first, "name").filter(F.col("deal_key") != F.col("one.deal_key"))
    same = others.select(F.col("one.id").alias("deal_a"), F.col("id").alias("deal_b"), F.lit(100.0).alias("similarity"))
    second = others.groupBy("name").agg(F.min(F.struct("id", "deal_key")).alias("two"))
    firsts = first.join(second, "name", "left")
    a = firsts.select("name", F.col("one").alias("a1"), F.col("two").alias("a2"))
    b = firsts.select(F.col("name").alias("other"), F.col("one").alias("b1"), F.col("two").alias("b2"))

    def pair(x: str, y: str) -> Column:
        ids = F.struct(F.least(f"{x}.id", f"{y}.id").alias("deal_a"), F.greatest(f"{x}.id", f"{y}.id").alias("deal_b"))
        return F.when(F.col(f"{x}.deal_key") != F.col(f"{y}.deal_key"), ids)

    met = near_names(d.select("name").distinct(), least).join(a, "name").join(b, "other")
    choice = F.coalesce(pair("a1", "b1"), F.least(pair("a1", "b2"), pair("a2", "b1")))
    near = met.select(choice.alias("p"), "similarity").filter("p is not null").select("p.deal_a", "p.deal_b", "similarity")
    return same.unionByName(near)


def candidate_members(deals: DataFrame) -> DataFrame:
    """(deal_id, representative): the deal that stands for each deal among merge candidates."""
    d = deals.filter("target_name_normalized is not null and deal_key is not null").select(F.col("id").alias("deal_id"), "deal_key", F.lower("target_name_normalized").alias("name"))
    first = d.groupBy("name", "deal_key").agg(F.min("deal_id").alias("representative"))
    return d.join(first, ["name", "deal_key"]).select("deal_id", "representative")
