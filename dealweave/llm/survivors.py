"""Best representative of each duplicate group, by iterative truth discovery.

Groups come from any key column; ``transaction_groups`` builds the one for deal
records.  Within the groups each non-null value is a claim by the source of its
record.  Claims are counted once per (group, field, value, source); then value
votes weighted by source reliability and the reliability of each source (how
often its claims win) are estimated in turn until the weights settle.  Records
that several groups could take go to the one whose winning values they share.
The surviving record is the first by a given order; its fields are filled with
the winning values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dealweave.llm.variants import link_variants
from dealweave.operators.graph import connected_components
from dealweave.session import cut_lineage, release

#: Columns whose non-null values make a deals record complete.
COMPLETENESS = (
    "acquirer_cik", "acquirer_name_raw", "target_cik", "target_name_raw", "target_name_normalized",
    "announcement_date", "agreement_date", "deal_value_usd", "market_tag", "sponsor_name_raw",
)
_DEAL_COLUMNS = ("id", "state", "created_at", "updated_at")
FUSED = (*COMPLETENESS, "deal_key", "expected_close_date", "actual_close_date", "is_sponsor_backed", "is_cross_border")
#: Those that tell attempts apart; the others name the parties, and these are the same for all that a record could join.
TERMS = (*COMPLETENESS[5:], "expected_close_date", "actual_close_date", "is_sponsor_backed", "is_cross_border")


def discover_truth(
    records: DataFrame, group: str, source: str, fields: list[str], tolerance: float = 1e-3, most_rounds: int = 100
) -> tuple[DataFrame, DataFrame]:
    """Winning values (group, field, value, support) and source weights (source, weight).

    Values are compared as strings.  Votes that tie go to the value with more
    records, then to the longer one, then to the smaller one.  Null values claim
    nothing, a null source is the source ``unknown``; groups without claims for
    a field have no row for it.  Rounds go on until no weight moves by
    ``tolerance``; from the tenth on a weight moves half way only, so that two
    states cannot alternate.  Weights that have not settled after
    ``most_rounds`` raise.
    """
    claims = cut_lineage(
        records.select(F.col(group).alias("g"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("s"), F.explode(_cells(fields)).alias("c"))
        .filter("g is not null and c.value is not null")
        .groupBy("g", F.col("c.field").alias("field"), F.col("c.value").alias("value"), "s")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Only fields with rival values tell sources apart; the rounds read nothing else.
    rivals = claims.groupBy("g", "field").agg(F.min("value").alias("low"), F.max("value").alias("high")).filter("low <> high")
    contested = cut_lineage(claims.join(rivals.select("g", "field"), ["g", "field"], "left_semi"))
    weights = table = cut_lineage(claims.select("s").distinct().withColumn("w", F.lit(1.0)))
    for turn in range(most_rounds):
        judged = contested.join(_winners(contested, weights), ["g", "field"])
        score = judged.groupBy("s").agg(F.sum(F.when(F.col("value") == F.col("best.value"), F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("all"))
        # Smoothed accuracy; log odds, never below a small positive weight.
        acc = (F.coalesce("right", F.lit(0)) + 1.0) / (F.coalesce("all", F.lit(0)) + 2.0)
        odds = F.greatest(F.log(acc / (1 - acc)) + 1.0, F.lit(0.05))
        fresh = weights.join(score, "s", "left").select("s", F.col("w").alias("old"), odds.alias("w"))
        if turn >= 10:
            fresh = fresh.withColumn("w", (F.col("old") + F.col("w")) / 2)
        fresh = cut_lineage(fresh)
        moved = fresh.agg(F.max(F.abs(F.col("w") - F.col("old")))).first()[0]
        release(table)
        weights, table = fresh.select("s", "w"), fresh
        if moved is None or moved < tolerance:
            break
    else:
        raise RuntimeError(f"source weights did not settle in {most_rounds} rounds")
    release(contested)
    won = _winners(claims, weights)
    found = won.select(F.col("g").alias(group), "field", F.col("best.value").alias("value"), F.col("best.support").alias("support"))
    return found, weights.select(F.col("s").alias("source"), F.col("w").alias("weight"))


def _cells(fields: list[str]) -> Column:
    """The fields of a record as (field, value), values as strings."""
    return F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])


def _winners(claims: DataFrame, weights: DataFrame) -> DataFrame:
    """(g, field, best): the value with the largest weighted vote."""
    votes = claims.join(weights, "s").groupBy("g", "field", "value").agg(F.sum(F.col("w") * F.col("n")).alias("support"), F.sum("n").alias("n"))
    # min over the negated measures, so the smallest value wins what is left tied.
    rank = F.struct(-F.round("support", 9), -F.col("n"), -F.length("value"), F.col("value"))
    return votes.groupBy("g", "field").agg(F.min_by(F.struct("value", "support"), rank).alias("best"))


def first_records(records: DataFrame, group: str, key: str, order: list[Column], min_records: int = 2) -> DataFrame:
    """(group, key, records) of the record that comes first in each group of at least ``min_records``.

    ``order`` are ascending measures, compared in turn; of equal records the
    smallest key comes first.  Groups are aggregated before they are moved, so
    one group may hold any share of the records.  Records with a null group are
    left alone.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.col(key).alias("key"))
    first = records.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(rank).alias("_first"), F.count(F.lit(1)).alias("records"))
    return first.filter(F.col("records") >= min_records).select(group, F.col("_first.key").alias(key), "records")


def best_representatives(
    records: DataFrame, group: str, key: str, source: str, order: list[Column], fields: list[str], min_records: int = 2
) -> DataFrame:
    """One row per group of at least ``min_records`` records: key of the survivor, records, fused fields.

    The survivor is the first record by ``order`` (see ``first_records``); each
    field holds the winning value of the group (null if no record has one), cast
    back to its type.  Records with a null group are left alone.  An empty table
    gives no rows.
    """
    first = cut_lineage(first_records(records, group, key, order, min_records))
    truth, _ = discover_truth(records.join(first.select(group), group, "left_semi"), group, source, fields)
    wide = truth.groupBy(group).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    typed = wide.select(group, *[F.col(f).cast(records.schema[f].dataType).alias(f) for f in fields])
    return first.join(typed, group, "left")


def place_by_truth(records: DataFrame, settled: DataFrame, chances: DataFrame, key: str, group: str, source: str, fields: list[str]) -> DataFrame:
    """(key, group) of the records that several groups could take.

    ``settled`` (key, group) are the records whose group is known; truth discovery
    over them gives every group its values.  ``chances`` (key, group, owner, away)
    are the groups open to each other record.  Each value that a record shares
    with a group counts for it, each other one against it; of equal groups the
    least ``away`` takes the record, and where that leaves several owners it is
    left out.
    """
    truth, _ = discover_truth(records.join(settled, key), group, source, fields)
    open_claims = records.join(chances.select(key), key, "left_semi").select(key, F.explode(_cells(fields)).alias("c")).select(key, "c.field", F.col("c.value").alias("claim"))
    votes = (
        chances.join(truth, group)
        .join(open_claims.filter("claim is not null"), [key, "field"])
        .groupBy(key, group)
        .agg(F.sum(F.when(F.col("claim") == F.col("value"), 1).otherwise(-1)).alias("votes"))
    )
    rank = F.struct((-F.coalesce("votes", F.lit(0))).alias("against"), F.col("away"), F.col(group).alias("group"))
    best = chances.join(votes, [key, group], "left").groupBy(key, "owner").agg(F.min(rank).alias("best"))
    first = best.withColumn("place", F.rank().over(Window.partitionBy(key).orderBy("best.against", "best.away"))).filter("place = 1")
    alone = first.groupBy(key).agg(F.min("best.group").alias(group), F.count(F.lit(1)).alias("owners")).filter("owners = 1")
    return alone.select(key, group)


def _cik(column: Column) -> Column:
    return F.nullif(F.ltrim(F.trim(column), F.lit("0")), F.lit(""))


def _part(which: int, kind: str) -> Column:
    """A side of a deal key ``cik:A:cik:T`` / ``cik:A:name:T`` / ``name:A:name:T``."""
    pattern = r"^(cik|name):(.*?):(cik|name):(.*)$"
    at = F.regexp_extract("deal_key", pattern, 2 * which - 1)
    value = F.regexp_extract("deal_key", pattern, 2 * which)
    return F.when(at == kind, F.nullif(value, F.lit("")))


def transaction_groups(deals: DataFrame, gap_days: int = 7) -> DataFrame:
    """(id, transaction) of the records: same acquirer, same target, same attempt.

    Parties are resolved by cik (zeros in front aside) and by linked spellings
    of their names, from the columns or, where those are null, from the deal key.
    Records of two parties are cut into attempts where announcements lie more
    than ``gap_days`` apart.  One without announcement joins the only attempt, or
    the one its agreement date fits; a record whose acquirer is unknown joins the
    only acquirer whose attempt for the target fits its date.  Where several
    attempts or acquirers are left, truth discovery over the records placed so
    far decides (see ``place_by_truth``), then the attempt closest to the
    agreement date, else to the creation.  Records without any target, or of an
    acquirer that stays unknown, are left out.  Repeated ids count once; columns
    other than those of ``FUSED``, the state and the creation are not read.
    """
    known = ("id", "acquirer_cik", "acquirer_name_raw", "target_cik", "target_name_raw", "target_name_normalized", "deal_key", "announcement_date", "agreement_date", "created_at")
    base = deals.select(*known).filter("id is not null").dropDuplicates(["id"]).withColumns(
        {
            "_ac": F.coalesce(_cik(F.col("acquirer_cik")), _cik(_part(1, "cik"))),
            "_an": F.coalesce("acquirer_name_raw", _part(1, "name")),
            "_tc": F.coalesce(_cik(F.col("target_cik")), _cik(_part(2, "cik"))),
            "_tn": F.coalesce("target_name_raw", "target_name_normalized", _part(2, "name")),
        }
    )
    base = cut_lineage(base)
    sides = {"acquirer": ("_ac", "_an"), "target": ("_tc", "_tn")}
    named = None
    for side, (_, name) in sides.items():
        part = base.select(F.lit(side).alias("field"), F.col(name).alias("name"))
        named = part if named is None else named.unionByName(part)
    linked = link_variants(named)
    for side, (cik, name) in sides.items():
        spelled = linked.filter(F.col("field") == side).select(F.col("name").alias(name), F.concat(F.lit("n:"), "entity").alias(f"_{side}_n"))
        base = base.join(spelled, name, "left").withColumn(f"_{side}_c", F.concat(F.lit("c:"), F.col(cik)))
    base = cut_lineage(base)
    # Both sides in one graph; the side in front keeps their nodes apart.
    ends = None
    for side in sides:
        mark = lambda col, side=side: F.concat(F.lit(f"{side}|"), F.col(col))
        part = base.select(mark(f"_{side}_c").alias("src"), mark(f"_{side}_n").alias("dst")).distinct()
        ends = part if ends is None else ends.unionByName(part)
    ends = cut_lineage(ends)
    nodes = ends.select(F.explode(F.array("src", "dst")).alias("node")).filter("node is not null")
    comp = cut_lineage(connected_components(nodes, ends))
    for side in sides:
        node = F.concat(F.lit(f"{side}|"), F.coalesce(f"_{side}_c", f"_{side}_n"))
        mine = comp.select(F.col("node").alias("_node"), F.col("component").alias(f"_{side}"))
        base = base.withColumn("_node", node).join(mine, "_node", "left").drop("_node")
    base = cut_lineage(base)

    parties = ["_target", "_acquirer"]
    dated = base.filter("_target is not null and _acquirer is not null and announcement_date is not null")
    at = F.unix_timestamp(F.col("announcement_date").cast("timestamp")) / 86400.0
    dated = dated.select("id", *parties, at.alias("_at"), F.floor(at).alias("_day"))
    # One row a day holds the window of two parties to the days there are, however many records they have.
    days = dated.groupBy(*parties, "_day").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"))
    w = Window.partitionBy(*parties).orderBy("_day")
    gap = F.col("_lo") - F.lag("_hi").over(w)
    days = cut_lineage(days.withColumn("_attempt", F.sum(F.when(gap > gap_days, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    dated = dated.join(days.select(*parties, "_day", "_attempt"), [*parties, "_day"])
    spans = days.groupBy(*parties, "_attempt").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp")) / 86400.0
    hint = F.coalesce(seconds("announcement_date"), seconds("agreement_date"), seconds("created_at"))
    away = F.greatest(F.col("_lo") - F.col("_at"), F.col("_at") - F.col("_hi"), F.lit(0.0))
    undated = base.filter("_target is not null and _acquirer is not null and announcement_date is null")
    undated = undated.select("id", *parties, hint.alias("_at"), F.col("agreement_date").isNotNull().alias("_agreed"))
    reach = undated.join(spans, parties, "left").withColumn("_away", F.coalesce(away, F.lit(0.0)))
    placed = cut_lineage(
        reach.groupBy("id", *parties).agg(
            F.min_by("_attempt", F.struct("_away", "_attempt")).alias("_attempt"),
            F.count("_attempt").alias("_many"),
            F.count(F.when(F.col("_agreed") & (F.col("_away") <= gap_days), 1)).alias("_fits"),
        )
    )
    stray = base.filter("_target is not null and _acquirer is null").select("id", "_target", hint.alias("_at"))
    near = cut_lineage(stray.join(spans, "_target").withColumn("_away", away).filter(F.col("_away") <= gap_days).drop("_at", "_lo", "_hi"))
    fit = near.groupBy("id", "_target").agg(
        F.min("_acquirer").alias("_acquirer"), F.max("_acquirer").alias("_other"), F.min_by("_attempt", F.struct("_away", "_attempt")).alias("_attempt")
    )
    transaction = F.concat_ws("\x01", "_acquirer", "_target", F.col("_attempt").cast("string")).alias("transaction")
    sure = F.expr("_many < 2 or _fits = 1")
    settled = cut_lineage(
        dated.select("id", transaction)
        .unionByName(placed.filter(sure).withColumn("_attempt", F.coalesce("_attempt", F.lit(0))).select("id", transaction))
        .unionByName(fit.filter("_acquirer = _other").select("id", transaction))
    )
    chance = ["id", transaction, F.col("_acquirer").alias("owner"), F.col("_away").alias("away")]
    chances = cut_lineage(
        reach.join(placed.filter(~sure).select("id"), "id", "left_semi").select(*chance)
        .unionByName(near.join(fit.filter("_acquirer <> _other").select("id"), "id", "left_semi").select(*chance))
    )
    records = deals.select("id", "state", "deal_key", *TERMS).dropDuplicates(["id"]).withColumn("_source", _source())
    return settled.unionByName(place_by_truth(records, settled, chances, "id", "transaction", "_source", list(TERMS)))


def _source() -> Column:
    """A record's source: how its key was built and its state, the two things that tell how it came about."""
    kind = F.regexp_replace(F.regexp_extract("deal_key", r"^((?:cik|name):).*?(:(?:cik|name):)", 0), r":.*:(?=(?:cik|name))", "/")
    return F.concat_ws("|", F.coalesce("state", F.lit("?")), kind)


def _order() -> list[Column]:
    """LOCKED, then the most complete, then the latest updated, then the smallest id."""
    known = sum((F.col(c).isNotNull().cast("int") for c in COMPLETENESS), F.lit(0))
    latest = F.unix_micros(F.col("updated_at").cast("timestamp"))
    return [F.when(F.col("state") == "LOCKED", 0).otherwise(1), -known, F.coalesce(-latest, F.lit(2**63 - 1)), F.col("id")]


def _grouped(deals: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Distinct deals records with their transaction."""
    return deals.select(*dict.fromkeys(columns)).dropDuplicates(["id"]).join(transaction_groups(deals), "id")


def survivor_ids(deals: DataFrame) -> DataFrame:
    """(transaction, deal_id, records): the survivor of every transaction, without fused fields."""
    records = _grouped(deals, (*_DEAL_COLUMNS, *COMPLETENESS))
    return first_records(records, "transaction", "id", _order()).withColumnRenamed("id", "deal_id")


def surviving_deals(deals: DataFrame) -> DataFrame:
    """Survivor and fused fields of every transaction with two or more deals records."""
    records = _grouped(deals, (*_DEAL_COLUMNS, *FUSED)).withColumn("_source", _source())
    return best_representatives(cut_lineage(records), "transaction", "id", "_source", _order(), list(FUSED)).withColumnRenamed("id", "deal_id")
