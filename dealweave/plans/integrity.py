"""References that lead nowhere: queries over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealweave.operators.orphans import OrphanState, advance, open_state, orphan_counts, orphan_rows, parents_from, references_from
from dealweave.session import read_table

#: Batches of equal spans of time in which the changes reach the state.
BATCHES = 3


def _state(spark: SparkSession, root: str) -> OrphanState:
    """State after all changes in the order of their dates; those without a date come last."""
    facts, events = read_table(spark, root, "atomic_facts"), read_table(spark, root, "financing_events")
    alerts = read_table(spark, root, "processing_alerts")
    references = (
        references_from(facts, "atomic_facts", "id", "deals", "deal_id", "updated_at")
        .unionByName(references_from(events, "financing_events", "id", "atomic_facts", "source_fact_ids", "updated_at", is_array=True))
        .unionByName(references_from(alerts, "processing_alerts", "id", "exhibits", "exhibit_id", "updated_at"))
    )
    parents = (
        parents_from(read_table(spark, root, "deals"), "deals", "id", "created_at")
        .unionByName(parents_from(facts, "atomic_facts", "id", "created_at"))
        .unionByName(parents_from(read_table(spark, root, "exhibits"), "exhibits", "id", "created_at"))
    )
    span = alerts.select("updated_at").unionByName(facts.select("updated_at")).agg(F.min("updated_at"), F.max("updated_at")).first()
    if span[0] is None:
        return open_state(references, parents)
    edges = [span[0] + (span[1] - span[0]) * k / BATCHES for k in range(1, BATCHES)]

    def batch(df: DataFrame, at: str, k: int) -> DataFrame:
        number = sum((F.coalesce(F.col(at) > F.lit(str(e)).cast("timestamp_ntz"), F.lit(True)).cast("int") for e in edges), F.lit(0))
        return df.filter(number == k)

    state = open_state(batch(references, "referred_at", 0), batch(parents, "arrived_at", 0))
    for k in range(1, BATCHES):
        state = advance(state, batch(references, "referred_at", k), batch(parents, "arrived_at", k))
    return state


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """References to missing or later parents, one by one."""
    return orphan_rows(_state(spark, root))


def p3_orphan_counts(spark: SparkSession, root: str) -> DataFrame:
    """Orphan references per table and month."""
    return orphan_counts(_state(spark, root))


_ORPHANS = """
with refs as (
  select 'atomic_facts' as record_table, id as record_id, 'deals' as parent_table, deal_id as missing_id, updated_at from atomic_facts
  union
  select 'financing_events', id, 'atomic_facts', unnest(source_fact_ids), updated_at from financing_events
  union
  select 'processing_alerts', id, 'exhibits', exhibit_id, updated_at from processing_alerts
), parents as (
  select 'deals' as parent_table, id, created_at from deals
  union all select 'atomic_facts', id, created_at from atomic_facts
  union all select 'exhibits', id, created_at from exhibits
), orphans as (
  select r.*, p.created_at as resolved_at
  from refs r left join parents p on p.parent_table = r.parent_table and p.id = r.missing_id
  where r.missing_id is not null and (p.id is null or p.created_at > r.updated_at)
)
"""

QUERIES = {"p3_found": p3_found, "p3_orphan_counts": p3_orphan_counts}
SQL = {
    "p3_found": _ORPHANS + "select distinct record_table, record_id, missing_id from orphans",
    "p3_orphan_counts": _ORPHANS
    + """select record_table, parent_table, strftime(updated_at, '%Y-%m') as month, count(*) as orphans,
    count(*) filter (resolved_at is null) as pending, count(*) filter (resolved_at is not null) as late
    from orphans group by 1, 2, 3""",
}
