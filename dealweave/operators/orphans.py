"""References to records that do not exist, kept as incremental keyed state.

The state is one row per orphan reference: who refers to which missing key of
which parent table, since when, and - once the parent came too late - when it
came.  A batch brings new references, newly arrived parents, deleted parents and
withdrawn references:

* new references probe the parent index by key; those whose parent is absent, or
  came only after the reference was last touched, open an orphan;
* arriving parents are joined to the waiting orphans of their key: a parent not
  younger than the reference settles it, a later one marks it resolved;
* deletions remove keys from the index and reopen the references to them.

After any sequence of batches the state is that of one batch with everything
still live.  Joins are equi-joins on (parent table, key) against a deduplicated
index, so a key that holds a third of all references is one skewed partition on
the streamed side only, which AQE splits; nothing is collected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REFERENCE_COLUMNS = ("record_table", "record_id", "parent_table", "missing_id", "referred_at")
STATE_COLUMNS = (*REFERENCE_COLUMNS, "resolved_at")


@dataclass(frozen=True)
class OrphanState:
    """All three parts of the ledger after a batch."""

    orphans: DataFrame  #: STATE_COLUMNS
    references: DataFrame  #: REFERENCE_COLUMNS, every live reference once
    parents: DataFrame  #: parent_table, parent_id, arrived_at, dateless


def references_from(df: DataFrame, record_table: str, record_id: str, parent_table: str, key: str, touched: str, is_array: bool = False) -> DataFrame:
    """Distinct non-null references of a table; with ``is_array`` each entry of the array is one."""
    value = F.explode(F.col(key)) if is_array else F.col(key)
    return (
        df.select(F.col(record_id).cast("long").alias("record_id"), F.col(touched).alias("referred_at"), value.alias("missing_id"))
        .withColumn("missing_id", F.col("missing_id").cast("long"))
        .filter(F.col("missing_id").isNotNull())
        .select(F.lit(record_table).alias("record_table"), "record_id", F.lit(parent_table).alias("parent_table"), "missing_id", "referred_at")
    )


def parents_from(df: DataFrame, parent_table: str, key: str, created: str) -> DataFrame:
    """Parent index rows, one per key: the first arrival, and whether some row has no date."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("parent_id"))
        .agg(F.min(created).alias("arrived_at"), F.bool_or(F.col(created).isNull()).alias("dateless"))
        .select(F.lit(parent_table).alias("parent_table"), "parent_id", "arrived_at", "dateless")
    )


def _probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """Orphans among the references, resolved_at set where the parent came later."""
    p = parents.select(F.col("parent_table").alias("_pt"), F.col("parent_id").alias("_pid"), "arrived_at", "dateless")
    joined = references.join(p, (F.col("parent_table") == F.col("_pt")) & (F.col("missing_id") == F.col("_pid")), "left")
    late = ~F.col("dateless") & (F.col("arrived_at") > F.col("referred_at"))
    return joined.filter(F.col("_pid").isNull() | late).select(*REFERENCE_COLUMNS, F.col("arrived_at").alias("resolved_at"))


def merge_parents(parents: DataFrame) -> DataFrame:
    """One index row per parent: its first arrival, and whether some row has no date."""
    return parents.groupBy("parent_table", "parent_id").agg(F.min("arrived_at").alias("arrived_at"), F.bool_or("dateless").alias("dateless"))


def open_state(references: DataFrame, parents: DataFrame) -> OrphanState:
    """State after the first batch, from nothing.

    A reference touched at an unknown time is an orphan only if its parent is
    absent; a parent without a date is present from the start.  Repeated rows of
    a reference or a parent count once.
    """
    live, index = references.select(*REFERENCE_COLUMNS).distinct(), merge_parents(parents)
    return OrphanState(_probe(live, index), live, index)


def advance(
    state: OrphanState,
    references: DataFrame | None = None,
    parents: DataFrame | None = None,
    deleted: DataFrame | None = None,
    withdrawn: DataFrame | None = None,
) -> OrphanState:
    """State after one batch: withdrawals and deletions first, then arrivals, then new references.

    ``deleted`` has (parent_table, parent_id), ``withdrawn`` (record_table,
    record_id, parent_table, missing_id) of references that no longer hold; a
    record that changed is withdrawn and comes again.  Only orphans and
    references whose keys occur in the batch change; empty batches change
    nothing, and a batch that comes twice changes nothing the second time.
    """
    orphans, index, live = state.orphans.select(*STATE_COLUMNS), state.parents, state.references
    key = ["parent_table", "missing_id"]
    if withdrawn is not None:
        past = withdrawn.select("record_table", "record_id", *key).distinct()
        orphans = orphans.join(past, past.columns, "left_anti").select(*STATE_COLUMNS)
        live = live.join(past, past.columns, "left_anti").select(*REFERENCE_COLUMNS)
    if deleted is not None:
        gone = deleted.select("parent_table", "parent_id").distinct()
        index = index.join(gone, ["parent_table", "parent_id"], "left_anti")
        hit = gone.withColumnRenamed("parent_id", "missing_id")
        reopened = live.join(hit, key, "left_semi").withColumn("resolved_at", F.lit(None).cast(orphans.schema["resolved_at"].dataType))
        orphans = orphans.join(hit, key, "left_anti").select(*STATE_COLUMNS).unionByName(reopened.select(*STATE_COLUMNS))
    if parents is not None:
        fresh = merge_parents(parents)
        came = fresh.select("parent_table", F.col("parent_id").alias("missing_id"), "arrived_at", "dateless")
        index = merge_parents(index.unionByName(fresh))
        waiting = orphans.join(came, key, "left").withColumn("first", F.least("resolved_at", "arrived_at"))
        settled = F.col("dateless") | F.col("first").isNull() | F.col("referred_at").isNull() | (F.col("first") <= F.col("referred_at"))
        orphans = waiting.filter(F.col("dateless").isNull() | ~settled).withColumn("resolved_at", F.col("first")).select(*STATE_COLUMNS)
    if references is not None:
        fresh = references.select(*REFERENCE_COLUMNS).distinct()
        # One that is known already probes to the row it has.
        orphans = orphans.unionByName(_probe(fresh, index)).distinct()
        live = live.unionByName(fresh).distinct()
    return OrphanState(orphans, live, index)


def orphan_rows(state: OrphanState) -> DataFrame:
    """Distinct (record_table, record_id, missing_id) of all orphans, resolved ones included."""
    return state.orphans.select("record_table", "record_id", "missing_id").distinct()


def orphan_counts(state: OrphanState) -> DataFrame:
    """Snapshot: orphans per referring table, parent table and month of the reference.

    ``pending`` have no parent yet, ``late`` were resolved by a parent that came
    afterwards; references of unknown time count under a null month.
    """
    return (
        state.orphans.groupBy("record_table", "parent_table", F.date_format("referred_at", "yyyy-MM").alias("month"))
        .agg(
            F.count(F.lit(1)).alias("orphans"),
            F.count_if(F.col("resolved_at").isNull()).alias("pending"),
            F.count_if(F.col("resolved_at").isNotNull()).alias("late"),
        )
    )
