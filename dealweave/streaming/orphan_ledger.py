"""The orphan state as a durable ledger fed by Structured Streaming micro-batches.

The state lies in buckets by parent key, so every effect of a change stays in
the bucket of its key.  A batch reads and writes the buckets it touches and
leaves the others where earlier batches put them; a small manifest per batch
says which version of each bucket holds.  It is renamed into place last, so a
batch that is replayed after a failure either finds its manifest and is skipped
or overwrites what the failed run left.  Bucket versions that neither of the
last two manifests names are removed.
"""

from __future__ import annotations

import json
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dealweave.operators.orphans import REFERENCE_COLUMNS, STATE_COLUMNS, OrphanState, advance, orphan_counts
from dealweave.session import cut_lineage

ROW = (
    "part string, record_table string, record_id bigint, parent_table string, missing_id bigint, "
    "referred_at timestamp_ntz, resolved_at timestamp_ntz, arrived_at timestamp_ntz, dateless boolean"
)
CHANGE = "kind string, record_table string, record_id bigint, parent_table string, missing_id bigint, at timestamp_ntz"


class OrphanLedger:
    """Versioned orphan state under ``path`` (a folder that all executors share), in ``buckets`` buckets.

    ``snapshot_every`` batches the counts per table and month are appended to
    ``path``/snapshots; 0 takes none.  The number of buckets is fixed by the
    first batch.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, snapshot_every: int = 1):
        self.spark, self.path, self.buckets, self.snapshot_every = spark, path.rstrip("/"), buckets, snapshot_every

    # ------------------------------------------------------------ files

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, version: int) -> dict | None:
        target, fs = self._at("manifests", f"{version}.json")
        if not fs.exists(target):
            return None
        stream = fs.open(target)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        draft, fs = self._at("manifests", f"_{version}.json")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        final, _ = self._at("manifests", f"{version}.json")
        fs.rename(draft, final)

    def _folder(self, version: int, bucket: int) -> str:
        return f"data/v={version}/bucket={bucket}"

    def _expire(self, version: int, kept: set[tuple[int, int]], before: dict) -> None:
        """Remove the bucket versions of the manifest two back that no later one names."""
        for bucket, held in before["holds"].items():
            if held >= 0 and (held, int(bucket)) not in kept:
                target, fs = self._at(*self._folder(held, int(bucket)).split("/"))
                fs.delete(target, True)
        target, fs = self._at("manifests", f"{version - 2}.json")
        fs.delete(target, False)

    # ------------------------------------------------------------ state

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("parent_table", "missing_id"), F.lit(self.buckets)).cast("int")

    def _rows(self, manifest: dict | None, only: list[int] | None = None) -> DataFrame:
        holds = {int(b): v for b, v in (manifest or {"holds": {}})["holds"].items()}
        paths = [f"{self.path}/{self._folder(v, b)}" for b, v in sorted(holds.items()) if v >= 0 and (only is None or b in only)]
        return self.spark.read.schema(ROW).parquet(*paths) if paths else self.spark.createDataFrame([], ROW)

    def _state(self, rows: DataFrame) -> OrphanState:
        return OrphanState(
            rows.filter("part = 'orphan'").select(*STATE_COLUMNS),
            rows.filter("part = 'reference'").select(*REFERENCE_COLUMNS),
            rows.filter("part = 'parent'").select("parent_table", F.col("missing_id").alias("parent_id"), "arrived_at", "dateless"),
        )

    def load(self, version: int) -> OrphanState | None:
        """State of a version, or None if it was never completed or has expired."""
        manifest = self._manifest(version)
        return None if manifest is None else self._state(self._rows(manifest))

    def apply(self, batch_id: int, changes: DataFrame) -> OrphanState:
        """Write version ``batch_id`` from version ``batch_id - 1``; a second call returns what the first wrote.

        ``changes`` has the columns of ``CHANGE``; kind is reference, parent,
        delete or withdraw, other kinds and null keys are ignored.  A batch
        whose predecessor is missing raises.
        """
        if (done := self.load(batch_id)) is not None:
            return done
        before = self._manifest(batch_id - 1)
        if before is None and batch_id > 0:
            raise ValueError(f"batch {batch_id} cannot be applied: batch {batch_id - 1} is not in {self.path}")
        if before is not None:
            self.buckets = before["buckets"]
        known = changes.filter("kind in ('reference', 'parent', 'delete', 'withdraw') and missing_id is not null and parent_table is not null")
        known = cut_lineage(known.select("kind", "record_table", "record_id", "parent_table", "missing_id", F.col("at").cast("timestamp_ntz").alias("at")))
        # At most as many numbers as there are buckets.
        touched = [r[0] for r in known.select(self._bucket()).distinct().collect()]
        holds = {str(b): -1 for b in range(self.buckets)} if before is None else dict(before["holds"])
        if touched:
            after = self._advance(self._state(self._rows(before, touched)), known)
            folder = f"{self.path}/data/v={batch_id}"
            spread = F.pmod(F.xxhash64("record_table", "record_id"), F.lit(8))
            after.withColumn("bucket", self._bucket()).repartition("bucket", spread).write.mode("overwrite").partitionBy("bucket").parquet(folder)
            for b in touched:
                target, fs = self._at(*self._folder(batch_id, b).split("/"))
                holds[str(b)] = batch_id if fs.exists(target) else -1
        manifest = {"buckets": self.buckets, "holds": holds}
        self._commit(batch_id, manifest)
        if self.snapshot_every and batch_id % self.snapshot_every == 0:
            self.counts(batch_id).write.mode("overwrite").parquet(f"{self.path}/snapshots/batch={batch_id}")
        if before is not None and (old := self._manifest(batch_id - 2)) is not None:
            kept = {(v, int(b)) for m in (manifest, before) for b, v in m["holds"].items()}
            self._expire(batch_id, kept, old)
        return self.load(batch_id)

    def _advance(self, state: OrphanState, known: DataFrame) -> DataFrame:
        def of(kind: str) -> DataFrame:
            return known.filter(F.col("kind") == kind)

        references = of("reference").select("record_table", "record_id", "parent_table", "missing_id", F.col("at").alias("referred_at"))
        parents = of("parent").select("parent_table", F.col("missing_id").alias("parent_id"), F.col("at").alias("arrived_at"), F.col("at").isNull().alias("dateless"))
        deleted = of("delete").select("parent_table", F.col("missing_id").alias("parent_id"))
        withdrawn = of("withdraw").select("record_table", "record_id", "parent_table", "missing_id")
        after = advance(state, references, parents, deleted, withdrawn)
        rows = (
            after.orphans.withColumn("part", F.lit("orphan"))
            .unionByName(after.references.withColumn("part", F.lit("reference")), allowMissingColumns=True)
            .unionByName(after.parents.withColumnRenamed("parent_id", "missing_id").withColumn("part", F.lit("parent")), allowMissingColumns=True)
        )
        return rows.select(*[c.split()[0] for c in ROW.split(", ")])

    def counts(self, version: int) -> DataFrame:
        """Snapshot of the counts per table and month at a version."""
        return orphan_counts(self._state(self._rows(self._manifest(version)).filter("part = 'orphan'")))


def run_ledger(changes: DataFrame, ledger: OrphanLedger, checkpoint: str) -> StreamingQuery:
    """Feed a stream of changes (columns of ``CHANGE``) into the ledger."""

    def step(to: OrphanLedger, batch: DataFrame, batch_id: int) -> None:
        to.apply(batch_id, batch)

    return (
        changes.writeStream.foreachBatch(partial(step, ledger))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
