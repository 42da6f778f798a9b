"""Session helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "dealweave", cores: int | str = "*", **conf: str) -> SparkSession:
    """Local session for tests and the benchmark; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table of the data model, from ``<root>/<name>.parquet``."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; set one only where none is configured.

    A machine-local folder is acceptable only when driver and executors are the
    same machine, so without a configured folder a non-local master is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="dealweave-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows, written once as a table in the shared checkpoint folder and read back.

    Unlike ``checkpoint()``, which computes its rows twice, this computes them
    once, and the planner knows the size of what it reads.  The table lives until
    ``release`` removes it or the driver's file system closes.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{root}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables that ``cut_lineage`` wrote, once all that reads them is written itself."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._cut_path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def wide_parallelism(spark: SparkSession) -> int:
    """Tasks for rows that are few but dear: at least two for each core, at least the shuffle partitions."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
