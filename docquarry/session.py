"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

def build_session(app: str = "docquarry", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Bodies are stored with their common paths as columns, and scans read the paths they need.
        "spark.sql.variant.writeShredding.enabled": "true",
        "spark.sql.variant.inferShreddingSchema": "true",
        "spark.sql.variant.pushVariantIntoScan": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's ``spark.checkpoint.dir``.

    Where that setting is absent, a local folder is made and set on a local master; on a
    cluster, whose executors would each write to their own disk, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.getCheckpointDir():
            master = spark.sparkContext.master
            if master != "local" and not master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docquarry-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/docquarry/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: short plan, survives lost executors."""
    path = work_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)  # ids in hex take half the bytes
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, split_bytes: int | None = None) -> DataFrame:
    """Use all cores for CPU-heavy narrow work on an input with few splits.

    A small file is one split and would keep one core busy.  Inputs with at least as
    many splits as cores (any large table) are returned as they are, without a shuffle.
    ``split_bytes`` bounds what a task gets of the stored input, so that tasks grow in number and
    not in length.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution()
    splits = plan.toRdd().getNumPartitions()
    if split_bytes:
        cores = max(cores, -(-int(str(plan.optimizedPlan().stats().sizeInBytes())) // split_bytes))
    return df if splits >= cores else df.repartition(cores)


def compute_once(df: DataFrame, *columns: str) -> DataFrame:
    """Fix computed columns before filters or many expressions read them.

    Catalyst copies a computed column into every filter and field access that uses
    it; behind a generator it is evaluated once per row.  Stored columns need none of
    this.  The outer form is used because it makes Catalyst add no filter on the array.
    """
    kept = [c for c in df.columns if c not in columns]
    once = df.select(*kept, F.explode_outer(F.array(F.struct(*columns))).alias("__once"))
    return once.select(*[F.col("__once")[c].alias(c) if c in columns else F.col(c) for c in df.columns])
