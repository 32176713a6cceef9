"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelforge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and a fixed UTC time zone.

    Partition counts are left to adaptive execution: it starts from
    ``spark.sql.shuffle.partitions`` and coalesces or splits at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        # Call-site capture costs more than the planning of wide plans.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a new local one only where none is named."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    local = tempfile.mkdtemp(prefix="panelforge-checkpoint-")
    spark.sparkContext.setCheckpointDir(local)
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the checkpoint folder and read it back.

    For a result with several consumers.  A Parquet table rather than a
    checkpointed RDD: later plans read only the columns they need and know its
    size when they choose a join.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/panelforge-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
