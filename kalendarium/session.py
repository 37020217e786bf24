"""Session settings the jobs rely on, and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: runtime settings that change results; sizes are left to the cluster's own tuning
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}


#: how skewed joins are dealt with: split huge groups even where that costs another shuffle
SKEW_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

#: folders are listed by this many tasks at most; by default every folder is a task, which takes longer to deal than to list
LISTING_CONF = {"spark.sql.sources.parallelPartitionDiscovery.parallelism": "256"}


def build(app_name: str = "kalendarium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``master`` only for local runs."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **SKEW_CONF, **LISTING_CONF, **conf}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to a session somebody else built."""
    for key, value in {**SEMANTIC_CONF, **SKEW_CONF, **LISTING_CONF}.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``); a scratch folder only where none is set."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if shared:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared)
        return shared
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kalendarium-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back: survives executor loss, keeps the
    plan short between the rounds of iterative operators, and gives later joins a known size."""
    path = f"{checkpoint_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
