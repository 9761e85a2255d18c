"""Session construction and session-wide conventions."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings the operators rely on; a cluster's own values win where they are already set.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is given."""
    builder = SparkSession.builder.master(master).appName("lexiflow")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false"} | conf
    return builder.config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster's ``spark.checkpoint.dir`` is used as it is. Only where it is unset and the master is
    local, as in tests, a temporary folder is set; on a cluster a machine's own folder would not be shared, so there it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = shared or os.path.join(tempfile.gettempdir(), "lexiflow-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame, least: int | None = None) -> DataFrame:
    """Give a scan with fewer partitions than cores as many as there are cores.

    Used before CPU-heavy expressions only: a scan that already has enough splits is left alone,
    so large inputs never pay for this shuffle.
    """
    want = least or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows once, as a compressed table in the shared folder, and read them back.

    The table outlives lost executors. It is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  (the session may be gone already)
        pass
