"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_CONF = "spark.stave.blockRows"
_local_scratch: dict[str, str] = {}
_shipped: set[str] = set()


def build_session(app: str = "stave", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "stave.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def block_rows(spark: SparkSession) -> int:
    """Rows of one key above which ordered operators split that key into blocks."""
    return int(spark.conf.get(BLOCK_ROWS_CONF, "1000000"))


def shared_dir(spark: SparkSession) -> str:
    """The folder for written intermediate tables.

    A cluster names it in ``spark.checkpoint.dir`` (storage every executor can
    reach); without it the warehouse is used. Only in local mode, where driver and
    executors are one process, is a temporary folder of this machine used.
    """
    context = spark.sparkContext
    app, configured = context.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    local = re.fullmatch(r"local(\[[^\]]*\])?", context.master)
    if not configured and not local:
        configured = spark.conf.get("spark.sql.warehouse.dir")
    if configured:
        return f"{configured.rstrip('/')}/stave-{app}"
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="spark-stave-")
    return _local_scratch[app]


def new_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result to the shared folder and read it back.

    Cuts a long lineage so that later steps, and retries after a lost executor,
    start from the written table instead of recomputing everything before it.
    """
    path = new_dir(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
