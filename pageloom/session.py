"""Session defaults and lineage cuts."""

from __future__ import annotations

import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pageloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings every job here relies on; ``conf`` wins over the defaults."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Parsing a page costs far more than reading its bytes: let small inputs use all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k",
        # A conversion plan has more generated classes than the default cache holds; without
        # room for them every task would compile its code again.
        "spark.sql.codegen.cache.maxEntries": "2000",
        **conf,
    }
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


# One temporary folder per local application.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for intermediate tables (``spark.checkpoint.dir``).

    A temporary folder takes its place on a local master only, where all tasks see the same disk;
    anywhere else a missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="pageloom-")
    return _LOCAL[app]


def work_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables; :func:`release` removes it."""
    return f"{shared_folder(spark).rstrip('/')}/pageloom/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Remove this application's intermediate tables; DataFrames that read them end with this."""
    path = spark._jvm.org.apache.hadoop.fs.Path(work_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    local = _LOCAL.pop(spark.sparkContext.applicationId, None)
    if local:
        shutil.rmtree(local, ignore_errors=True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets several readers of one stage prune
    columns instead of computing the stage again. :func:`release` removes what was written.
    """
    path = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
