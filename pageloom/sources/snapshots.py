"""Tables kept as whole versions: readers see the last complete one, and a write that failed changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Complete versions, oldest first. A version counts once its job has put the marker of success."""
    path, system = _files(spark, folder)
    if not system.exists(path):
        return []
    found = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and system.exists(marker):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def read_snapshot(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame | None:
    """The newest complete version; None before the first. ``schema`` saves the look into its files."""
    done = versions(spark, folder)
    if not done:
        return None
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/version={done[-1]:09d}")


def write_snapshot(table: DataFrame, folder: str, keep: int = 2) -> int:
    """Write ``table`` as the next version, which may be made from the one before, and return its number.

    What a failed write left is replaced by the next. The last ``keep`` versions stay, so that readers of the one before
    can finish; older ones go. One writer at a time.
    """
    spark = table.sparkSession
    done = versions(spark, folder)
    number = done[-1] + 1 if done else 1
    table.write.mode("overwrite").parquet(f"{folder}/version={number:09d}")
    _, system = _files(spark, folder)
    for old in done[: max(0, len(done) + 1 - keep)]:
        system.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/version={old:09d}"), True)
    return number
