"""Session settings shared by tests, the benchmark and the entry module."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The hint for joins of tables that grow with the input: Spark takes a table for as small as its files or shuffled blocks,
#: and rows that repeat much pack into far less than they are, so that it would send whole tables through the driver.
SHUFFLED = "merge"
#: The same where rows of two numbers, each of them once, are looked up by wide ones, which then need no sort.
HASHED = "shuffle_hash"


def build_session(app: str = "rosterloom", master: str | None = None, partitions: int | None = None, **extra: str) -> SparkSession:
    """A session with UTC timestamps and adaptive execution.

    ``partitions`` fixes the number of shuffle partitions for local runs; on a
    cluster leave it unset and let adaptive execution coalesce.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Lets local Python workers find this package where the driver found it; clusters ship it with ``--py-files``."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied Parquet tables, by name."""
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, as in tests, a new local one that goes with the driver."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    place = tempfile.TemporaryDirectory(prefix="rosterloom-")
    atexit.register(place.cleanup)
    return place.name


class Aside:
    """Intermediate tables, written to cut lineage and read again; they outlive lost executors and go with the driver."""

    def __init__(self, spark: SparkSession, root: str | None = None) -> None:
        self.spark, self.root, self.count = spark, f"{root or shared_folder(spark)}/aside-{uuid.uuid4().hex}", 0
        atexit.register(self.clear)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM may be gone already when the driver ends
            pass
