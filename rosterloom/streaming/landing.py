"""A stream of uploads into the workspace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.workspace import Workspace
from ..sources.documents import valid_upload

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def landed_files(spark: SparkSession, path: str) -> DataFrame:
    """New PDF files below a folder, by name and size; contents stay where they are."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("path").alias("object_path"), "length")


def register_landed(workspace: Workspace, path: str, checkpoint: str) -> StreamingQuery:
    """Registers valid files batch by batch.

    Registration is a merge by file name, so a batch that is run again changes
    nothing but dates.  Which of two uploads is newer is decided at commit by upload
    date, so no watermark is needed.
    """

    def register(batch: DataFrame, _: int) -> None:
        valid = batch.filter(valid_upload(F.col("filename"), F.col("length"), F.lit(""))).select("filename", "object_path")
        if not valid.isEmpty():
            workspace.register(valid)

    files = landed_files(workspace.store.spark, path)
    return files.writeStream.foreachBatch(register).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
