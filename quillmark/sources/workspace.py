"""Tables that a query writes once and reads often, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where executors are threads of this process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Written tables of one query; ``close`` deletes them, at the latest when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, rows: DataFrame, table: str, by: str | None = None) -> DataFrame:
        path = f"{self.root}/{table}"
        out = rows.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def close(self) -> None:
        try:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may be over
            pass
