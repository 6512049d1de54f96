"""Tables written to the shared folder between the steps of an operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from larkspan.session import configure, shared_folder


# Removes the shuffle files of a statement when it ends; the stored table replaces them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables under ``spark.checkpoint.dir`` that cut lineage.

    A lost executor costs only the tasks since the last stored table. ``drop``
    removes tables that no later step reads; what a result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = configure(spark)
        self.folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str = "table") -> str:
        self.count += 1
        return f"{self.folder}/{self.count:03d}-{name}"

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(table._stored_at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name
