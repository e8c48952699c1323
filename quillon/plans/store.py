"""Tables in the folder that all executors share; they cut lineage and survive a lost executor."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-quillon-")


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it isn't set, a folder of this machine's own, and that in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return given or _own_folder()


class Table:
    """Rows as a list of Parquet parts: adding a part leaves what is there as it is, and reading is one scan."""

    def __init__(self, spark: SparkSession, schema, parts: tuple[str, ...] = ()):
        self.spark, self.schema, self.parts = spark, schema, parts

    def frame(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], self.schema)

    def written(self, df: DataFrame) -> tuple[Table, int]:
        """A table of df alone, and its number of rows, which the job that writes it counts."""
        path, seen = f"{folder(self.spark)}/relation-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        return Table(self.spark, self.schema, (path,)), seen.get["n"]

    def plus(self, other: Table) -> Table:
        return Table(self.spark, self.schema, self.parts + other.parts)

    def drop(self) -> None:
        for path in self.parts:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
