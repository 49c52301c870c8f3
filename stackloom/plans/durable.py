"""Cutting lineage in a folder that every executor can reach."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. Only where it is
    unset and the session is a single process is a folder of our own made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="stackloom-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back from there, so a
    lost executor costs no recomputation of what came before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder for files that all executors read."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid4().hex}"


class Rounds:
    """Tables of the rounds of an iteration, as Parquet in the shared folder. Unlike a checkpoint, a table that was read back has the
    size it really has: sizes that are estimated from the rounds before would grow with every join until they are too
    long to compute. Tables that later rounds do not read are removed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def write(self, key: str, df: DataFrame) -> DataFrame:
        """``df`` written and read back. The last table of the same key is removed, since ``df`` has been computed from it."""
        path = shared_folder(self.spark, f"{self.name}-{key}")
        df.write.parquet(path)
        self.drop(key)
        self.paths[key] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        """Remove the tables of these keys."""
        for key in keys:
            path = self.paths.pop(key, None)
            if path is not None:
                hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def python_tasks(spark: SparkSession) -> int:
    """Partitions for work that takes far more time than its bytes suggest, so that they are not merged by size."""
    return max(3 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
