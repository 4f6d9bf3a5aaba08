"""Intermediate tables in the shared checkpoint folder.

Iterative operators cut their lineage by writing a table and reading it back.
The folder is the session's ``spark.checkpoint.dir``. Only in local mode (tests,
a laptop), where one machine does all, a folder of our own is chosen if it is
unset; on a cluster that is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="cadenza-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


class Scratch:
    """A folder for one run of one operator.

    ``save`` materialises a DataFrame there; ``drop`` removes one table that
    no later step reads. What the caller's result still reads stays.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self._paths.pop(id(df), None)
        if path:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
