"""Caches of derived rows by key and stamp.

A key (a file, a run) has a stamp that says what its rows were derived from. A
cache holds the rows of key and stamp; asking it for keys derives only those
whose stamp it lacks. Rows are written first and become visible by an entry in
the index, so a writer that dies leaves nothing that counts, and two writers of
one key leave two equal copies of which the first entry counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "key string, stamp string, rows long, batch string, at timestamp"


def stamp(*parts: Column | str) -> Column:
    """SHA-256 of the parts as text with their lengths, so that no two lists of parts have one text; null is a part of its own."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-:")) for t in texts]), 256)


def file_stamps(spark: SparkSession, path: str, version: str = "1") -> DataFrame:
    """key, stamp of every file under a path: its address, size, time of change and the version of what reads it. The files aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), stamp(F.col("length"), F.unix_micros("modificationTime"), version).alias("stamp"))


class StampedCache:
    """A folder of batches of rows and an index of (key, stamp, rows, batch)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _has(self, name: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def index(self) -> DataFrame:
        """The entry that counts for each key and stamp: the first, then that of the smaller batch."""
        if not self._has("index"):
            return self.spark.createDataFrame([], INDEX)
        every = self.spark.read.schema(INDEX).parquet(f"{self.root}/index")
        w = Window.partitionBy("key", "stamp").orderBy("at", "batch")
        return every.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The wanted (key, stamp) that the cache lacks. A key without rows that was derived isn't missing."""
        return wanted.select("key", "stamp").distinct().join(self.index(), ["key", "stamp"], "left_anti")

    def put(self, derived: DataFrame, keys: DataFrame) -> str:
        """Writes derived rows (key and more) of keys (key, stamp), all of them in one batch; gives its name."""
        batch = uuid.uuid4().hex
        derived.join(keys.select("key", "stamp"), "key").write.parquet(f"{self.root}/rows/batch={batch}")
        n = self.spark.read.parquet(f"{self.root}/rows/batch={batch}").groupBy("key").agg(F.count("*").alias("rows"))
        entry = keys.select("key", "stamp").join(n, "key", "left").select("key", "stamp", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"), F.lit(batch).alias("batch"), F.current_timestamp().alias("at"))
        entry.write.mode("append").parquet(f"{self.root}/index")
        return batch

    def read(self, wanted: DataFrame) -> DataFrame:
        """key, stamp and the rows of the wanted keys that the cache has; only their batches are opened."""
        if not self._has("rows"):
            raise ValueError("the cache is empty")
        hits = wanted.select("key", "stamp").distinct().join(self.index(), ["key", "stamp"]).select("key", "stamp", "batch")
        return self.spark.read.option("basePath", f"{self.root}/rows").parquet(f"{self.root}/rows").join(hits, ["key", "stamp", "batch"]).drop("batch")

    def derive(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of all wanted keys. ``make`` gets the missing (key, stamp) and gives their rows, with key."""
        missing = self.missing(wanted)
        if not missing.isEmpty():
            from cadenza.plans.scratch import Scratch

            todo = Scratch(self.spark, "cache").save(missing)
            self.put(make(todo), todo)
        return self.read(wanted)

    def compact(self) -> None:
        """One batch of what counts, for a cache of many small ones; the old batches stay for their readers until the folder is cleared."""
        live = self.index()
        rows = self.read(live)
        batch = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/rows/batch={batch}")
        old = live.withColumns({"batch": F.lit(batch), "at": F.to_timestamp(F.lit("1970-01-01 00:00:00"))})
        old.write.mode("append").parquet(f"{self.root}/index")


def cached_scan(spark: SparkSession, path: str, root: str, read: Callable[[list[str]], DataFrame], version: str = "1") -> DataFrame:
    """key, stamp and the parsed rows of the files under a path; only files that are new or have changed are parsed.

    ``read`` parses a list of files. Files that are gone don't count any more.
    """
    cache = StampedCache(spark, root)

    def parse(todo: DataFrame) -> DataFrame:
        files = [r["key"] for r in todo.select("key").collect()]  # addresses, as a reader's own listing has them
        return read(files).withColumn("key", F.col("_metadata.file_path"))

    return cache.derive(file_stamps(spark, path, version), parse)
