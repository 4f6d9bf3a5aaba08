"""The registry as append-only tables: the latest row wins, constraints are queries that must be empty."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Of each key's rows the last by ``order``: an upsert over an append-only table."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_absent(table: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The table and those of the new rows whose key it lacks."""
    return table.unionByName(new.join(table.select(*key).distinct(), key, "left_anti"))


def current_reviews(labels: DataFrame, pointer: DataFrame) -> DataFrame:
    """The labels of the batch that each run points at. A batch without labels is valid: its run has no rows here, but a pointer."""
    return labels.join(pointer, ["run", "batch"])


def corrections(shown: DataFrame, saved: DataFrame, key: list[str], label: str) -> DataFrame:
    """Rows whose saved label differs from the shown one, null counting as a label."""
    j = shown.select(*key, F.col(label).alias("shown")).join(saved.select(*key, F.col(label).alias("saved")), key, "left")
    return j.where(~F.col("shown").eqNullSafe(F.col("saved")))


def validation_status(review: str, prediction: str):
    """Unreviewed, Reviewed without prediction, Validated correct or Corrected."""
    r, p = F.col(review), F.col(prediction)
    return F.when(r.isNull(), "Unreviewed").when(p.isNull(), "Reviewed without prediction").when(r == p, "Validated correct").otherwise("Corrected")


def unpivot(wide: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """key, feature, value of every feature that is not null."""
    return wide.unpivot(key, features, "feature", "value").where("value IS NOT NULL")


def history(weights: DataFrame, snapshots: DataFrame, span: int = 86_400_000_000) -> DataFrame:
    """The weights of all snapshots with their time (``created``, a number) and place, in order.

    Rows are numbered within spans of time, a day of microseconds each; only
    the spans' counts are summed up over all.
    """
    rows = weights.join(snapshots, "snapshot").withColumn("_span", F.floor(F.col("created") / span))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = rows.groupBy("_span").agg(F.count("*").alias("n")).select(F.col("_span").alias("_of"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_span").orderBy("created", "snapshot", "rank"))
    return rows.join(spans, F.col("_span").eqNullSafe(F.col("_of"))).withColumn("place", F.col("_before") + own).drop("_span", "_of", "_before")


def violations(table: DataFrame, key: list[str], parent: DataFrame | None = None, foreign: str | None = None, parent_key: str | None = None, check: str = "true") -> DataFrame:
    """rule, n: rows beyond the first of a key, rows without parent, rows that fail a check."""
    dup = table.groupBy(*key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).select(F.lit("primary key").alias("rule"), "n")
    bad = table.where(f"NOT ({check})").agg(F.count("*").alias("n")).select(F.lit("check").alias("rule"), "n")
    out = dup.union(bad)
    if parent is not None:
        orphan = table.where(F.col(foreign).isNotNull()).join(parent.select(F.col(parent_key).alias(foreign)), foreign, "left_anti")
        out = out.union(orphan.agg(F.count("*").alias("n")).select(F.lit("foreign key").alias("rule"), "n"))
    return out


class Registry:
    """Versioned tables under a folder. A version is written whole, then named by a pointer, so readers see one version or the next."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self, table: str) -> list[int]:
        fs, p = self._fs(f"{self.root}/{table}")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = [int(n[1:]) for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1])]
        return sorted(done)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.versions(table)
        if not v:
            raise ValueError(f"no table {table}")
        return self.spark.read.parquet(f"{self.root}/{table}/v{v[-1] if version is None else version}")

    def write(self, table: str, rows: DataFrame) -> int:
        """A new version; it counts once Spark's success mark is there, the last thing written."""
        v = (self.versions(table) or [0])[-1] + 1
        rows.write.parquet(f"{self.root}/{table}/v{v}")
        return v

    def upsert(self, table: str, rows: DataFrame, key: list[str]) -> int:
        old = self.versions(table)
        if not old:
            return self.write(table, rows)
        kept = self.read(table).join(rows.select(*key).distinct(), key, "left_anti")
        return self.write(table, kept.unionByName(rows))

    def backup(self, to: str) -> None:
        """Copies the current version of every table; refuses a destination that exists."""
        fs, p = self._fs(self.root)
        target, q = self._fs(to)
        if target.exists(q):
            raise ValueError(f"{to} exists")
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            self.read(name).write.mode("errorifexists").parquet(f"{to.rstrip('/')}/{name}/v1")
