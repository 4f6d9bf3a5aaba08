"""The registry as one log of commits: what is committed together is seen together.

A commit writes its rows, then a manifest with the next number, if no other
writer has taken it; the manifest names all files of all tables. A reader opens
one manifest, so it sees every table at the same commit. A writer that loses
the number looks at what the winner has committed and tries again.

Tables are append-only. Of a key, ``current`` gives the rows of its last
commit (a batch replaces the one before), ``merged`` the last value of each
column that isn't null (an upsert that keeps what it wasn't told).
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fields of the state that don't make a snapshot another one.
VOLATILE = ("updated_at", "excel_sync")
ATTEMPTS = 20


def encode(value) -> str:
    """The one JSON text of a value; a number that isn't finite is an error."""
    return json.dumps(value, sort_keys=True, allow_nan=False, separators=(",", ":"))


def content_digest(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order, with the names of its columns: one aggregate."""
    columns = sorted(df.columns)
    h = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    g = F.xxhash64(F.lit("second"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    got = df.agg(F.count("*").alias("n"), *[F.sum(x.cast("decimal(38,0)")).alias(k) for k, x in (("a", h), ("b", g))]).first()
    return hashlib.sha256(encode([columns, got["n"], str(got["a"]), str(got["b"])]).encode()).hexdigest()


class View:
    """The tables of one commit."""

    def __init__(self, store: Store, manifest: dict):
        self.store, self.manifest, self.version, self.meta = store, manifest, manifest["version"], manifest["meta"]

    def has(self, table: str) -> bool:
        return table in self.manifest["tables"]

    def table(self, table: str) -> DataFrame:
        """All rows of a table with ``commit``, the number of the commit they came by."""
        parts = self.manifest["tables"].get(table)
        if not parts:
            raise ValueError(f"no table {table} in version {self.version}")
        numbers = self.store.spark.createDataFrame([(p["id"], p["commit"]) for p in parts], "_id string, commit long")
        base = f"{self.store.root}/data/{table}"
        rows = self.store.spark.read.option("basePath", base).parquet(*[f"{base}/_id={p['id']}" for p in parts])
        return rows.join(F.broadcast(numbers), "_id").drop("_id")  # a row a commit, of the list that the driver has

    def current(self, table: str, key: list[str]) -> DataFrame:
        """The rows of each key's last commit."""
        rows = self.table(table)
        last = rows.groupBy(*key).agg(F.max("commit").alias("commit"))
        return rows.join(last, [*key, "commit"])

    def merged(self, table: str, key: list[str]) -> DataFrame:
        """A row a key with the last value of each column that isn't null."""
        rows = self.table(table)
        rest = [c for c in rows.columns if c not in (*key, "commit")]
        return rows.groupBy(*key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("commit"))).alias(c) for c in rest], F.max("commit").alias("commit"))


class Store:
    """Tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put_if_absent(self, path: str, text: str) -> bool:
        """A file with the text, whole or not at all, unless there is one. Files of one machine are linked, others renamed: both fail if the name is taken."""
        fs, p = self._fs(path)
        fs.mkdirs(p.getParent())
        own = f"{path}.{uuid.uuid4().hex}.tmp"
        _, q = self._fs(own)
        stream = fs.create(q, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                try:
                    os.link(urlparse(own).path, urlparse(path).path)
                except FileExistsError:
                    return False
                return True
            return not fs.exists(p) and bool(fs.rename(q, p))
        finally:
            fs.delete(q, False)

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def view(self, version: int | None = None) -> View:
        """The tables as of a commit, the last one by default; version 0 has none."""
        known = self.versions()
        v = (known[-1] if known else 0) if version is None else version
        if not v:
            return View(self, {"version": 0, "tables": {}, "meta": {}})
        return View(self, json.loads(self._text(f"{self.root}/manifests/{v:012d}.json")))

    def commit(self, change: Callable[[View], tuple[dict[str, DataFrame], dict] | None]) -> View:
        """Rows for tables and changes of the meta data, all of them or none.

        ``change`` gets the last commit's view and says what to add, or None
        for nothing. It is asked again whenever another writer was first, so it
        may only go by the view. A None in the meta data takes a key away.
        """
        for _ in range(ATTEMPTS):
            now = self.view()
            wanted = change(now)
            if wanted is None:
                return now
            tables, meta = wanted
            version = now.version + 1
            listed = {k: list(v) for k, v in now.manifest["tables"].items()}
            for name, rows in tables.items():
                own = uuid.uuid4().hex
                rows.write.parquet(f"{self.root}/data/{name}/_id={own}")
                listed.setdefault(name, []).append({"id": own, "commit": version})
            kept = {k: v for k, v in (now.meta | meta).items() if v is not None}
            manifest = {"version": version, "created_at": datetime.now(timezone.utc).isoformat(), "tables": listed, "meta": kept}
            if self._put_if_absent(f"{self.root}/manifests/{version:012d}.json", encode(manifest)):
                return View(self, manifest)
        raise RuntimeError(f"{ATTEMPTS} other writers were first")

    def import_reviews(self, labels: DataFrame, digests: dict[str, str] | None = None) -> View:
        """Labels (run, signature, track_id, label) of any number of runs as one batch each, all or none.

        Checked before anything is written: no null, labels 0 or 1, a track
        once. digests: of the file each run's labels were exported to before,
        so that an export that was cut off doesn't undo this on the next ingest.
        """
        bad = labels.where("run IS NULL OR signature IS NULL OR track_id IS NULL OR label IS NULL OR label NOT IN (0, 1)")
        twice = labels.groupBy("run", "signature", "track_id").count().where("count > 1")
        if not bad.isEmpty() or not twice.isEmpty():
            raise ValueError("labels are 0 or 1, one for each track")
        files = {f"label_file:{k}": v for k, v in (digests or {}).items()}
        return self.commit(lambda now: ({"labels": labels}, files))

    def ingest(self, files: DataFrame) -> View:
        """Label files (run, signature, digest, labels array<struct<track_id, label>>): only those whose digest isn't the one last taken for the run add a batch.

        The same files again, or a retry, add nothing. An empty file is a
        batch without labels: it takes the labels away.
        """

        def change(now: View):
            new = files
            if now.has("label_files"):
                seen = now.current("label_files", ["run", "signature"]).select("run", "signature", "digest")
                new = files.join(seen, ["run", "signature", "digest"], "left_anti")
            if new.isEmpty():
                return None
            rows = new.select("run", "signature", F.explode_outer("labels").alias("l")).select("run", "signature", "l.track_id", "l.label")
            return {"labels": rows, "label_files": new.select("run", "signature", "digest")}, {}

        return self.commit(change)

    def reviews(self, now: View | None = None) -> DataFrame:
        """The labels of each run's last batch."""
        return (now or self.view()).current("labels", ["run", "signature"]).where("track_id IS NOT NULL").select("run", "signature", "track_id", "label")

    def save_snapshot(self, state: dict, tables: dict[str, DataFrame], fingerprint: str | None = None, model: DataFrame | None = None, update_state: bool = True) -> int:
        """State, model and tables as one snapshot; its number. One with the same digest, which leaves the volatile fields out, is not written again.

        model: fingerprint and whatever describes it; a later one fills what is still null.
        """
        stable = {k: v for k, v in state.items() if k not in VOLATILE}
        digest = hashlib.sha256(encode([stable, fingerprint, {k: content_digest(v) for k, v in sorted(tables.items())}]).encode()).hexdigest()
        chosen = []

        def change(now: View):
            known = now.meta.get("snapshots", {})
            number = known.get(digest) or len(known) + 1
            chosen[:] = [number]
            out = {} if digest in known else {k: v.withColumn("snapshot", F.lit(number).cast("long")) for k, v in tables.items()}
            if model is not None:
                out["models"] = model
            meta = {"snapshots": known | {digest: number}, "latest_snapshot": number, "sync": {"status": "pending", "snapshot": number}}
            meta |= {f"snapshot:{number}": {"state": state, "fingerprint": fingerprint, "created_at": datetime.now(timezone.utc).isoformat()}} if digest not in known else {}
            return out, meta | ({"state": state} if update_state else {})

        self.commit(change)
        return chosen[0]

    def snapshot(self, tables: list[str]) -> dict:
        """The latest snapshot's tables with the state of now, all of one commit. An error without one, or if the state has other runs than the snapshot's."""
        now = self.view()
        number = now.meta.get("latest_snapshot")
        if number is None:
            raise ValueError("there is no snapshot yet")
        saved, state = now.meta[f"snapshot:{number}"], now.meta.get("state")
        if state is None or state.get("runs") != saved["state"].get("runs"):
            raise ValueError("the runs have changed since the snapshot")
        out = {t: now.table(t).where(F.col("snapshot") == number).drop("commit", "snapshot") for t in tables}
        return {"number": number, "state": state, "fingerprint": saved["fingerprint"], "tables": out}

    def models(self, now: View | None = None) -> DataFrame:
        """A row for each fingerprint."""
        return (now or self.view()).merged("models", ["fingerprint"])

    def sync_status(self, error: str | None = None) -> dict:
        """What the last export said; with an error (or an empty text for none) it is written down first."""
        if error is None:
            return self.view().meta.get("sync", {})
        at = datetime.now(timezone.utc).isoformat()
        return self.commit(lambda now: ({}, {"sync": {"status": "pending" if error else "synced", "error": error, "snapshot": now.meta.get("latest_snapshot"), "attempted_at": at}})).meta["sync"]

    def backup(self, to: str) -> None:
        """The last commit's tables as the first commit of a new folder; one that exists is refused."""
        target, q = self._fs(to)
        if target.exists(q):
            raise ValueError(f"{to} exists")
        now, other = self.view(), Store(self.spark, to)
        listed = {}
        for name, parts in now.manifest["tables"].items():
            for p in parts:
                self.spark.read.parquet(f"{self.root}/data/{name}/_id={p['id']}").write.parquet(f"{other.root}/data/{name}/_id={p['id']}")
            listed[name] = parts
        other._put_if_absent(f"{other.root}/manifests/{max(1, now.version):012d}.json", encode(now.manifest | {"version": max(1, now.version), "tables": listed}))


def with_history(models: DataFrame, weights: DataFrame) -> DataFrame:
    """The weights of every model with the commit it came by, first written first counted, in order of commit and rank."""
    first = Window.partitionBy("fingerprint", "feature_id").orderBy("commit")
    kept = weights.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "commit")
    return kept.join(models.select("fingerprint", F.col("commit").alias("model_commit")), "fingerprint")
