"""A set of tables on a file system, changed by one commit at a time.

Rows of a table lie in a fixed number of buckets, by a hash of its key; a bucket is one folder that is never changed. A transaction writes new folders for the
buckets that its changes touch, of any of the tables, and then one manifest: which folder holds each bucket. The manifest gets its final name by a rename that
fails if the name is taken. So readers see all of a transaction or nothing of it, two writers cannot both win, and a writer that dies before the rename leaves folders
that no manifest names; `expire` removes these, and what only old versions need.

Bytes written depend on the buckets touched, not on the table. The driver holds a manifest: one path for each bucket of each table. A table's number of buckets should make a bucket
fit into a task (a few hundred megabytes).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliomill.sources.scratch import saved


class Conflict(Exception):
    """Another writer has committed since the transaction began."""


@dataclass(frozen=True)
class Table:
    """A key (columns), and which of the columns refer to another table: {column: (table, column)}. Rows go when what they refer to goes."""

    name: str
    schema: StructType
    key: tuple[str, ...]
    buckets: int = 16
    references: dict[str, tuple[str, str]] = field(default_factory=dict)


class TableSet:
    def __init__(self, spark: SparkSession, path: str, tables: list[Table]) -> None:
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {t.name: t for t in tables}

    # --- files

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> dict[str, int]:
        """Entries of a folder with their times of change, in milliseconds."""
        path, fs = self._hadoop(folder)
        return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(path)} if fs.exists(path) else {}

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        """Of the given version, else of the last one; an empty one if there is none yet."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "tables": {}, "streams": {}}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{(version or known[-1]):012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        jvm, version = self.spark._jvm, manifest["version"]
        draft, fs = self._hadoop(f"manifests/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        final, _ = self._hadoop(f"manifests/{version:012d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(fs.makeQualified(draft), fs.makeQualified(final), options)
        except Py4JJavaError as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} exists") from None
            raise

    def expire(self, keep: int = 1, older_than_ms: int = 3_600_000) -> list[str]:
        """Remove all but the last `keep` manifests and folders that none of them names; the folders removed.

        Folders younger than older_than_ms stay: they may belong to a transaction that goes on.
        """
        known = self.versions()
        named = {p for v in known[-keep:] for t in self.manifest(v)["tables"].values() for p in t["buckets"].values()}
        for v in known[:-keep]:
            path, fs = self._hadoop(f"manifests/{v:012d}.json")
            fs.delete(path, False)
        now, removed = self.spark._jvm.java.lang.System.currentTimeMillis(), []
        for name in self._names("data"):
            for write, changed in self._names(f"data/{name}").items():
                if now - changed < older_than_ms:
                    continue
                for bucket in [b for b in self._names(f"data/{name}/{write}") if b.startswith("__bucket=")]:
                    folder = f"data/{name}/{write}/{bucket}"
                    if folder not in named:
                        path, fs = self._hadoop(folder)
                        fs.delete(path, True)
                        removed.append(folder)
        return removed

    # --- rows

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """All rows of a table, or those of some buckets."""
        held = (manifest or self.manifest(version))["tables"].get(name, {"buckets": {}})["buckets"]
        paths = [f"{self.path}/{p}" for b, p in sorted(held.items()) if buckets is None or int(b) in buckets]
        schema = self.tables[name].schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def bucket(self, name: str) -> Column:
        """The bucket of a row of a table, from its key."""
        table = self.tables[name]
        return F.pmod(F.xxhash64(*[F.col(k) for k in table.key]), F.lit(table.buckets)).cast("int")

    def transaction(self, stream: str | None = None, epoch: int | None = None) -> Transaction:
        """Changes that become visible together. With a stream's name and epoch, an epoch that is committed already changes nothing."""
        return Transaction(self, stream, epoch)


class Transaction:
    """Use as a context: leaving it commits, an error inside leaves the tables as they were."""

    def __init__(self, store: TableSet, stream: str | None, epoch: int | None) -> None:
        self.store, self.stream, self.epoch = store, stream, epoch
        self.manifest = store.manifest()
        self.done = stream is not None and self.manifest["streams"].get(stream, -1) >= epoch
        self.written: list[str] = []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.commit()

    def commit(self) -> int:
        if not self.done:
            streams = self.manifest["streams"] | ({self.stream: self.epoch} if self.stream else {})
            self.store._publish(self.manifest | {"version": self.manifest["version"] + 1, "streams": streams})
            self.done = True
        return self.manifest["version"] + 1

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """Rows as this transaction has left them so far."""
        return self.store.read(name, buckets=buckets, manifest=self.manifest)

    def _write(self, table: Table, rows: DataFrame) -> dict[int, str]:
        """Write rows (with __bucket) to folders of their own, by bucket."""
        write = f"data/{table.name}/{uuid.uuid4().hex}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema]
        rows.select("__bucket", *columns).write.partitionBy("__bucket").parquet(f"{self.store.path}/{write}")
        found = {int(n.split("=")[1]): f"{write}/{n}" for n in self.store._names(write) if n.startswith("__bucket=")}
        self.written += found.values()
        return found

    def _replace(self, table: Table, touched: list[int], folders: dict[int, str]) -> None:
        """Let the buckets touched be these folders; one without a folder is empty."""
        held = self.manifest["tables"].get(table.name, {"buckets": {}})["buckets"]
        kept = {b: p for b, p in held.items() if int(b) not in touched}
        self.manifest = self.manifest | {"tables": self.manifest["tables"] | {table.name: {"buckets": kept | {str(b): p for b, p in folders.items()}}}}

    def upsert(self, name: str, rows: DataFrame, version: str | None = None) -> None:
        """One row a key: new ones win over old ones, among new ones the highest version, then the one whose other columns sort last.

        Columns that rows lack are null. Rows with a null in their key are kept like others. The rows are computed once: their choice is written by bucket, and only
        buckets that held something before are read, merged and written again.
        """
        if self.done:
            return
        table = self.store.tables[name]
        have, columns = set(rows.columns), [f.name for f in table.schema]
        new = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema])
        order = [*([F.desc(version)] if version else []), F.desc(F.struct(*columns))]

        def chosen(df: DataFrame, rank: list[Column]) -> DataFrame:
            """One exchange, by bucket, serves the choice and the files."""
            dealt = df.withColumn("__bucket", self.store.bucket(table.name)).repartition(table.buckets, "__bucket")
            return dealt.withColumn("__r", F.row_number().over(W.partitionBy("__bucket", *table.key).orderBy(*rank))).where("__r = 1")

        folders = self._write(table, chosen(new, order))
        held = self.manifest["tables"].get(name, {"buckets": {}})["buckets"]
        if both := [b for b in folders if str(b) in held]:
            staged = self.store.spark.read.schema(table.schema).parquet(*[f"{self.store.path}/{folders[b]}" for b in both])
            merged = self.read(name, both).withColumn("__new", F.lit(0)).unionByName(staged.withColumn("__new", F.lit(1)))
            whole = self._write(table, chosen(merged, [F.desc("__new")]))
            for b in both:
                path, fs = self.store._hadoop(folders[b])
                fs.delete(path, True)
                self.written.remove(folders[b])
            folders |= whole
        self._replace(table, list(folders), folders)

    def delete(self, name: str, gone: DataFrame, on: list[str] | None = None, spare: tuple[str, ...] = ()) -> None:
        """Remove rows that agree with `gone` in the columns `on` (the key, if not given), and all that refers to them, but for tables to spare."""
        if self.done:
            return
        table = self.store.tables[name]
        on = on or list(table.key)
        wanted = gone.select(*on).distinct()
        hit = self.read(name).join(wanted, on, "left_semi").withColumn("__bucket", self.store.bucket(table.name))
        # Referring rows go first, while the rows that they refer to can still be read.
        for child in self.store.tables.values():
            for column, (parent, target) in child.references.items():
                if parent == name and child.name not in spare:
                    self.delete(child.name, hit.select(F.col(target).alias(column)), [column], spare)
        # Only keys are joined; whole rows are exchanged once, by bucket, beside the keys that go.
        own = list(dict.fromkeys(table.key))
        keys = saved(hit.select("__bucket", *own), f"{self.store.path}/gone", uuid.uuid4().hex)
        touched = [r[0] for r in keys.select("__bucket").distinct().collect()]
        if touched:
            rows = self.read(name, touched).withColumns({"__bucket": self.store.bucket(table.name), "__gone": F.lit(0)})
            dealt = rows.unionByName(keys.withColumn("__gone", F.lit(1)), allowMissingColumns=True).repartition(len(touched), "__bucket")
            left = dealt.withColumn("__gone", F.max("__gone").over(W.partitionBy("__bucket", *own))).where("__gone = 0")
            self._replace(table, touched, self._write(table, left))
