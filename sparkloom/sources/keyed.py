"""Keyed tables that last: rows dealt to buckets by the hash of their key, changed by merges that rewrite the touched buckets only.

A version of a table is a manifest, a small JSON file that names the folder of each bucket. A change writes new folders beside the old ones and
then the next manifest, by a rename that fails if there is one of that number: so readers see the old version or the new one, and
a writer that dies before the rename has changed nothing. A writer that finds the number taken looks at what the other one touched: with other
buckets, its own folders hold and only the manifest is written anew; else it merges again, into the new version.

Merges are Spark jobs over the touched buckets; the driver handles bucket numbers and folder names. `vacuum` removes what no kept version names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.operators import relational as rel

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Other writers were first each time."""


class Files:
    """The few calls on Hadoop's file systems that manifests need."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def write_new(self, name: str, text: str) -> bool:
        """Whether the file was made; False if there is one already."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self.path(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(self.fs.makeQualified(self.path(draft)), self.fs.makeQualified(self.path(name)), self.gateway.new_array(kind, 0))
            return True
        except Py4JJavaError as e:
            self.delete(draft)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise


@dataclass(frozen=True)
class Manifest:
    """version; folders: bucket -> folder under data/ (none: an empty bucket); fills: column -> value that stands for null in rows older than the column."""

    version: int
    key: list[str]
    n: int
    schema: dict
    folders: dict[str, str] = field(default_factory=dict)
    fills: dict[str, object] = field(default_factory=dict)
    applied: list[str] = field(default_factory=list)


class KeyedTable:
    """One row for each key. Every change returns how many buckets it wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root, self.files = spark, path.rstrip("/"), Files(spark, path)

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int) -> KeyedTable:
        """The table at `path`, made empty if there is none (SNK14); one that is there stays as it is."""
        table = cls(spark, path)
        table._commit(Manifest(0, key, buckets, json.loads(schema.json())))
        return table

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in self.files.names(f"{self.root}/manifests") if x.endswith(".json")]

    def manifest(self, version: int | None = None) -> Manifest:
        version = max(self.versions()) if version is None else version
        return Manifest(**json.loads(self.files.read(f"{self.root}/manifests/{version:020d}.json")))

    def _commit(self, m: Manifest) -> bool:
        return self.files.write_new(f"{self.root}/manifests/{m.version:020d}.json", json.dumps(m.__dict__))

    def read(self, version: int | None = None, buckets: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some of its buckets: only their folders are listed and scanned."""
        m = manifest or self.manifest(version)
        schema = StructType.fromJson(m.schema)
        folders = [f"{self.root}/data/{f}" for b, f in m.folders.items() if buckets is None or int(b) in buckets]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in m.fills.items()}) if m.fills else rows

    def lookup(self, *key) -> DataFrame:
        """The row of a key: one bucket is read (SRC13)."""
        m = self.manifest()
        types = StructType.fromJson(m.schema)
        given = [F.lit(v).cast(types[k].dataType) for k, v in zip(m.key, key)]
        bucket = self.spark.range(1).select(F.pmod(F.hash(*given), F.lit(m.n)).alias("b")).first()["b"]
        rows = self.read(buckets=[bucket], manifest=m)
        for k, v in zip(m.key, given):
            rows = rows.filter(F.col(k).eqNullSafe(v))
        return rows

    def _bucket(self, m: Manifest) -> Column:
        return F.pmod(F.hash(*m.key), F.lit(m.n))

    def change(self, touched: Callable[[Manifest], list[int]], make: Callable[[Manifest, DataFrame], DataFrame], tries: int = 10) -> int:
        """Replaces buckets: `touched` names them, `make` gives all their new rows from the old ones (rows of other buckets are not taken)."""
        m = self.manifest()
        for _ in range(tries):
            buckets = touched(m)
            if not buckets:
                return 0
            folder = uuid.uuid4().hex
            rows = make(m, self.read(buckets=buckets, manifest=m)).withColumn(BUCKET, self._bucket(m)).filter(F.col(BUCKET).isin(buckets))
            rows.repartition(min(len(buckets), 10_000), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
            written = {x.split("=")[1] for x in self.files.names(f"{self.root}/data/{folder}") if "=" in x}
            base = m
            while True:
                kept = {b: f for b, f in m.folders.items() if int(b) not in buckets}
                if self._commit(replace(m, version=m.version + 1, folders=kept | {b: f"{folder}/{BUCKET}={b}" for b in written})):
                    return len(buckets)
                m = self.manifest()
                if m.schema != base.schema or m.n != base.n or any(m.folders.get(str(b)) != base.folders.get(str(b)) for b in buckets):
                    break  # the other writer changed what this one read
            self.files.delete(f"{self.root}/data/{folder}")
        raise Conflict(f"{self.root}: {tries} tries")

    def _of(self, m: Manifest, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(self._bucket(m).alias("b")).distinct().collect()]  # at most n

    def merge(self, new: DataFrame, update: list[str], set_on_update: dict[str, Column] | None = None) -> int:
        """Upsert: rows of new keys go in, of known ones the `update` columns are taken (SNK3, SNK4, SNK9). See `relational.upsert`."""
        return self.change(lambda m: self._of(m, new), lambda m, old: rel.upsert(old, self._full(m, new), m.key, update, set_on_update))

    def insert_absent(self, new: DataFrame) -> int:
        """(SNK1, SNK2)"""
        def fresh(m):
            return self._full(m, new).join(self.read(manifest=m, buckets=self._of(m, new)).select(*m.key), m.key, "left_anti")

        return self.change(lambda m: self._of(m, fresh(m)), lambda m, old: rel.insert_absent(old, self._full(m, new).select(*old.columns), m.key))

    def update_where(self, condition: Column, values: dict[str, Column]) -> int:
        """Only buckets with a row that meets the condition are rewritten (SNK5)."""
        return self.change(lambda m: self._of(m, self.read(manifest=m).filter(condition)), lambda m, old: rel.update_where(old, condition, values))

    def delete(self, keys: DataFrame) -> int:
        """(SNK10)"""
        def there(m):
            return keys.join(self.read(manifest=m, buckets=self._of(m, keys)).select(*m.key), m.key, "left_semi")

        return self.change(lambda m: self._of(m, there(m)), lambda m, old: rel.delete_keys(old, keys, m.key))

    def _full(self, m: Manifest, new: DataFrame) -> DataFrame:
        """New rows with all columns and types of the table."""
        missing = [f for f in StructType.fromJson(m.schema) if f.name not in new.columns]
        return new.withColumns({f.name: F.lit(m.fills.get(f.name)).cast(f.dataType) for f in missing}) if missing else new

    def migrate(self, name: str, columns: str, fills: dict[str, object] | None = None) -> bool:
        """Add columns (DDL) once; whether this call did it. No file is rewritten: older rows have the fill, or null (SRC19, SNK14)."""
        while True:
            m = self.manifest()
            if name in m.applied:
                return False
            held = StructType.fromJson(m.schema)
            more = [f for f in StructType.fromDDL(columns) if f.name not in held.names]
            schema = StructType([*held.fields, *more])
            given = {k: v for k, v in (fills or {}).items() if k in {f.name for f in more}}
            if self._commit(replace(m, version=m.version + 1, schema=json.loads(schema.json()), fills=m.fills | given, applied=[*m.applied, name])):
                return True

    def vacuum(self, keep: int = 1) -> int:
        """Removes all versions but the last `keep`, and folders that none of these names. Not for use while a writer is at work. Returns the folders removed."""
        versions = self.versions()
        held = {f.split("/")[0] for v in versions[-keep:] for f in self.manifest(v).folders.values()}
        for v in versions[:-keep]:
            self.files.delete(f"{self.root}/manifests/{v:020d}.json")
        gone = [f for f in self.files.names(f"{self.root}/data") if f not in held]
        for f in gone:
            self.files.delete(f"{self.root}/data/{f}")
        return len(gone)
