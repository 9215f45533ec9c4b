"""A table by key that keeps its versions: rows lie in buckets of a hash of the key, and an update writes only the buckets that it
touches, beside the old ones. Which folders make up a version is in its manifest, a table of one row for each bucket, written
last: a job that dies before leaves the version before it as it was. Of two writers that start from one version the second one
fails. Old versions stay readable until `vacuum`.

Rows without a key are left out. Of rows that repeat a key one stays, chosen by a hash of the row, so that the choice doesn't
depend on the order of reading. An empty table makes an empty store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a new store. A large table needs more, so that an update of few keys rewrites little.
BUCKETS = 64
MANIFEST = "version bigint, key string, buckets int, schema string, bucket int, folder string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions whose manifests are whole, ascending."""
    fs, at = _fs(spark, f"{path}/manifest")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[1]))


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key that isn't null."""
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), F.xxhash64(*rows.columns)).alias("_row"))
    return one.select("_row.*")


class Store:
    """One version of a store. `create` and `open` give the last one; `upsert` and `delete` return the next."""

    def __init__(self, spark: SparkSession, path: str, version: int, key: str, buckets: int, schema: StructType, folders: dict[int, str]) -> None:
        self.spark, self.path, self.version, self.key, self.buckets, self.schema, self.folders = spark, path, version, key, buckets, schema, folders

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> Store:
        """Writes a store anew. One that is there is replaced by a version of other rows."""
        last = _versions(rows.sparkSession, path)
        empty = cls(rows.sparkSession, path, last[-1] if last else 0, key, buckets, rows.schema, {})
        return empty._next(one_each(rows, key), [])

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        found = _versions(spark, path)
        if not found:
            raise FileNotFoundError(f"there is no store in {path}")
        # One row for each bucket that has rows, or one without a bucket.
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{found[-1]:08d}").collect()
        folders = {r.bucket: r.folder for r in rows if r.bucket is not None}
        return cls(spark, path, found[-1], rows[0].key, rows[0].buckets, StructType.fromJson(json.loads(rows[0].schema)), folders)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows, or those of some buckets."""
        at = [f"{self.path}/{self.folders[b]}/bucket={b}" for b in sorted(self.folders if buckets is None else self.folders.keys() & set(buckets))]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        return [r.b for r in keys.where(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect()]

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> Store:
        """The next version with rows (the store's columns) in it: by default they replace those of their keys; merge(old, new) may
        say otherwise."""
        new = one_each(rows.select(*self.schema.names), self.key)
        touched = self._touched(rows)
        old = self.read(touched)
        merged = merge(old, new) if merge else old.join(new.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(new)
        return self._next(merged, touched)

    def delete(self, keys: DataFrame) -> Store:
        """The next version without the rows of keys."""
        touched = self._touched(keys)
        return self._next(self.read(touched).join(keys.select(self.key), self.key, "left_anti"), touched)

    def _next(self, rows: DataFrame, touched: list[int]) -> Store:
        """Writes the rows of the touched buckets, then the manifest. Rebalancing splits a large bucket among tasks."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        rows.withColumn("bucket", self._bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, at = _fs(self.spark, f"{self.path}/{folder}")
        written = {int(n.partition("=")[2]): folder for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("bucket=")}
        kept = {b: f for b, f in self.folders.items() if b not in touched}
        out = Store(self.spark, self.path, self.version + 1, self.key, self.buckets, self.schema, kept | written)
        out._publish()
        return out

    def _publish(self) -> None:
        fixed = (self.version, self.key, self.buckets, self.schema.json())
        rows = [(*fixed, b, f) for b, f in sorted(self.folders.items())] or [(*fixed, None, None)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self.path}/manifest/{self.version:08d}")

    def vacuum(self) -> None:
        """Deletes what this version, the last one, doesn't use."""
        for folder, keep in ((self.path, {*self.folders.values(), "manifest"}), (f"{self.path}/manifest", {f"{self.version:08d}"})):
            fs, at = _fs(self.spark, folder)
            for s in fs.listStatus(at):
                if s.getPath().getName() not in keep:
                    fs.delete(s.getPath(), True)
