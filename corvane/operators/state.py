"""Tables that are written in versions: Parquet files in buckets of keys, and a numbered manifest that names the current ones."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.schemas import STATE


class Conflict(Exception):
    """Another writer has made the version that this one was about to make; read again and repeat."""


class Snapshots:
    """A table under ``path``, of schema ``schema``, in ``buckets`` parts by the hash of ``key``.

    A change rewrites the buckets that its keys are in and no others. Each version is a manifest, a small file whose
    name is its number and which is created only if no other writer has made it before (else ``Conflict``), so that
    readers see one version or the other and no write is lost. Files that none of the last ``keep`` manifests names are
    deleted once they are ``grace`` seconds old, so that running readers end in peace. Choose ``buckets`` at the first
    write so that one holds about a gigabyte. Works on every file system that Spark writes to and that creates files
    exclusively.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = STATE, key: str = "page_id", buckets: int = 8, order: tuple[str, ...] = (), keep: int = 2, grace: float = 3600.0) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets, self.order, self.keep, self.grace = spark, path.rstrip("/"), schema, key, buckets, order, keep, grace

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list:
        fs, p = self._fs(path)
        return list(fs.listStatus(p)) if fs.exists(p) else []

    def _numbers(self) -> list[int]:
        return sorted(int(f.getPath().getName()) for f in self._list(f"{self.path}/manifests") if f.getPath().getName().isdigit())

    def versions(self) -> list[str]:
        """Names of the versions that can be read, in the order they were made; the last is current."""
        return [f"{n:09d}" for n in self._numbers()[-self.keep :]]

    def _manifest(self, number: int) -> dict:
        fs, p = self._fs(f"{self.path}/manifests/{number:09d}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _current(self, writing: bool = False) -> tuple[int, dict]:
        """Number of the last version and its manifest. One that is being made right now is none yet to readers, and a conflict to writers."""
        numbers = self._numbers()
        for n in reversed(numbers):
            try:
                return numbers[-1], self._manifest(n)
            except ValueError:
                if writing:
                    raise Conflict(f"version {n} of {self.path}") from None
        return (numbers[-1] if numbers else 0), {"buckets": self.buckets, "files": {}}

    def create(self) -> None:
        """An empty first version, unless there is one."""
        if not self._numbers():
            self._commit(0, {"buckets": self.buckets, "files": {}})

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self) -> DataFrame:
        return self._read(sorted(self._current()[1]["files"].values()))

    def _commit(self, number: int, manifest: dict) -> None:
        """Make version number + 1, unless somebody has."""
        fs, p = self._fs(f"{self.path}/manifests/{number + 1:09d}")
        try:
            out = fs.create(p, False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                raise Conflict(f"version {number + 1} of {self.path}") from error
            raise
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._clean()

    def _clean(self) -> None:
        numbers = self._numbers()
        kept = numbers[-self.keep :]
        try:
            named = {f.split("/")[0] for n in kept for f in self._manifest(n)["files"].values()}
        except ValueError:  # the next writer is at work, and cleans up later
            return
        old = (time.time() - self.grace) * 1000
        fs, _ = self._fs(self.path)
        for f in self._list(self.path):
            if f.getPath().getName().startswith("data-") and f.getPath().getName() not in named and f.getModificationTime() < old:
                fs.delete(f.getPath(), True)
        for f in self._list(f"{self.path}/manifests"):
            if f.getPath().getName().isdigit() and int(f.getPath().getName()) not in kept and f.getModificationTime() < old:
                fs.delete(f.getPath(), False)

    def _written(self, df: DataFrame, buckets: int) -> dict[str, str]:
        """Write rows by bucket: the folder of each bucket that has any."""
        folder = f"data-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        dealt = df.select(*columns).withColumn("_bucket", self._bucket(buckets)).repartition("_bucket").sortWithinPartitions("_bucket", *self.order)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = (f.getPath().getName() for f in self._list(f"{self.path}/{folder}"))
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def write(self, df: DataFrame) -> None:
        """The whole table anew."""
        number, _ = self._current(writing=True)
        self._commit(number, {"buckets": self.buckets, "files": self._written(df, self.buckets)})

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> None:
        """Take the rows of ``keys`` out and put ``rows`` in, whose keys are among them. Without keys nothing is written."""
        number, manifest = self._current(writing=True)
        n = manifest["buckets"]
        touched = sorted(str(r[0]) for r in keys.select(self._bucket(n)).distinct().collect())  # n numbers at most
        if not touched:
            return
        files = dict(manifest["files"])
        old = self._read([files[b] for b in touched if b in files])
        left = deleted(old, keys, self.key)
        made = self._written(left if rows is None else left.unionByName(rows.select(*old.columns)), n)
        self._commit(number, {"buckets": n, "files": {b: f for b, f in files.items() if b not in touched} | made})


def upserted(state: DataFrame, rows: DataFrame, key: str = "page_id") -> DataFrame:
    """The state with the rows in place of those of the same key."""
    return state.join(rows.select(key), key, "left_anti").unionByName(rows.select(*state.columns))


def deleted(state: DataFrame, keys: DataFrame, key: str = "page_id") -> DataFrame:
    return state.join(keys.select(key), key, "left_anti")


def page_ids(state: DataFrame, spaces: list[str] | None = None) -> DataFrame:
    """All ids, or those of some spaces; of no space, none."""
    return (state if spaces is None else state.where(F.col("space_key").isin(spaces))).select("page_id")
