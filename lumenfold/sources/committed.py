"""A table of rows by key that is changed by commits.

Rows lie in hash buckets of their key. A change reads and writes the buckets it
touches and leaves the others' files as they are; a manifest, a small file with
the folder of each bucket, makes a version. It is created under the next number,
which only one writer can do; until then readers see the version before, and
whatever a writer left that did not get so far is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class CommittedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._to = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._to(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        folder = self._to(f"{self.path}/versions")
        names = [s.getPath().getName() for s in self._files.listStatus(folder)] if self._files.exists(folder) else []
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def _manifest(self, version: int) -> dict[str, str]:
        """Folder of each bucket that has rows."""
        if not version:
            return {}
        stream = self._files.open(self._to(f"{self.path}/versions/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict[str, str]) -> None:
        """Makes version, which no other may have made: the file is complete before it gets its name."""
        whole = self._to(f"{self.path}/versions/{uuid.uuid4().hex}.part")
        stream = self._files.create(whole, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        named = self._to(f"{self.path}/versions/{version}.json")
        if self._files.exists(named) or not self._files.rename(whole, named):
            self._files.delete(whole, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        return self._read(sorted(self._manifest(self.version() if version is None else version).values()))

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[str]:
        """The buckets of keys: at most as many as there are."""
        return [str(r.b) for r in keys.select(self._bucket(F.col(self.key)).alias("b")).distinct().collect()]

    def _replace(self, version: int, manifest: dict[str, str], touched: list[str], rows: DataFrame) -> int:
        """Writes rows as all that the touched buckets hold, and commits."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        marked = rows.select(*self.schema.names, self._bucket(F.col(self.key)).alias("_bucket"))
        marked.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(folder)
        made = self._to(folder)
        there = {s.getPath().getName().removeprefix("_bucket=") for s in self._files.listStatus(made) if s.isDirectory()}
        kept = {b: f for b, f in manifest.items() if b not in touched}
        self._commit(version + 1, kept | {b: f"{folder}/_bucket={b}" for b in there})
        return version + 1

    def upsert(self, new: DataFrame, order: str) -> int:
        """Puts the rows of new in place of those with their keys; of rows of new with one key the latest by order counts. The version made.

        Only buckets that new has keys of are read and written.
        """
        version = self.version()
        manifest, new = self._manifest(version), new.select(*self.schema.names)
        touched = self._touched(new)
        stored = self._read([manifest[b] for b in touched if b in manifest])
        both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
        last = Window.partitionBy(self.key).orderBy(F.desc("_new"), F.desc(order))
        return self._replace(version, manifest, touched, both.withColumn("_n", F.row_number().over(last)).where("_n = 1"))

    def delete(self, gone: DataFrame) -> int:
        """Removes the rows whose key is in gone. The version made."""
        version = self.version()
        manifest = self._manifest(version)
        touched = [b for b in self._touched(gone) if b in manifest]
        return self._replace(version, manifest, touched, self._read([manifest[b] for b in touched]).join(gone.select(self.key).distinct(), self.key, "left_anti"))

    def retain(self, most: int, order: str) -> int:
        """Removes all but the `most` latest rows by order, ties by key: of the buckets that hold a row to go, the rest is written anew. The version made."""
        latest = self.read().select(self.key, order).orderBy(F.desc(order), F.desc(self.key)).limit(most)
        return self.delete(self.read().select(self.key).join(latest.select(self.key), self.key, "left_anti"))

    def truncate(self) -> int:
        """Removes all rows. The version made."""
        version = self.version()
        self._commit(version + 1, {})
        return version + 1

    def vacuum(self) -> int:
        """Deletes the folders of data that the last version doesn't use, of older versions and of writers that never committed; how many. For times without writers."""
        used = {f.rpartition("/")[0].rpartition("/")[2] for f in self._manifest(self.version()).values()}
        data = self._to(f"{self.path}/data")
        unused = [s.getPath() for s in self._files.listStatus(data) if s.getPath().getName() not in used] if self._files.exists(data) else []
        for folder in unused:
            self._files.delete(folder, True)
        return len(unused)
