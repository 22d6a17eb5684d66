"""A snapshot on disk that is rewritten by parts: what a batch writes follows the batch, not the snapshot.

Rows lie in buckets of their key's hash, and a bucket in versions, named by the batch that wrote it:
``rows/v=<batch>/bucket=<n>``. A manifest per batch names the version of every bucket; it is written last, so
a batch without one never happened, and a batch that is retried reads the manifest before its own again
and replaces only its own partitions. The manifests of the last two batches and what they name stay on disk.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Number of parts; it bounds the manifest and the list of parts that a batch touches.
BUCKETS = 256
_MANIFEST = "bucket int, version long"


class BucketedSnapshot:
    """Rows of one schema by key; `start` is what the first batch builds on."""

    def __init__(self, path: str, start: DataFrame, key: str = "slug", buckets: int = BUCKETS) -> None:
        self.path, self.start, self.key, self.buckets = path, start, key, buckets
        self.spark: SparkSession = start.sparkSession

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: at most as many numbers as there are buckets."""
        return sorted(r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def _folder(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str, prefix: str) -> list[int]:
        system, path = self._folder(name)
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))

    def versions(self) -> list[int]:
        """Batches whose manifest is on disk."""
        done = [v for v in self._numbers("manifest", "v=")]
        system, _ = self._folder("manifest")
        return [v for v in done if system.exists(self._folder(f"manifest/v={v}/_SUCCESS")[1])]

    def manifest(self, version: int) -> dict[int, int]:
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/v={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def rows(self, manifest: dict[int, int], only: Iterable[int] | None = None) -> DataFrame:
        """Rows of the buckets, or of some of them; other partitions are not read."""
        names = [f"{self.path}/rows/v={v}/bucket={b}" for b, v in manifest.items() if only is None or b in set(only)]
        if not names:
            return self.start.limit(0)
        return self.spark.read.schema(self.start.schema).parquet(*names)

    def before(self, batch_id: int) -> dict[int, int]:
        """The manifest that a batch builds on; the rows of `start` are written as batch -1 first."""
        done = [v for v in self.versions() if v < batch_id]
        if not done:
            self._write(-1, self.start, self.touched(self.start), {})
            done = [-1]
        return self.manifest(done[-1])

    def latest(self) -> DataFrame:
        """The rows that the last batch left."""
        done = self.versions()
        return self.rows(self.manifest(done[-1])) if done else self.start

    def replace(self, batch_id: int, rows: DataFrame, touched: list[int]) -> None:
        """Make `rows` the rows of the touched buckets; all others keep their version."""
        self._write(batch_id, rows, touched, self.before(batch_id))

    def _write(self, batch_id: int, rows: DataFrame, touched: list[int], previous: dict[int, int]) -> None:
        placed = rows.select(*self.start.columns, F.lit(batch_id).cast("long").alias("v"), self.bucket().alias("bucket"))
        if touched:
            dealt = placed.repartition(max(1, len(touched)), "bucket")
            dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("v", "bucket").parquet(f"{self.path}/rows")
        # A bucket whose rows are all gone has no partition and leaves the manifest.
        written = set(self._numbers(f"rows/v={batch_id}", "bucket=")) & set(touched)
        entries = {b: v for b, v in previous.items() if b not in set(touched)} | {b: batch_id for b in written}
        frame = self.spark.createDataFrame(sorted(entries.items()), _MANIFEST)
        frame.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={batch_id}")
        self._forget(batch_id, entries, previous)

    def _forget(self, batch_id: int, entries: dict[int, int], previous: dict[int, int]) -> None:
        """Delete manifests before the last one, and partitions that neither it nor the new one names."""
        older = [v for v in self.versions() if v < batch_id][:-1]
        kept = set(entries.items()) | set(previous.items())
        for version in older:
            for b, v in set(self.manifest(version).items()) - kept:
                system, path = self._folder(f"rows/v={v}/bucket={b}")
                system.delete(path, True)
            system, path = self._folder(f"manifest/v={version}")
            system.delete(path, True)

    def delete(self, batch_id: int, keys: DataFrame) -> None:
        """Remove the rows of the keys; only their buckets are rewritten."""
        gone = keys.select(self.key).distinct()
        touched = self.touched(gone)
        held = self.rows(self.before(batch_id), touched)
        self.replace(batch_id, held.join(gone, self.key, "left_anti"), touched)


def cascade_delete_stored(stores: Iterable[BucketedSnapshot], batch_id: int, keys: DataFrame) -> None:
    """Remove entities from every stored table; untouched parts of each stay as they are."""
    for store in stores:
        store.delete(batch_id, keys)
