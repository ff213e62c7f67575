"""Keyed outputs that survive interruption (K5, K9, K12): finished keys are known by a manifest, committed atomically.

Rows of a batch are written as Parquet, clustered by a hash of their key so that a task writes few files whatever the
number of keys. The batch counts only once the next version of the manifest, a small file that lists the live batches,
has been renamed into place; what an interrupted write leaves behind is never read and goes with the next write.
Writing again writes only rows whose key no live batch holds. ``compact`` rewrites all live batches as one and
then removes the old ones.

It needs a file system whose rename fails where the target exists; of two writers that commit the same version
one fails, and nothing of it is seen. Defined results: null key columns are a key of their own; rows of one
key must come in one batch; an empty batch commits nothing; an output that was never written has no rows."""
from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 2_000_000


class ResumableOutput:
    """A folder of batches with a manifest; ``schema`` is that of the rows, ``keys`` name the key columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.schema = spark.createDataFrame([], schema).schema
        self._jvm = spark.sparkContext._jvm
        self._fs = self._file(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _file(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._file(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """Number of the newest manifest, 0 if there is none."""
        return max([int(n[1:].split(".")[0]) for n in self._names("manifest") if n.startswith("v")], default=0)

    def batches(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if not version:
            return []
        line = self.spark.read.text(f"{self.path}/manifest/v{version:08d}.json", wholetext=True).first()["value"]
        return json.loads(line)["batches"]

    def _commit(self, version: int, batches: list[str]) -> None:
        draft = self._file(f"{self.path}/manifest/draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(json.dumps({"batches": batches}).encode())
        out.close()
        if self._fs.exists(self._file(f"{self.path}/manifest/v{version:08d}.json")) or not self._fs.rename(draft, self._file(f"{self.path}/manifest/v{version:08d}.json")):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer committed version {version}")

    def _clean(self, live: list[str]) -> None:
        for name in set(self._names("data")) - set(live):
            self._fs.delete(self._file(f"{self.path}/data/{name}"), True)

    def read(self) -> DataFrame:
        """Rows of the live batches."""
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{b}") for b in self.batches()]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], self.schema)

    def _same_key(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in self.keys])

    def pending(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not finished."""
        if not self.batches():
            return rows
        done = self.read().select(*[F.col(k).alias(f"_{k}") for k in self.keys]).distinct()
        return rows.join(done, self._same_key(rows, done), "left_anti")

    def _write_batch(self, rows: DataFrame) -> str:
        name = f"b{uuid.uuid4().hex[:16]}"
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        files = F.pmod(F.xxhash64(*self.keys), F.lit(1 << 20))
        rows.repartitionByRange(files, *self.keys).sortWithinPartitions(*self.keys).write.option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{self.path}/data/{name}")
        return name

    def write(self, rows: DataFrame) -> int:
        """Write the pending rows as one batch; the number of rows that became live."""
        version = self.version()
        live = self.batches(version)
        self._clean(live)
        name = self._write_batch(self.pending(rows))
        n = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{name}").count()
        if n:
            self._commit(version + 1, [*live, name])
        return n

    def compact(self) -> None:
        """All live batches as one; old batches are removed once the new manifest stands."""
        version = self.version()
        if len(self.batches(version)) > 1:
            name = self._write_batch(self.read())
            self._commit(version + 1, [name])
            self._clean([name])
