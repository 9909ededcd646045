"""Snapshots that are synchronised by buckets: a sync writes the buckets in which something changed and keeps the files of all others.

A snapshot is a folder of buckets by the hash of the key, and a numbered manifest that names the files of each bucket.  A sync compares the
stored rows with those that are there now; what is new or different is active, what is gone stays with active 0.  Only changed rows, and the rows of
their buckets, are written; the next manifest then points to them.  Readers of an older manifest keep reading what it names, and two syncs from the
same version cannot both succeed.

Defined cases: keys are unique and not null, rows with a null key are left out; null values are equal to each other; a sync without changes writes no bucket;
an empty snapshot has no rows; a row that was gone comes back as reactivated.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators.gates import GateError
from quarrystone.sources.packages import Store
from quarrystone.sources.scratch import kept

BUCKETS = 256


class SnapshotStore:
    def __init__(self, spark: SparkSession, folder: str, key: str, key_type: str, payload: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.payload, self.buckets = spark, folder.rstrip("/"), key, list(payload), buckets
        self.schema = ", ".join([f"`{key}` {key_type}", *(f"`{c}` {t}" for c, t in payload.items()), "active int"])
        self.store = Store(spark, folder)
        self.version, self.files = 0, {}
        self.refresh()

    def refresh(self) -> None:
        """Takes over the last manifest."""
        folder = f"{self.folder}/manifest"
        names = [int(n.rsplit("/", 1)[1]) for n in self.store.names(folder)] if self.store.exists(folder) else []
        self.version = max(names, default=0)
        self.files = {}
        if self.version:
            found = json.loads(self.store.read(f"{folder}/{self.version:09d}").decode())
            if found["schema"] != self.schema or found["buckets"] != self.buckets:
                raise GateError("SNAPSHOT_LAYOUT_DIFFERS")
            self.files = {int(b): path for b, path in found["files"].items()}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [path for b, path in sorted(self.files.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def rows(self) -> DataFrame:
        """The key, the values and active of all rows of the snapshot."""
        return self._rows()

    def sync(self, current: DataFrame) -> DataFrame:
        """Makes the snapshot follow the rows that are there now; returns what changed: key, values, active, change."""
        self.refresh()
        now = current.filter(F.col(self.key).isNotNull()).select(self.key, *self.payload)
        o, n = self._rows().alias("o"), now.alias("n")
        here, there = F.col(f"n.{self.key}").isNotNull(), F.col(f"o.{self.key}").isNotNull()
        same = reduce(Column.__and__, [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in self.payload], F.lit(True))
        was = F.col("o.active") == 1
        change = F.when(~there, "added").when(~here & was, "deactivated").when(here & ~was, "reactivated").when(here & ~same, "updated")
        values = [F.when(here, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in self.payload]
        both = o.join(n, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full")
        changes = kept(both.select(F.coalesce(f"n.{self.key}", f"o.{self.key}").alias(self.key), *values, here.cast("int").alias("active"), change.alias("change")).filter("change IS NOT NULL"), "snapshot-changes")

        touched = [b for (b,) in changes.select(self._bucket()).distinct().collect()]  # as many as there are buckets at most
        if touched:
            path = f"{self.folder}/data/{self.version + 1:09d}-{uuid.uuid4().hex}"
            left = self._rows(touched).join(changes.select(self.key), self.key, "left_anti")
            renewed = left.unionByName(changes.drop("change")).withColumn("bucket", self._bucket())
            renewed.repartition("bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
            files = self.files | {b: f"{path}/bucket={b}" for b in touched}
            body = {"schema": self.schema, "buckets": self.buckets, "files": files}
            try:
                self.store.write(f"{self.folder}/manifest/{self.version + 1:09d}", iter([json.dumps(body).encode()]))
            except Exception as error:
                raise GateError("SNAPSHOT_CHANGED_MEANWHILE") from error
            self.version, self.files = self.version + 1, files
        return changes
