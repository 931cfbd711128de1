"""A table of keyed rows in buckets, merged batch by batch; a batch rewrites the buckets that its keys fall into and no others.

Layout below one folder: data/batch=B/bucket=K holds bucket K as batch B left it, manifest/batch=B says for every bucket which batch wrote it
last. A batch reads the manifest of the batch before it, writes its buckets beside the old ones and then its manifest, so readers see a batch
whole or not at all, and running one again starts from the same rows and gives the same table. Any store that Spark reaches will do.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """The table in `folder`, its rows dealt by a hash of `keys` into a number of buckets that is fixed by its first batch."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.keys, self.buckets = spark, folder.rstrip("/"), keys, buckets

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole, in order."""
        path = self._path("manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        found = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(self._path("manifest", p.getName(), "_SUCCESS")))

    def manifest(self, batch: int) -> tuple[dict[int, int], StructType | None]:
        """Which batch wrote each bucket last, as of a batch, and the columns of the table then."""
        rows = self.spark.read.schema("bucket int, written int, columns string, buckets int").parquet(f"{self.folder}/manifest/batch={batch}").collect()  # a row a bucket
        if any(r.buckets != self.buckets or json.loads(r.columns)["keys"] != self.keys for r in rows):
            raise ValueError(f"{self.folder} has other keys or another number of buckets")
        return {r.bucket: r.written for r in rows}, StructType.fromJson(json.loads(rows[0].columns)["schema"]) if rows else None

    def _rows(self, written: dict[int, int], schema: StructType | None) -> DataFrame | None:
        paths = [f"{self.folder}/data/batch={b}/bucket={k}" for k, b in sorted(written.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def read(self, batch: int | None = None) -> DataFrame | None:
        """The table as of a batch, the last one by default; None before the first row. Columns that came later are null in earlier rows."""
        whole = [b for b in self.batches() if batch is None or b <= batch]
        return self._rows(*self.manifest(whole[-1])) if whole else None

    def merge(self, new: DataFrame, rule: Rule, batch: int) -> None:
        """Put rule(kept, new) in place of the buckets of new's keys; kept are the rows of these buckets as the batch before left them.

        rule must not depend on, or give, rows of keys in other buckets. Without kept rows the new ones are stored as they are. Null keys are
        keys like others. An empty batch changes nothing.
        """
        before = [b for b in self.batches() if b < batch]
        written, schema = self.manifest(before[-1]) if before else ({}, None)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in new.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets` numbers
        if touched:
            kept = self._rows({k: b for k, b in written.items() if k in set(touched)}, schema)
            out = new if kept is None else rule(kept, new)
            names = [f.name for f in out.schema.fields]
            schema = StructType([*out.schema.fields, *(f for f in (schema or []) if f.name not in names)])
            # Rebalanced, not repartitioned: a bucket that one key fills is split over tasks.
            out.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={batch}")
            written = {**written, **dict.fromkeys(touched, batch)}
        columns = json.dumps({"keys": self.keys, "schema": json.loads(schema.json()) if schema else None})
        rows = [(k, b, columns, self.buckets) for k, b in sorted(written.items())]
        self.spark.createDataFrame(rows, "bucket int, written int, columns string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch}")

    def forget(self, keep: int = 2) -> None:
        """Delete what none of the last `keep` batches needs: their manifests and buckets stay, so the last ones can be run again."""
        whole = self.batches()
        if len(whole) <= keep:
            return
        needed = {(b, k) for batch in whole[-keep:] for k, b in self.manifest(batch)[0].items()}
        fs = self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())
        for batch in whole[:-keep]:
            fs.delete(self._path("manifest", f"batch={batch}"), True)
            for k in range(self.buckets):
                if (batch, k) not in needed:
                    fs.delete(self._path("data", f"batch={batch}", f"bucket={k}"), True)
