"""A table on plain Parquet of which an upsert rewrites only the buckets it touches.

Rows lie in buckets by a hash of their key. An upsert reads the buckets of its keys, writes
them anew beside the old ones, and then names the place of every bucket in a manifest of its
version. Readers take the last manifest that was finished, so they see whole versions
only, and a failed write is never read.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "bucket int, place string"


@dataclass(frozen=True)
class BucketTable:
    """Rows of a `schema` with one row for each `key`, in `buckets` parts below `folder`."""

    folder: str
    schema: str
    key: str = "url"
    buckets: int = 64

    def _path(self, spark: SparkSession, place: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def versions(self, spark: SparkSession) -> list[int]:
        """The versions whose manifests are finished, in order."""
        system, path = self._path(spark, f"{self.folder}/_manifest")
        if not system.exists(path):
            return []
        names = [status.getPath() for status in system.listStatus(path)]
        done = [p for p in names if p.getName().startswith("seq=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[4:]) for p in done)

    def places(self, spark: SparkSession, version: int | None = None) -> dict[int, str]:
        """Where each bucket's rows lie in a version, by default the last; a row for each bucket."""
        known = self.versions(spark)
        wanted = [v for v in known if version is None or v <= version]
        if not wanted:
            return {}
        manifest = spark.read.schema(_MANIFEST).parquet(f"{self.folder}/_manifest/seq={wanted[-1]}")
        return {r.bucket: r.place for r in manifest.collect()}

    def _rows(self, spark: SparkSession, places: list[str]) -> DataFrame:
        return spark.read.schema(self.schema).parquet(*places) if places else spark.createDataFrame([], self.schema)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self._rows(spark, sorted(self.places(spark, version).values()))

    def upsert(self, rows: DataFrame, version: int) -> list[int]:
        """Replace or add rows, of which each key has one; returns the buckets that were written.

        A version that is finished already is left as it is, so a repeated batch changes
        nothing. Rows with a null key are left out.
        """
        spark = rows.sparkSession
        if version in self.versions(spark):
            return []
        names = [f.name for f in spark.createDataFrame([], self.schema).schema]
        new = rows.where(F.col(self.key).isNotNull()).select(*names).withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        before = self.places(spark, version - 1)
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # as many as there are buckets
        place = f"{self.folder}/v{version}-{uuid.uuid4().hex}"
        if touched:
            old = self._rows(spark, [before[b] for b in touched if b in before])
            kept = old.join(new.select(self.key), self.key, "left_anti").withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
            merged = kept.select(*names, "_bucket").unionByName(new)
            merged.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(place)
        after = before | {b: f"{place}/_bucket={b}" for b in touched}
        listed = spark.createDataFrame(sorted(after.items()), _MANIFEST)
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_manifest/seq={version}")
        return touched

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Delete the files that none of the last `keep` versions reads, and older manifests."""
        known = self.versions(spark)
        stay = {place for v in known[-keep:] for place in self.places(spark, v).values()}
        system, top = self._path(spark, self.folder)
        for version in system.listStatus(top) if system.exists(top) else []:
            if not version.getPath().getName().startswith("v"):
                continue
            parts = [p.getPath() for p in system.listStatus(version.getPath()) if p.isDirectory()]
            used = [p for p in parts if any(p.toString().endswith(s[s.rindex("/v"):]) for s in stay)]
            for part in (p for p in parts if p not in used):
                system.delete(part, True)
            if not used:
                system.delete(version.getPath(), True)
        for old in known[:-keep]:
            system.delete(self._path(spark, f"{self.folder}/_manifest/seq={old}")[1], True)
