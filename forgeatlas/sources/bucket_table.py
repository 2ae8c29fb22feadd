"""A stored table that is updated in place, bucket by bucket.

Rows lie in folders by a hash of their key. An update reads the buckets of its keys only, finds
the rows that really differ, and replaces only the buckets that have such rows; the files of
all others stay as they are. The same update once more changes nothing. A bucket is replaced
by Spark's dynamic partition overwrite after the new rows were stored aside, so an update that
was cut off is simply run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from forgeatlas.operators.languages import merge_upsert
from forgeatlas.session import scratch_path

BUCKETS = 256
BUCKET = "bucket"
ROWS_PER_FILE = 1_000_000
#: Columns that an update writes, so that they do not make a row a different one.
STAMPS = ("id", "date_created", "date_updated", "hostname")


@dataclass(frozen=True)
class BucketTable:
    """``columns`` is the schema without the bucket; ``key`` names its unique column. The number
    of buckets is fixed when the table is made (:meth:`rebucket` makes another one)."""

    spark: SparkSession
    path: str
    columns: StructType
    key: str = "file_path"

    def create(self, buckets: int = BUCKETS) -> BucketTable:
        """Makes the table if it is not there yet."""
        if self._buckets(None) is None:
            self.spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.path}/layout")
        return self

    def _buckets(self, otherwise: int | None = 0) -> int | None:
        try:
            return self.spark.read.schema("buckets int").parquet(f"{self.path}/layout").first()["buckets"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND" or otherwise == 0:
                raise
            return otherwise

    def _stored(self) -> DataFrame:
        schema = StructType([*self.columns.fields]).add(BUCKET, IntegerType())
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, wanted: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are opened."""
        rows = self._stored()
        if wanted is not None:
            rows = rows.filter(F.col(BUCKET).isin(wanted))
        return rows.drop(BUCKET)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self._buckets())).cast("int")

    def upsert(self, new: DataFrame, *, now: Column | None = None, stamps: tuple[str, ...] = STAMPS) -> int:
        """Adds rows with new keys and replaces rows whose values differ (other than
        ``stamps``), see :func:`.merge_upsert`; returns the number of buckets that were
        replaced. Rows without a key are refused. Of several new rows with one key the one
        with the highest ``id`` counts."""
        folder = scratch_path(self.spark, "upsert")
        # A duplicated key would make two rows of one: reduce before anything is compared.
        rows = new.select(*self.columns.names).withColumn(BUCKET, self.bucket())
        missing = F.raise_error(F.lit(f"a row without {self.key}"))
        rows = rows.withColumn(self.key, F.coalesce(self.key, missing.cast("string")))
        rows.write.parquet(f"{folder}/new")
        rows = self.spark.read.schema(rows.schema).parquet(f"{folder}/new")
        # At most one number per bucket comes back.
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())
        if not touched:
            return 0
        values = [c for c in self.columns.names if c != self.key and c not in stamps]
        fields = [c for c in rows.columns if c != self.key]
        best = F.max_by(F.struct(*fields), F.coalesce(F.col("id"), F.lit(-1))) if "id" in fields else F.max(F.struct(*fields))
        latest = rows.groupBy(self.key).agg(best.alias("_n")).select(self.key, "_n.*")
        old = self.read(touched).select(F.col(self.key).alias("_key"), F.struct(*values).alias("_old"))
        same = F.col("_old").isNotNull() & F.struct(*values).eqNullSafe(F.col("_old"))
        changed = latest.join(old, F.col(self.key) == F.col("_key"), "left").filter(~same).drop("_key", "_old")
        changed.write.parquet(f"{folder}/changed")
        changed = self.spark.read.schema(latest.schema).parquet(f"{folder}/changed")
        replaced = sorted(r[0] for r in changed.select(BUCKET).distinct().collect())
        if replaced:
            merged = merge_upsert(self.read(replaced), changed.select(*self.columns.names), key=self.key, now=now)
            self._write(merged, f"{folder}/merged")
        return len(replaced)

    def _write(self, merged: DataFrame, aside: str) -> None:
        merged.write.parquet(aside)
        rows = self.spark.read.schema(merged.schema).parquet(aside).withColumn(BUCKET, self.bucket())
        (
            rows.repartition(BUCKET).sortWithinPartitions(BUCKET, self.key)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy(BUCKET).parquet(f"{self.path}/rows")
        )

    def rebucket(self, path: str, buckets: int) -> BucketTable:
        """The same rows in another table with another number of buckets."""
        other = BucketTable(self.spark, path, self.columns, self.key).create(buckets)
        other._write(self.read(), scratch_path(self.spark, "rebucket"))
        return other
