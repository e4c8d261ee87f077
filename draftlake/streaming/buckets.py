"""State of a stream that batches merge into, kept in buckets of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


class Buckets:
    """Rows by key in a fixed number of buckets. A batch reads and rewrites the buckets of its keys,
    under its own number; which batch's files hold each bucket is told by a small table that is
    written last. So a batch that failed half-way left nothing that counts, and one that is repeated
    after it was told changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def told(self) -> tuple[int, dict[int, int]]:
        """The last batch, and the batch that wrote each bucket."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/told")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return -1, {}
        last = rows.agg(F.max("batch")).first()[0]
        return last, {r["bucket"]: r["written"] for r in rows.where(F.col("batch") == last).collect()}

    def read(self, only: set[int] | None = None) -> DataFrame | None:
        """All rows, or those of some buckets; None where there are none."""
        places = {b: n for b, n in self.told()[1].items() if only is None or b in only}
        paths = [f"{self.path}/rows/batch={n}/bucket={b}" for b, n in sorted(places.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def _of(self, keys: tuple[str, ...]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame, keys: tuple[str, ...]) -> set[int]:
        """At most as many numbers as there are buckets."""
        return {r[0] for r in rows.select(self._of(keys)).distinct().collect()}

    def touched(self, rows: DataFrame, keys: tuple[str, ...]) -> DataFrame | None:
        """What the buckets of these rows' keys hold."""
        return self.read(self._touched(rows, keys))

    def update(self, rows: DataFrame, keys: tuple[str, ...], merge: Callable[[DataFrame], DataFrame], number: int) -> None:
        """Merge a batch's rows into their buckets; nothing for a batch that was told before."""
        last, places = self.told()
        if number <= last:
            return
        touched = self._touched(rows, keys)
        old = self.read(touched)
        merged = merge(rows if old is None else old.unionByName(rows))
        merged.withColumn("bucket", self._of(keys)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/rows/batch={number}")
        now = {**places, **dict.fromkeys(touched, number)}
        table = self.spark.createDataFrame(sorted(now.items()), "bucket int, written long")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/told/batch={number}")
