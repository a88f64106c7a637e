"""The files table in buckets by a hash of the path, so that a small change rewrites only the buckets of its paths.

Buckets are folders that Spark's dynamic partition overwrite replaces. That is done folder by folder at the end of a job: a batch that
is broken off there leaves some buckets new and some old, and applying it again sets them right, since a change is by path. ``applied`` holds the number of the last
batch that was applied whole. One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tarnwell.sources.store import Unavailable, durable, on_files, remove

BUCKETS = 1000
DELTA = ("size", "mtime", "source_server", "format")


class Buckets:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _meta(self):
        try:
            return self.spark.read.parquet(f"{self.root}/meta").first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                raise Unavailable(f"no table at {self.root}") from None
            raise

    @staticmethod
    def of(path: Column | str, n: int) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(n)).cast("int")

    def create(self, files: DataFrame, n: int = BUCKETS) -> None:
        """Lay the table out in ``n`` buckets. New ids will follow the largest, each bucket counting in steps of ``n``, so none needs to know of the others."""
        base = (files.agg(F.max("id")).first()[0] or 0) + 1
        files.withColumn("bucket", self.of("path", n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/files")
        self.spark.createDataFrame([(n, base)], "n int, base long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/meta")
        self._kinds(files)

    def _kinds(self, files: DataFrame) -> None:
        # An empty table has no folder to take its columns from.
        files.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/columns")

    def _read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, whose folders alone are then listed."""
        kinds = self.spark.read.parquet(f"{self.root}/columns").schema.add("bucket", IntegerType())
        at = [f"{self.root}/files"]
        if only is not None:
            at = [f"{at[0]}/bucket={b}" for b in only]
            at = [p for p in at if (f := on_files(self.spark, p))[1].exists(f[0])]
        if not at:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).option("basePath", f"{self.root}/files").parquet(*at)

    def read(self) -> DataFrame:
        return self._read().drop("bucket")

    def at(self, paths: DataFrame) -> DataFrame:
        """The rows of some paths; only their buckets are read."""
        n = self._meta().n
        some = paths.select("path").distinct()
        hit = [r.b for r in some.select(self.of("path", n).alias("b")).distinct().collect()]
        return self._read(hit).drop("bucket").join(some, "path", "left_semi")

    def applied(self) -> int:
        """The number of the last batch that was applied; -1 before the first."""
        try:
            return self.spark.read.parquet(f"{self.root}/applied").agg(F.max("batch")).first()[0]
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return -1
            raise

    def _done(self, batch: int | None) -> None:
        if batch is not None:
            self.spark.createDataFrame([(batch,)], "batch long").coalesce(1).write.mode("append").parquet(f"{self.root}/applied")

    def _write(self, rows: DataFrame) -> None:
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/files")

    def change(self, delta: DataFrame, gone: DataFrame, now: int, batch: int | None = None) -> list[int]:
        """Upsert and soft-delete by path, as ``catalog`` does, and which buckets were rewritten.

        ``delta`` has path, size, mtime, source_server and format, of several rows for a path the newest wins; ``gone`` has path. A path in both is
        upserted first. One join of the named buckets with the change; ids of new paths are counted within each bucket.
        """
        meta = self._meta()
        newest = delta.groupBy("path").agg(F.max(F.struct("mtime", "size", "source_server", "format")).alias("d"))
        both = newest.join(gone.select("path", F.lit(True).alias("gone")).distinct(), "path", "full_outer")
        both = durable(both.withColumn("bucket", self.of("path", meta.n)))
        hit = sorted(r.bucket for r in both.select("bucket").distinct().collect())
        if hit:
            old = self._read(hit)
            rows = old.join(both, ["bucket", "path"], "full_outer").where("id IS NOT NULL OR d IS NOT NULL")
            new, out = F.col("d").isNotNull(), F.coalesce("gone", F.lit(False))
            own = Window.partitionBy("bucket")
            seq = F.floor((F.max(F.when(F.col("id") >= meta.base, F.col("id"))).over(own) - meta.base) / meta.n)
            rank = F.row_number().over(Window.partitionBy("bucket", F.col("id").isNull()).orderBy("path"))
            fresh = F.lit(meta.base).cast("long") + (F.coalesce(seq, F.lit(-1)) + rank) * meta.n + F.col("bucket")
            put = {
                "id": F.coalesce("id", fresh),
                "format": F.coalesce("d.format", "format"),
                "deleted": out | (F.coalesce("deleted", F.lit(False)) & ~new),
                "updated_at": F.when(new | out, F.lit(now)).otherwise(F.col("updated_at")),
                "indexed_at": F.when(F.col("id").isNull(), F.lit(now)).otherwise(F.col("indexed_at")),
            } | {c: F.when(new, F.col(f"d.{c}")).otherwise(F.col(c)) for c in DELTA[:3]}
            kinds = {f.name: f.dataType for f in old.schema.fields}
            self._write(rows.select(*[put.get(c, F.col(c)).cast(kinds[c]).alias(c) for c in old.columns]))
        self._done(batch)
        return hit

    def purge(self, now: int, days: int) -> list[int]:
        """Drop deleted files not updated for over ``days`` days, and which buckets were rewritten: those that hold such files."""
        due = F.col("deleted") & (F.col("updated_at") < now - days * 86400)
        counts = {r.bucket: r.left for r in self._read().groupBy("bucket").agg(F.count_if(due).alias("n"), F.count_if(~due).alias("left")).where("n > 0").collect()}
        kept = [b for b, left in counts.items() if left]
        if kept:
            self._write(self._read(kept).where(~due))
        # Nothing is written for a bucket that loses all its rows, so its folder goes.
        for b in set(counts) - set(kept):
            remove(self.spark, f"{self.root}/files/bucket={b}")
        return sorted(counts)
