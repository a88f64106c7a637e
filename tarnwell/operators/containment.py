"""Which datasets contain which files: prefix joins as equi-joins on exploded ancestors."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import ancestors, relation

#: Datasets, and bytes of their paths, up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: Bits of a filter for each path, at most, and the hashes of a path.
BITS, MOST_BITS, HASHES = 12, 1 << 26, 4


class PathFilter:
    """A Bloom filter of paths as an array of 64-bit words: the words of parts merge by bit-or, and their number is bounded whatever that of the paths.

    It lets through all paths that it was made of, and of others about one in 300 until MOST_BITS are reached, more beyond.
    """

    def __init__(self, paths: DataFrame, count: int) -> None:
        bits = 1 << 12
        while bits < min(MOST_BITS, BITS * count):
            bits *= 2
        self.bits = bits
        at = paths.select(F.explode(F.array(*self._places(F.col("path")))).alias("at"))
        one = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, CAST(at & 63 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        words = [0] * (bits >> 6)
        for r in one.collect():
            words[r.word] = r.bits
        self.words = pa.table({"words": pa.array([words], pa.list_(pa.int64()))})

    def _places(self, path: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(k), path), F.lit(self.bits)) for k in range(HASHES)]

    def holds(self, path: Column) -> Column:
        """Whether a path may be among those; a condition in the JVM, with the words as one value."""
        words = SparkSession.active().createDataFrame(self.words).scalar()
        out = F.lit(True)
        for at in self._places(path):
            out = out & (F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")) == 1)
        return out


def containment(files: DataFrame, datasets: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(dataset_id, dataset_path, file_id): every dataset at or above a file's path, to any depth.

    Each file gives one row per ancestor (the depth of the tree bounds their number), which an equi-join matches; a
    join on a prefix condition would compare all pairs. Datasets up to ``broadcast_rows`` and BROADCAST_BYTES, as counted, go to the files, so that
    ancestors that are no dataset never leave their task. Of more a filter of bounded size goes there, which drops nearly all of those; the rest are
    joined by a shuffle, whose hot keys (datasets near the root) are split as it runs.
    """
    up = files.select(F.col("id").alias("file_id"), F.explode(ancestors("path", itself=True)).alias("dataset_path"))
    own = datasets.select(F.col("id").alias("dataset_id"), F.col("path").alias("dataset_path"))
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("dataset_path")), F.lit(0))).first()
    if n <= broadcast_rows and size <= BROADCAST_BYTES:
        own = F.broadcast(own)
    else:
        up = up.where(PathFilter(datasets.select("path"), n).holds(F.col("dataset_path")))
    return up.join(own, "dataset_path").select("dataset_id", "dataset_path", "file_id")


def most_specific(files: DataFrame, datasets: DataFrame) -> DataFrame:
    """(file_id, dataset_id): the deepest dataset of each file; ties by id."""
    deepest = F.max_by("dataset_id", F.struct(F.octet_length("dataset_path"), -F.col("dataset_id")))
    return containment(files, datasets).groupBy("file_id").agg(deepest.alias("dataset_id"))


def unlinked(files: DataFrame, datasets: DataFrame, linked: DataFrame) -> DataFrame:
    """Contained files that no asset of the dataset links yet."""
    return containment(files, datasets).select("dataset_id", "file_id").join(linked.select("dataset_id", "file_id"), ["dataset_id", "file_id"], "left_anti")


def best_dataset(datasets: DataFrame, path: str) -> DataFrame:
    """The dataset at a path, else the nearest above, else the nearest below."""
    rows = datasets.withColumn("rank", relation(F.lit(path), F.col("path"))).where("rank IS NOT NULL")
    gap = F.abs(F.octet_length("path") - F.octet_length(F.lit(path)))
    return rows.orderBy("rank", gap, "id").limit(1)


def subtree_counts(files: DataFrame) -> DataFrame:
    """Files at any depth under each directory, and their bytes."""
    up = files.select("size", F.explode(ancestors("path")).alias("dir"))
    return up.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def first_by_suffix(candidates: DataFrame, names: DataFrame) -> DataFrame:
    """(name, file_id): for each given name the first file whose path ends with it; matched by base name first."""
    c = candidates.select(F.col("id").alias("file_id"), "path", F.element_at(F.split("path", "/"), -1).alias("_b"))
    n = names.select("name", F.element_at(F.split("name", "/"), -1).alias("_b")).distinct()
    both = c.join(n, "_b").where(F.endswith("path", "name"))
    w = Window.partitionBy("name").orderBy("file_id")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("name", "file_id")
