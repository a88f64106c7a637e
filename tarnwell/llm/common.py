"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a small side up to which it may be broadcast; beyond it joins shuffle (and AQE splits skewed keys).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and all runs on one machine (tests) a temporary folder is made, once.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="tarnwell-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared file system with all in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: What each open phase has checkpointed, the innermost last.
_phases: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("phases", default=())


@contextmanager
def phase(spark: SparkSession) -> Iterator[None]:
    """Checkpoints that ``durable`` makes inside are removed at the end, but for those that are to stay.

    Spark itself leaves them in the shared folder for good, unless ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. What is
    read after the phase must be written or stay.
    """
    made: list[DataFrame] = []
    outer = _phases.set((*_phases.get(), made))
    try:
        yield
    finally:
        _phases.reset(outer)
        for df in made:
            file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
            if file.isDefined():
                remove(spark, file.get())


def durable(df: DataFrame, stay: bool = False) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder; it survives lost executors.

    It goes with the phase in which it is made, or with ``stay`` with the one around that.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    owners = _phases.get()[: -1 if stay else None]
    if owners:
        owners[-1].append(out)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of jobs that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which a driver with memory to spare puts off while disks fill. It works
    on its own, so it gets a moment, and a second pass for what the first one set free.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a broadcast hint only if ``small`` was counted and is within BROADCAST_ROWS; a shuffle join otherwise."""
    if rows is None:
        rows = small.count()
    return big.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def running(rows: DataFrame, order: list, sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its column over all rows before, in an order without ties.

    Rows are sorted in range partitions; what lies before a partition comes from the partitions' totals, one row for each.
    """
    spread = durable(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).withColumns({f"_{n}": c for n, c in sums.items()}))
    before = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    totals = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(parts), F.lit(0)).alias(f"_{n}_") for n in sums])
    local = spread.withColumns({n: F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)) for n in sums})
    return local.join(F.broadcast(totals), "_part").withColumns({n: F.col(n) + F.col(f"_{n}_") for n in sums}).select(*rows.columns, *sums)


def rows_of(batch: pa.RecordBatch, size: int = 256, most: int = 1 << 25) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` rows, and of fewer where they pass ``most`` bytes, so that few texts are Python objects at once."""
    for at in range(0, batch.num_rows, size):
        part = batch.slice(at, size)
        step = max(1, part.num_rows * most // max(most, part.nbytes))
        for lo in range(0, part.num_rows, step):
            yield part.slice(lo, step)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Runs of equal 64-bit keys of a partition that is sorted by the key; a run may span batches."""
    held: list[pa.Table] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = pa.Table.from_batches([batch])
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if current is not None and keys[lo] != current:
                yield current, pa.concat_tables(held)
                held = []
            current = keys[lo]
            held.append(whole.slice(lo, hi - lo))
    if held:
        yield current, pa.concat_tables(held)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Polynomial hashes modulo 2**64 of any slices of a sequence, from one prefix sum."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    _up = np.ones(1, np.uint64)
    _down = np.ones(1, np.uint64)

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls._up) < n:
            size = 1 << int(n).bit_length()
            out = []
            for base in (cls.BASE, cls.INVERSE):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                out.append(np.multiply.accumulate(steps))
            cls._up, cls._down = out
        return cls._up, cls._down

    def __init__(self, units: np.ndarray) -> None:
        n = len(units)
        up, self.down = self.powers(n + 2)
        self.up = up
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def slices(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]
