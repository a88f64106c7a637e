"""A watched tree applied to the catalogue: changed paths gathered in state, flushed by number or time."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tarnwell.functions import formats
from tarnwell.functions.paths import ancestors
from tarnwell.operators.fulltext import TextIndex
from tarnwell.sources import datasource, listing
from tarnwell.sources.buckets import Buckets
from tarnwell.sources.store import durable

AT_MOST, SECONDS = 100, 5.0
#: The state store that timers and map state need.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLUSHED = "shard int, path string, flush long, cause string"


def watch(spark: SparkSession, roots: str, **options: str) -> DataFrame:
    """The stream of a tree's changes; see ``datasource.WatchReader``."""
    datasource.register(spark)
    return spark.readStream.format("file_watch").options(path=roots, **options).load()


class Gather(StatefulProcessor):
    """Holds a shard's changed paths, each once, until there are ``at_most`` of them or the first has waited for ``seconds``."""

    def __init__(self, at_most: int, seconds: float) -> None:
        self.at_most, self.wait = at_most, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", StructType([StructField("path", StringType())]), StructType([StructField("since", LongType())]))
        self.meta = handle.getValueState("meta", StructType([StructField("held", LongType()), StructField("due", LongType()), StructField("flushes", LongType())]))

    def _meta(self) -> tuple[int, int, int]:
        return tuple(self.meta.get()) if self.meta.exists() else (0, 0, 0)

    def _flush(self, shard: int, cause: str, flushes: int) -> pd.DataFrame:
        held = sorted(k[0] for k, _ in self.paths.iterator())
        self.paths.clear()
        return pd.DataFrame({"shard": shard, "path": held, "flush": flushes, "cause": cause})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held, due, flushes = self._meta()
        for batch in rows:
            for path in batch["path"]:
                if self.paths.containsKey((path,)):
                    continue
                if not held:
                    due = now + self.wait
                    self.handle.registerTimer(due)
                self.paths.updateValue((path,), (now,))
                held += 1
                if held >= self.at_most:
                    yield self._flush(int(key[0]), "number", flushes)
                    self.handle.deleteTimer(due)
                    held, due, flushes = 0, 0, flushes + 1
        self.meta.update((held, due, flushes))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, due, flushes = self._meta()
        if held and expiredTimerInfo.getExpiryTimeInMs() >= due:
            yield self._flush(int(key[0]), "time", flushes)
            self.meta.update((0, 0, flushes + 1))

    def close(self) -> None:
        pass


def gathered(changes: DataFrame, at_most: int = AT_MOST, seconds: float = SECONDS, shards: int = 1) -> DataFrame:
    """(shard, path, flush, cause): changed paths, each once a flush, when ``at_most`` are held or the first has waited for ``seconds``.

    Paths are dealt to ``shards`` by hash, each with its own flushes, so that one busy tree keeps many tasks at work. The stream needs STATE_STORE, and
    appends. What is held is state, so a restart neither loses nor repeats it.
    """
    rows = changes.select("path", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").transformWithStateInPandas(Gather(at_most, seconds), FLUSHED, "Append", "ProcessingTime")


def removed(files: DataFrame, dirs: DataFrame) -> DataFrame:
    """(path): live files below a changed directory whose next name is no longer in it.

    ``dirs`` has path and names, what each directory still has. A file meets the changed directories above it by equality.
    """
    kept = dirs.groupBy(F.col("path").alias("at")).agg(F.last("names").alias("names"))
    up = files.where("NOT deleted").select("path", F.explode(ancestors("path")).alias("at")).join(kept, "at")
    rest = F.substr("path", F.length("at") + 2)
    return up.where(~F.array_contains("names", F.split_part(rest, F.lit("/"), F.lit(1)))).select("path").distinct()


LOOKED = "path string, kind string, names array<string>"


def look(paths: DataFrame) -> DataFrame:
    """(path, kind, names) of paths as they are now: "file", "dir" with the names in it, or "gone"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                kind = "file" if os.path.isfile(path) else "dir" if os.path.isdir(path) else "gone"
                try:
                    found.append((path, kind, os.listdir(path) if kind == "dir" else None))
                except OSError:
                    found.append((path, "gone", None))
            if found:
                columns = zip(zip(*found), (pa.string(), pa.string(), pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["path", "kind", "names"])

    return paths.select("path").distinct().mapInArrow(run, LOOKED)


def put_paths(paths: DataFrame, files: Buckets, index: TextIndex | None, number: int, now: int, server: str = "local") -> None:
    """Apply changed paths, as they are now, to the catalogue and to the full-text index, under one batch number.

    Each of the two notes the number with what it wrote and is left out if it has it, so a batch that is broken off between them and given again
    changes only what is missing. Files are upserted, what is gone is deleted softly, also below directories that changed; the
    index gets the path and format of upserted files under the ids of the catalogue, and keeps deleted ones, as a search shows them too.
    """
    behind = index is not None and index.applied() < number
    if files.applied() >= number and not behind:
        return
    seen = durable(look(paths))
    if files.applied() < number:
        up = listing.stat_paths(seen.where("kind = 'file'"), server).where("exists")
        delta = up.select("path", "size", F.col("mtime_secs").alias("mtime"), "source_server", formats.detect("path", F.col("magic_bytes")).alias("format"))
        gone = seen.where("kind = 'gone'").select("path").union(removed(files.read(), seen.where("kind = 'dir'")))
        files.change(delta, gone, now, number)
    if behind:
        rows = files.at(seen.where("kind = 'file'")).where("NOT deleted")
        index.put(rows.select("id", F.concat_ws(" ", "path", "format").alias("metadata"), "path", F.array().cast("array<string>").alias("tags")))
        index.commit(number)


def watch_into(changes: DataFrame, files: Buckets, index: TextIndex | None, checkpoint: str, *, server: str = "local", seconds: float | None = 1, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """Apply a stream with a column ``path`` (a watch, what ``gathered`` flushes, or change events) batch by batch; ``seconds`` None handles what is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        put_paths(rows, files, index, number, int(clock()), server)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
