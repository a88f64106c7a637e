"""File changes as a stream: micro-batches applied to the catalogue, and stateful counts."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from tarnwell.functions import formats
from tarnwell.operators import catalog
from tarnwell.sources import listing
from tarnwell.sources.store import Store

SCHEMA = "event string, path string, size long, mtime_secs long"


def read_changes(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """JSON lines of change events; lines that are no events of a known kind or have no path are dropped."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_trigger).json(folder)
    return rows.where(F.col("event").isin("add", "mod", "del") & F.col("path").isNotNull())


def last_state(changes: DataFrame, key: str = "path", time: str = "mtime_secs", tie: str | None = None) -> DataFrame:
    """The last event of each key; later rows win, ties by ``tie``."""
    w = Window.partitionBy(key).orderBy(F.desc(time), *([F.desc(tie)] if tie else []))
    return changes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_batches(changes: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, seconds: int | None = 5) -> StreamingQuery:
    """Start a query that hands each batch's upserts and deletes (one row per path) to ``apply``.

    ``apply`` gets the batch id, by which a repeated batch can be told; ``seconds`` None handles what is there and stops.
    """

    def batch(rows: DataFrame, number: int) -> None:
        last = last_state(rows)
        apply(last.where("event != 'del'"), last.where("event = 'del'"), number)

    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def count_triggers(events: DataFrame, key: str, every: int = 10) -> DataFrame:
    """(key, n, fires): changes per key and how often a job after every ``every`` of them would have run."""
    return events.groupBy(key).agg(F.count(F.lit(1)).alias("n")).withColumn("fires", F.floor(F.col("n") / every).cast("long"))


def store_changes(changes: DataFrame, store: Store, checkpoint: str, server: str = "local", seconds: int | None = 5, look: bool = False, clock: Callable[[], float] = time.time) -> StreamingQuery:
    """Apply a stream of changes to the files of a store, one version a batch: upserts by path, soft deletes.

    With ``look`` the events only say which paths changed: those that are files now are upserted, others deleted, so late and
    reordered events do no harm. A batch that was applied before a restart is told by its number and left out.
    """

    def apply(up: DataFrame, gone: DataFrame, number: int) -> None:
        done = store.read("applied").agg(F.max("batch")).first()[0] if store.has("applied") else None
        if done is not None and number <= done:
            return
        now = int(clock())
        if look:
            found = listing.stat_paths(up.select("path").union(gone.select("path")), server)
            up, gone = found.where("exists"), found.where("NOT exists")
            up = up.withColumn("format", formats.detect("path", F.col("magic_bytes")))
        else:
            up = up.withColumn("format", formats.detect("path"))
        delta = up.select("path", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime_secs", F.lit(0)).alias("mtime"), F.lit(server).alias("source_server"), "format")
        files = catalog.soft_delete(catalog.upsert(store.read("files"), delta, now), gone, now)
        store.commit({"files": files, "applied": changes.sparkSession.createDataFrame([(number,)], "batch long")})

    return apply_batches(changes, apply, checkpoint, seconds)


def count_stream(changes: DataFrame, key: str, every: int = 10) -> DataFrame:
    """(key, n, fires) whenever a key's changes come: how many there have been, and how often ``every`` of them were reached since the last row.

    The count is kept as state across batches; write it in update mode.
    """

    def count(at: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        n = before + sum(len(r) for r in rows)
        state.update((n,))
        yield pd.DataFrame({key: [at[0]], "n": [n], "fires": [n // every - before // every]})

    kind = changes.schema[key].dataType.simpleString()
    return changes.groupBy(key).applyInPandasWithState(count, f"{key} {kind}, n long, fires long", "n long", "update", "NoTimeout")


def due(now: int, at: tuple[int, int], last_day: int | None, minutes: int = 10) -> bool:
    """Whether a daily job at (hour, minute) UTC should start: within ``minutes`` of that time, in its hour, and not yet today."""
    hour, minute = now % 86400 // 3600, now % 3600 // 60
    return now // 86400 != last_day and hour == at[0] and at[1] <= minute < at[1] + minutes


def purge_daily(store: Store, now: int, days: int, last_day: int | None) -> int:
    """Purge what has been deleted for over ``days`` days, once a day; the day of the last purge is returned."""
    today = now // 86400
    if today != last_day:
        store.commit({"files": catalog.purge(store.read("files"), now, days)})
    return today
