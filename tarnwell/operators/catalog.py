"""Catalogue changes as rewrites: upsert, soft delete, purge, tags, snapshots.

Plain Parquet has no merge, so each change is a function from tables to tables; the caller writes the result to a
new version (``Store``) and moves the pointer when it is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.sources.store import durable

#: Pairs of rows for a task, the most parts of a name, and equal rows that stay together, where snapshots are compared.
PAIRS, SALTS, EQUAL = 2_000_000, 64, 64


def upsert(files: DataFrame, delta: DataFrame, now: int) -> DataFrame:
    """Insert or update by path: physical columns from the delta, which also revives deleted rows.

    A known path keeps its id, ``indexed_at`` and metadata, and its format unless the delta has one. Of several delta rows
    for a path the newest (by ``mtime``, then size) wins. New ids follow the largest.
    """
    last = Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size"))
    d = delta.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("path", *[F.col(c).alias(f"_{c}") for c in ("size", "mtime", "source_server", "format")], F.lit(True).alias("_new"))
    # The change and its new paths are used several times; they are computed once and are small beside the table.
    d = durable(d)
    both = files.join(d, "path", "left")
    new = F.col("_new").isNotNull()
    old = both.select(
        "id", "path", "indexed_at", "bio_metadata", "species", "assay_type",
        *[F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("size", "mtime", "source_server")],
        F.coalesce("_format", "format").alias("format"),
        (F.col("deleted") & ~new).alias("deleted"),
        F.when(new, F.lit(now)).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    top = files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = number(durable(d.join(files.select("path"), "path", "left_anti")), ["path"], "_n").join(F.broadcast(top))
    nothing = {c: F.lit(None).cast(files.schema[c].dataType) for c in ("bio_metadata", "species", "assay_type")}
    fresh = numbered.select(
        (F.col("_top") + F.col("_n")).alias("id"), "path", F.lit(now).cast("long").alias("indexed_at"), *[v.alias(c) for c, v in nothing.items()],
        *[F.col(f"_{c}").alias(c) for c in ("size", "mtime", "source_server", "format")], F.lit(False).alias("deleted"), F.lit(now).alias("updated_at"),
    )
    return old.unionByName(fresh)


def number(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 1 in an order, by range partitions and their sizes instead of one window over all rows.

    Ranges are drawn from a sample, so they are dealt once and kept: dealt anew for the sizes, they could differ from those that the ranks are of.
    """
    spread = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # Such an id is the partition's number, and in the lower 33 bits the row's place there.
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = spread.withColumn("_part", part).join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    return both.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_at", "_before")


def soft_delete(files: DataFrame, paths: DataFrame, now: int) -> DataFrame:
    gone = paths.select("path", F.lit(True).alias("_gone")).distinct()
    both = files.join(gone, "path", "left")
    hit = F.coalesce("_gone", F.lit(False))
    return both.withColumns({"deleted": F.col("deleted") | hit, "updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at"))}).drop("_gone")


def purge(files: DataFrame, now: int, days: int) -> DataFrame:
    """Without deleted files not updated for over ``days`` days."""
    return files.where(~(F.col("deleted") & (F.col("updated_at") < now - days * 86400)))


def replace_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """The tags of the files in ``new`` replace their old ones."""
    return tags.join(new.select("file_id").distinct(), "file_id", "left_anti").unionByName(new.distinct())


def latest(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in by])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def snapshot_added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose name the older snapshot lacks; repeats stay. Swap the two for removed rows."""
    return new.join(old.select("name"), "name", "left_anti")


def snapshot_modified(old: DataFrame, new: DataFrame) -> DataFrame:
    """Names in both whose type or species differ; nulls differ from nothing.

    Every new row of a name meets every old one, which is quadratic where names repeat. Equal rows are therefore counted and
    only counts are joined; the pairs are then made as often as they occur, dealt over as many tasks as their number asks for.
    """
    columns = ["name", "dataset_type", "species"]
    count = F.count(F.lit(1))
    named = [x.where("name IS NOT NULL").groupBy("name").agg(count.alias(n)) for x, n in ((old, "_a"), (new, "_b"))]
    tasks = int((named[0].join(named[1], "name").agg(F.sum(F.col("_a").cast("double") * F.col("_b"))).first()[0] or 0) // PAIRS) + 1
    salts = min(tasks, SALTS)
    o = _pieces(old.groupBy(*columns).agg(count.alias("_n")), "_a").select("name", F.col("dataset_type").alias("old_type"), F.col("species").alias("old_species"), "_a")
    n = _pieces(new.groupBy(*columns).agg(count.alias("_n")), "_b")
    n = n.select(*columns, "_b", F.pmod(F.xxhash64("dataset_type", "species", "_k"), F.lit(salts)).cast("int").alias("_salt"))
    if tasks > 1:
        n = n.repartition(tasks, "name", "_salt")
    o = o.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = n.join(o, ["name", "_salt"]).where((F.col("dataset_type") != F.col("old_type")) | (F.col("species") != F.col("old_species")))
    # A stage of generated code keeps all rows that one row leads to until it gives the first. Were the join in one stage with what it feeds, those
    # would be all pairs of a row with its name's old rows; coalesce, here to no fewer tasks, parts them, and EQUAL squared are the most kept.
    both = both.coalesce(max(tasks, old.sparkSession.sparkContext.defaultParallelism))
    return both.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_a") * F.col("_b")))).select(*columns, "old_type", "old_species")


def _pieces(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are there ``_n`` times as pieces ``_k`` of at most ``EQUAL``, so that no name and no row is one task's, nor all its pairs one row's."""
    cut = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / EQUAL))))
    return cut.withColumn(name, F.least(F.lit(EQUAL), F.col("_n") - F.col("_k") * EQUAL))


def rollback(datasets: DataFrame, assets: DataFrame, links: DataFrame, snapshot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without what later snapshots added; rows without a snapshot stay."""
    later = F.coalesce(F.col("snapshot_id") > snapshot, F.lit(False))
    gone = assets.where(later).select(F.col("id").alias("asset_id"))
    return datasets.where(~later), assets.where(~later), links.join(gone, "asset_id", "left_anti")
