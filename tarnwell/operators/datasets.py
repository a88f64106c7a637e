"""Writing datasets, assets, links, file metadata and snapshots: functions from tables to tables, stored by ``Store``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.operators.catalog import latest, number
from tarnwell.sources.store import durable

AUXILIARY = "auxiliary_files"


def _top(table: DataFrame, id_col: str = "id") -> DataFrame:
    """The largest id, as one row."""
    return table.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))


def _numbered(table: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """New rows with ids after the largest of the table."""
    ids = number(durable(new), order, "_n").join(F.broadcast(_top(table)))
    return ids.withColumn("id", (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top")


def put_datasets(datasets: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Insert or update by path. A known path keeps its id and ``indexed_at``; the other columns are the new row's.

    ``new`` has path and any of the table's other columns, each path once; columns that it lacks are null for a new dataset and stay for a known one.
    """
    new = durable(new)
    own = [c for c in datasets.columns if c not in ("id", "path", "indexed_at", "updated_at")]
    have = [c for c in own if c in new.columns]
    d = new.select("path", *[F.col(c).alias(f"_{c}") for c in have], F.lit(True).alias("_new"))
    both = datasets.join(d, "path", "left")
    hit = F.col("_new").isNotNull()
    old = both.select([
        F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in have
        else F.when(hit, F.lit(now)).otherwise(F.col(c)).cast("long").alias(c) if c == "updated_at" else F.col(c) for c in datasets.columns
    ])
    fresh = new.join(datasets.select("path"), "path", "left_anti")
    fresh = _numbered(datasets, fresh, ["path"]).withColumns({c: F.lit(now).cast("long") for c in ("indexed_at", "updated_at") if c in datasets.columns})
    missing = {c: F.lit(None).cast(datasets.schema[c].dataType) for c in datasets.columns if c not in fresh.columns}
    return old.unionByName(fresh.withColumns(missing).select(datasets.columns))


def put_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """Append assets with new ids, numbered by dataset and name; columns that ``new`` lacks are null."""
    fresh = _numbered(assets, new, ["dataset_id", "name"])
    missing = {c: F.lit(None).cast(assets.schema[c].dataType) for c in assets.columns if c not in fresh.columns}
    return assets.unionByName(fresh.withColumns(missing).select(assets.columns))


def link_files(links: DataFrame, new: DataFrame) -> DataFrame:
    """Links (asset_id, file_id, role); a new row replaces the role of its pair. Of repeats the largest role counts."""
    last = new.groupBy("asset_id", "file_id").agg(F.max("role").alias("role"))
    return links.join(last, ["asset_id", "file_id"], "left_anti").select("asset_id", "file_id", "role").unionByName(last)


def link_auxiliary(assets: DataFrame, links: DataFrame, pairs: DataFrame, role: str = "auxiliary") -> tuple[DataFrame, DataFrame]:
    """(assets, links) with one more asset for each dataset of ``pairs`` (dataset_id, file_id), to which its files are linked."""
    pairs = pairs.select("dataset_id", "file_id").distinct()
    new = pairs.select("dataset_id").distinct().withColumns({"name": F.lit(AUXILIARY), "asset_type": F.lit(AUXILIARY)})
    with_id = _numbered(assets, new, ["dataset_id"])
    missing = {c: F.lit(None).cast(assets.schema[c].dataType) for c in assets.columns if c not in with_id.columns}
    linked = pairs.join(with_id.select("dataset_id", F.col("id").alias("asset_id")), "dataset_id").select("asset_id", "file_id", F.lit(role).alias("role"))
    return assets.unionByName(with_id.withColumns(missing).select(assets.columns)), link_files(links, linked)


def metadata_json(assay_type: Column, species: Column, project: Column, tags: Column, extra: Column | None = None) -> Column:
    """The text of a file's metadata: its fields, and the pairs of ``extra`` (a map) beside them; nulls are left out."""
    own = F.to_json(F.struct(assay_type.alias("assay_type"), species.alias("species"), project.alias("project"), tags.alias("tags")))
    if extra is None:
        return own
    more = F.to_json(F.map_filter(extra, lambda k, v: ~k.isin("assay_type", "species", "project", "tags")))
    return F.when(extra.isNull() | (more == "{}"), own).when(own == "{}", more).otherwise(F.concat(F.regexp_replace(own, r"\}$", ","), F.substr(more, F.lit(2))))


def metadata_fields(text: Column | str) -> Column:
    """struct(assay_type, species, project, tags, extra) of a file's metadata text; null for what is no JSON object."""
    t = F.col(text) if isinstance(text, str) else text
    own = F.from_json(t, "assay_type string, species string, project string, tags array<string>, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    extra = F.map_filter(F.from_json(t, "map<string,string>"), lambda k, v: ~k.isin("assay_type", "species", "project", "tags"))
    ok = t.isNotNull() & F.startswith(F.ltrim(t), F.lit("{")) & own["_bad"].isNull()
    return F.when(ok, F.struct(own["assay_type"].alias("assay_type"), own["species"].alias("species"), own["project"].alias("project"), F.coalesce(own["tags"], F.array().cast("array<string>")).alias("tags"), extra.alias("extra")))


def put_metadata(files: DataFrame, tags: DataFrame, new: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(files, tags) with the metadata of ``new`` (id, assay_type, species, project, tags), which replaces what its files had.

    The columns ``bio_metadata``, ``species`` and ``assay_type`` follow, and all tags of those files are the new ones.
    """
    d = new.select("id", F.col("assay_type").alias("_a"), F.col("species").alias("_s"), metadata_json(F.col("assay_type"), F.col("species"), F.col("project"), F.col("tags")).alias("_m"), F.lit(True).alias("_new"))
    both = files.join(d, "id", "left")
    hit = F.col("_new").isNotNull()
    put = {"bio_metadata": "_m", "species": "_s", "assay_type": "_a"}
    out = both.withColumns({c: F.when(hit, F.col(x)).otherwise(F.col(c)) for c, x in put.items()} | {"updated_at": F.when(hit, F.lit(now)).otherwise(F.col("updated_at")).cast("long")})
    fresh = new.select(F.col("id").alias("file_id"), F.explode("tags").alias("tag")).distinct()
    kept = tags.join(new.select(F.col("id").alias("file_id")), "file_id", "left_anti").unionByName(fresh)
    return out.select(files.columns), kept


def enrichment_texts(links: DataFrame, assets: DataFrame, datasets: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, metadata): for the index, each linked file's path with the type and species of its dataset.

    Datasets without both are left out. Of a file's several datasets the largest text counts.
    """
    d = datasets.where("dataset_type IS NOT NULL OR species IS NOT NULL").select(F.col("id").alias("dataset_id"), "dataset_type", "species")
    a = assets.select(F.col("id").alias("asset_id"), "dataset_id").join(d, "dataset_id")
    of = links.select("asset_id", "file_id").join(a, "asset_id").select("file_id", "dataset_type", "species").distinct()
    extra = F.concat_ws(" ", F.coalesce("dataset_type", F.lit("")), F.coalesce("species", F.lit("")))
    best = of.groupBy("file_id").agg(F.max(F.when(F.trim(extra) != "", extra)).alias("extra"))
    rows = best.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return rows.select(F.col("file_id").alias("id"), "path", F.concat_ws(" ", "path", "extra").alias("metadata"))


def create_snapshot(snapshots: DataFrame, trigger: str, summary: str, now: int) -> DataFrame:
    """The snapshots (id, created_at, trigger, summary) with one more."""
    one = _top(snapshots).select((F.col("_top") + 1).cast("long").alias("id"), F.lit(now).cast("long").alias("created_at"), F.lit(trigger).alias("trigger"), F.lit(summary).alias("summary"))
    return snapshots.unionByName(one)


def stamp(rows: DataFrame, ids: DataFrame, snapshot: int) -> DataFrame:
    """Rows whose id is in ``ids`` belong to the snapshot."""
    hit = rows.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("snapshot_id", F.when(F.col("_hit"), F.lit(snapshot)).otherwise(F.col("snapshot_id")).cast("long")).select(rows.columns)


def snapshot_list(snapshots: DataFrame, most: int = 20) -> DataFrame:
    """The newest snapshots with the time of day of their making."""
    return snapshots.orderBy(F.desc("id")).limit(most).select("id", F.date_format(F.timestamp_seconds("created_at"), "HH:mm:ss").alias("time"), "trigger", "summary")


def snapshot_counts(datasets: DataFrame) -> DataFrame:
    """(snapshot_id, datasets)."""
    return datasets.where("snapshot_id IS NOT NULL").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("datasets"))


def overflow(rows: DataFrame, column: str, mark: str, most: int = 10) -> DataFrame:
    """(line) of the first values in order, and one line for how many more there are."""
    some = rows.orderBy(column).limit(most).select(F.concat(F.lit(f"    {mark} "), column).alias("line"))
    more = rows.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return some.union(more.select(F.format_string(f"    ... {mark}%d more", F.col("n") - most)))


def link_counts(assets: DataFrame, links: DataFrame) -> DataFrame:
    """(assets, links): rows of both tables, repeated files too."""
    return assets.agg(F.count(F.lit(1)).alias("assets")).join(links.agg(F.count(F.lit(1)).alias("links")))


def store_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors (file_id, vector, updated_at) by file; the newest of each file counts."""
    return latest(old.unionByName(new), ["file_id"], ["updated_at"])


def vectors_of(vectors: DataFrame, ids: list[int]) -> DataFrame:
    """The stored vectors of a page of files."""
    return vectors.where(F.col("file_id").isin(ids))
