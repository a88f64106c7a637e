"""Projects: rows, links to files, relations, and the merging of what several answers say."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import ancestors
from tarnwell.functions.text import truncated
from tarnwell.operators.catalog import number
from tarnwell.operators.inference import merge_projects
from tarnwell.operators.relational import NotFound


def insert(projects: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """Append projects with new ids, by name; names may repeat. Columns that ``new`` lacks are null."""
    top = projects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = number(new, ["name"], "_n").join(F.broadcast(top)).withColumn("id", (F.col("_top") + F.col("_n")).cast("long")).drop("_n", "_top")
    rows = rows.withColumns({c: F.lit(now).cast("long") for c in ("created_at", "updated_at") if c in projects.columns})
    missing = {c: F.lit(None).cast(projects.schema[c].dataType) for c in projects.columns if c not in rows.columns}
    return projects.unionByName(rows.withColumns(missing).select(projects.columns))


def link(links: DataFrame, new: DataFrame) -> DataFrame:
    """(project_id, file_id) with new pairs; known ones are ignored."""
    return links.select("project_id", "file_id").union(new.select("project_id", "file_id")).distinct()


def relate(relations: DataFrame, new: DataFrame) -> DataFrame:
    """Relations (a, b, relation, score); a new row replaces that of its pair and kind. Of repeats the largest score counts."""
    key = ["a", "b", "relation"]
    last = new.groupBy(*key).agg(F.max("score").alias("score"))
    return relations.join(last, key, "left_anti").select(*key, "score").unionByName(last)


def update_species(projects: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Species, its source and confidence of ``changes`` (id, species, source, confidence) for their projects."""
    d = changes.select("id", F.col("species").alias("_s"), F.col("source").alias("_o"), F.col("confidence").alias("_c"), F.lit(True).alias("_new"))
    both, hit = projects.join(d, "id", "left"), F.col("_new").isNotNull()
    put = {"species": F.col("_s"), "species_source": F.col("_o"), "species_confidence": F.col("_c"), "updated_at": F.lit(now).cast("long")}
    return both.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in put.items()}).select(projects.columns)


def by_name(projects: DataFrame, name: str) -> DataFrame:
    """The first project of a name."""
    return projects.where(F.col("name") == name).orderBy("id").limit(1)


def file_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("project_id").agg(F.count(F.lit(1)).alias("files"))


def listing(projects: DataFrame, links: DataFrame) -> DataFrame:
    """All projects with the text columns of a list: cut name, assay, species with confidence, server, files."""
    known = lambda c: F.coalesce(c, F.lit("?"))
    rows = projects.join(file_counts(links), projects["id"] == F.col("project_id"), "left")
    species = F.format_string("%s (%s)", known("species"), known("species_confidence"))
    return rows.select("id", truncated("name", 25).alias("name"), known("assay_type").alias("assay"), species.alias("species"), known("source_server").alias("server"), F.coalesce("files", F.lit(0)).alias("files"))


def show(projects: DataFrame, links: DataFrame, relations: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(the project with its number of files, its relations by name); NotFound if there is none of the name."""
    own = by_name(projects, name)
    first = own.select("id").first()
    if first is None:
        raise NotFound(name)
    files = links.where(F.col("project_id") == first.id).agg(F.count(F.lit(1)).alias("files"))
    near = relations.where((F.col("a") == first.id) | (F.col("b") == first.id))
    near = near.select(F.when(F.col("a") == first.id, F.col("b")).otherwise(F.col("a")).alias("id"), "relation", "score")
    return own.join(files), near.join(projects.select("id", "name"), "id").select("name", "relation", "score")


def of_paths(projects: DataFrame, links: DataFrame, files: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, project): the first project of the file at each path."""
    own = files.join(paths.select("path").distinct(), "path", "left_semi").select(F.col("id").alias("file_id"), "path")
    named = own.join(links, "file_id").join(projects.select(F.col("id").alias("project_id"), "name"), "project_id")
    return named.groupBy("path").agg(F.min_by("name", "project_id").alias("project"))


def files_below(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(project_id, file_id): files at or below one of a project's directories (``dirs``, an array), by their ancestors."""
    dirs = projects.select(F.col("id").alias("project_id"), F.explode("dirs").alias("dir")).distinct()
    up = files.select(F.col("id").alias("file_id"), F.explode(ancestors("path", itself=True)).alias("dir"))
    return up.join(dirs, "dir").select("project_id", "file_id").distinct()


def first_directory(projects: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, project_id): the first project, by id, with a directory at or above each file."""
    return files_below(projects, files).groupBy("file_id").agg(F.min("project_id").alias("project_id"))


def uncovered(first: DataFrame, second: DataFrame) -> DataFrame:
    """Projects of a first pass with a directory that no project of the second has, and skipped ones; ``dirs`` are arrays.

    Together with the second pass's projects they are the reconciled list.
    """
    deep = second.where(~F.coalesce("skip", F.lit(False))).select(F.explode("dirs").alias("_d")).distinct()
    mine = first.select("id", F.explode("dirs").alias("_d")).join(deep, "_d", "left_anti").select("id").distinct()
    return first.join(mine, "id", "left_semi").union(first.where(F.coalesce("skip", F.lit(False))).join(mine, "id", "left_anti"))


def by_names(projects: DataFrame) -> DataFrame:
    """(name, dirs, projects): projects of one name in several batches are one, with the directories of all, in order."""
    rows = projects.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("id", "dirs"))).alias("p"))
    return rows.select("name", F.flatten("p.dirs").alias("dirs"), F.size("p").cast("long").alias("projects"))


def merged(projects: DataFrame) -> DataFrame:
    """(id, name, species, dirs, summary): projects of one species and name prefix as the first of them; see ``merge_projects``.

    Directories are joined in order; summaries, without empty ones, by "; ".
    """
    rows = merge_projects(projects)
    told = F.array_sort(F.collect_list(F.struct("id", "name", "dirs", "summary")))
    out = rows.groupBy("base", "species").agg(told.alias("p"))
    summaries = F.filter("p.summary", lambda s: s.isNotNull() & (s != ""))
    return out.select(F.col("base").alias("id"), F.get("p", F.lit(0))["name"].alias("name"), "species", F.flatten("p.dirs").alias("dirs"), F.array_join(summaries, "; ").alias("summary"))


def top_related(relations: DataFrame, k: int = 10) -> DataFrame:
    """(a, b, relation, score, rank): each project's strongest relations, either way round."""
    both = relations.select("a", "b", "relation", "score").union(relations.select("b", "a", "relation", "score"))
    w = Window.partitionBy("a").orderBy(F.desc("score"), "b", "relation")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
