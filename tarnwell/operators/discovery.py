"""Directories: fingerprints, signals, uniform ones, scan targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import METADATA_FILES, ancestors, base_name, depth, extension, in_noise, is_bio, key_file, parent, trivial_version
from tarnwell.functions.text import truncated

UNIFORM = 100


def with_dir(files: DataFrame) -> DataFrame:
    return files.where(~in_noise("path")).withColumns({"dir": parent("path"), "name": base_name("path"), "ext": extension(base_name("path"))})


def directories(files: DataFrame) -> DataFrame:
    """(path, depth) of every directory that holds files at any depth."""
    return files.where(~in_noise("path")).select(F.explode(ancestors("path")).alias("path")).distinct().withColumn("depth", depth("path"))


def extension_tops(files: DataFrame, k: int = 5) -> DataFrame:
    """(dir, ext, n): the k commonest extensions of each directory, ties by name."""
    n = with_dir(files).groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dir").orderBy(F.desc("n"), "ext")
    return n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def fingerprints(files: DataFrame, samples: int = 8) -> DataFrame:
    """(dir, files, extensions, has_bio, samples): the first names of each directory, by a bounded rank, not a full list."""
    rows = with_dir(files)
    w = Window.partitionBy("dir").orderBy("name")
    some = rows.select("dir", "name", F.row_number().over(w).alias("_r")).where(F.col("_r") <= samples).groupBy("dir").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("samples"))
    stats = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("ext").alias("extensions"), F.max(is_bio("ext")).alias("has_bio"))
    return stats.join(some, "dir")


def signals(files: DataFrame, levels: int | None = None) -> DataFrame:
    """(path, signal): Bio with own domain files, PropagatedBio with some below (to ``levels`` levels), else Unknown or Empty."""
    rows = with_dir(files)
    up = rows.select("dir", is_bio("ext").alias("bio"), F.explode(ancestors("path")).alias("path"))
    gap = depth("dir") - depth("path")
    near = F.lit(True) if levels is None else gap <= levels
    own = F.max((gap == 0) & F.col("bio"))
    below = F.max((gap > 0) & near & F.col("bio"))
    files_ = F.count_if(gap == 0)
    return up.groupBy("path").agg(F.when(own, "Bio").when(below, "PropagatedBio").when(files_ == 0, "Empty").otherwise("Unknown").alias("signal"))


def child_signals(files: DataFrame) -> DataFrame:
    """(path, bio_children): children of each directory with domain files of their own."""
    bio = with_dir(files).groupBy("dir").agg(F.max(is_bio("ext")).alias("bio")).where("bio")
    return bio.groupBy(parent("dir").alias("path")).agg(F.count(F.lit(1)).alias("bio_children"))


def uniform(files: DataFrame, least: int = UNIFORM) -> DataFrame:
    """(dir, files, ext): directories of ``least`` or more files with one extension and no directories below."""
    rows = with_dir(files)
    inner = directories(files).select(parent("path").alias("dir")).distinct()
    stats = rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("ext").alias("_e"), F.min("ext").alias("ext"))
    return stats.where((F.col("files") >= least) & (F.col("_e") == 1)).join(inner, "dir", "left_anti").drop("_e")


def skips(dirs: DataFrame, targets: DataFrame) -> DataFrame:
    """Directories that are neither a target nor below one."""
    up = dirs.select("path", F.explode(ancestors("path", itself=True)).alias("_up"))
    under = up.join(targets.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return dirs.join(under, "path", "left_anti")


def targets(signal_rows: DataFrame, hinted: DataFrame | None = None) -> DataFrame:
    """(path): directories with domain files of their own, and those that were hinted at."""
    own = signal_rows.where("signal = 'Bio'").select("path")
    return (own if hinted is None else own.union(hinted.select("path"))).distinct()


def candidates(target_rows: DataFrame, hints: DataFrame) -> DataFrame:
    """(path, dataset_type, confidence): the hints, and each target without one as "other" of low confidence."""
    rest = target_rows.join(hints.select("path"), "path", "left_anti")
    return hints.select("path", "dataset_type", "confidence").unionByName(rest.select("path", F.lit("other").alias("dataset_type"), F.lit("low").alias("confidence")))


def ambiguous(files: DataFrame) -> DataFrame:
    """(path, subdirs): containers of domain directories, unless all their subdirectories are bare versions or obsolete."""
    box = signals(files, 1).where("signal = 'PropagatedBio'").select("path")
    below = directories(files).select(parent("path").alias("path"), base_name("path").alias("sub")).groupBy("path")
    below = below.agg(F.count(F.lit(1)).alias("subdirs"), F.count_if(~trivial_version("sub")).alias("_telling"))
    return box.join(below.where("_telling > 0").drop("_telling"), "path")


def children(rows: DataFrame) -> DataFrame:
    """(parent, child): rows whose parent directory is a row too."""
    return rows.select(F.col("path").alias("child"), parent("path").alias("parent")).join(rows.select(F.col("path").alias("parent")), "parent", "left_semi").select("parent", "child")


def metadata_near(files: DataFrame) -> DataFrame:
    """(dir, metadata_files): files with a describing name in each directory, then in its parent, in the names' order.

    Directories are joined, not files: at most 22 names come to each.
    """
    names = F.array(*[F.lit(n) for n in METADATA_FILES])
    named = files.select("path", parent("path").alias("at"), F.array_position(names, base_name("path")).alias("_n")).where("_n > 0")
    dirs = files.select(parent("path").alias("dir")).distinct()
    places = dirs.select("dir", F.posexplode(F.array(F.col("dir"), parent("dir"))).alias("_up", "at"))
    found = places.join(named, "at").groupBy("dir").agg(F.array_sort(F.collect_list(F.struct("_up", "_n", "path")))["path"].alias("metadata_files"))
    return found


def sample_display(files: DataFrame, others: int = 5, most: int = 120, samples: int = 8) -> DataFrame:
    """(dir, shown) of each directory's first ``samples`` names: kinds that matter first, then up to ``others`` more, cut to ``most`` characters."""
    w = Window.partitionBy("dir").orderBy("name")
    some = with_dir(files).select("dir", "name", F.row_number().over(w).alias("_r")).where(F.col("_r") <= samples)
    names = some.groupBy("dir").agg(F.sort_array(F.collect_list("name")).alias("names"))
    shown = F.concat(F.filter("names", key_file), F.slice(F.filter("names", lambda n: ~key_file(n)), 1, others))
    return names.select("dir", truncated(F.array_join(shown, ", "), most).alias("shown"))
