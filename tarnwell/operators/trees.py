"""Directory trees as rows: file lists, bounded depth, top subdirectories, annotated lines."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import ancestors, base_name, depth, parent
from tarnwell.operators import inference
from tarnwell.operators.discovery import extension_tops, signals, with_dir
from tarnwell.sources.store import durable


def file_list(files: DataFrame, shown: int = 8) -> DataFrame:
    """(dir, files, types, sample): extensions by name with counts, ``shown`` of them and how many more; the first file name."""
    n = with_dir(files).groupBy("dir", "ext").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("sample"))
    ranked = n.withColumn("_r", F.row_number().over(Window.partitionBy("dir").orderBy("ext")))
    part = F.when(F.col("_r") <= shown, F.struct("_r", F.format_string(".%s×%d", "ext", "n").alias("text")))
    out = ranked.groupBy("dir").agg(F.sum("n").alias("files"), F.array_sort(F.collect_list(part)).alias("parts"), F.count(F.lit(1)).alias("_k"), F.min("sample").alias("sample"))
    more = F.when(F.col("_k") > shown, F.format_string(", ... +%d more types", F.col("_k") - shown)).otherwise("")
    return out.select("dir", "files", F.concat(F.array_join("parts.text", ", "), more).alias("types"), "sample")


def bounded(files: DataFrame, levels: int) -> DataFrame:
    """(path, depth, files, bytes) of the directories down to a depth, with all files below them."""
    up = files.select("size", F.explode(F.filter(ancestors("path"), lambda p: depth(p) <= levels)).alias("path"))
    return up.groupBy("path").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).withColumn("depth", depth("path"))


def top_subdirs(files: DataFrame, k: int = 15) -> DataFrame:
    """(parent, dir, files, rank): the subdirectories of each directory with the most files of their own."""
    n = with_dir(files).groupBy("dir").agg(F.count(F.lit(1)).alias("files")).withColumn("parent", parent("dir"))
    w = Window.partitionBy("parent").orderBy(F.desc("files"), "dir")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Files from which a directory is described by kinds of files, and from which a flat one is not opened.
COMPRESS_FROM, LARGE_FROM, SAMPLES = 200, 10_000, 5


def light(files: DataFrame, root: str, levels: int = 3) -> DataFrame:
    """(path, depth, files, subdirs, types) of ``root`` and the directories below it, to ``levels`` levels: own files, children, five commonest extensions."""
    level = len(root.split("/")) - 1
    here = (F.col("path") == root) | F.startswith("path", F.lit(f"{root}/"))
    dirs = files.select(F.explode(ancestors("path")).alias("path")).distinct().where(here).withColumn("depth", depth("path") - level)
    own = with_dir(files).groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("files"))
    tops = extension_tops(files).withColumn("_t", F.struct(-F.col("n"), F.col("ext"), F.format_string("%s×%d", "ext", "n").alias("text")))
    tops = tops.groupBy(F.col("dir").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("_t"))["text"], ",").alias("types"))
    below = dirs.where("depth > 0").groupBy(parent("path").alias("path")).agg(F.count(F.lit(1)).alias("subdirs"))
    rows = dirs.where(F.col("depth") < levels).join(own, "path", "left").join(below, "path", "left").join(tops, "path", "left")
    return rows.select("path", "depth", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("subdirs", F.lit(0)).alias("subdirs"), F.coalesce("types", F.lit("")).alias("types"))


def compressed(files: DataFrame, least: int = COMPRESS_FROM, samples: int = SAMPLES) -> DataFrame:
    """(path, pattern) of directories with over ``least`` files of their own: each extension with its count and first names, by extension."""
    rows = with_dir(files).select(F.col("dir").alias("path"), "ext", "name")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path", "ext").orderBy("name")))
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("_r") <= samples, F.col("name")))), ", ")
    kinds = ranked.groupBy("path", "ext").agg(F.count(F.lit(1)).alias("n"), names.alias("names"))
    told = F.array_sort(F.collect_list(F.struct("ext", F.format_string("%s×%d [%s]", "ext", "n", "names").alias("text"))))["text"]
    return kinds.groupBy("path").agg(F.sum("n").alias("n"), F.array_join(told, "; ").alias("pattern")).where(F.col("n") > least).drop("n")


def prompt_lines(files: DataFrame, root: str, levels: int = 4, least: int = COMPRESS_FROM, large: int = LARGE_FROM) -> DataFrame:
    """(path, line): an indented line for each directory; large ones are told by patterns, and large flat ones are marked to be left alone.

    Sorted by path with a slash appended, the lines are the tree.
    """
    some = with_dir(files).withColumn("_r", F.row_number().over(Window.partitionBy("dir").orderBy("name"))).where(F.col("_r") <= SAMPLES)
    some = some.groupBy(F.col("dir").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("names"))
    rows = light(files, root, levels).join(compressed(files, least), "path", "left").join(some, "path", "left")
    head = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("📁 "), base_name("path"))
    count = F.format_string("%d files: %s", "files", "types")
    leaf = F.when(F.col("pattern").isNotNull(), F.concat(F.lit("  ("), "pattern", F.lit(")"))).otherwise(F.concat(F.lit("  ("), count, F.lit(")"), F.coalesce(F.concat(F.lit("  e.g. "), "names"), F.lit(""))))
    flat = F.concat(F.lit("  (LARGE FLAT DIR"), F.coalesce(F.concat(F.lit(" — "), "pattern"), F.lit("")), F.lit(" — skip deep listing)"))
    inner = F.concat(F.lit("/  ("), count, F.format_string(", %d subdirs)", "subdirs"), F.coalesce(F.concat(F.lit(" ["), "pattern", F.lit("]")), F.lit("")))
    return rows.select("path", F.concat(head, F.when(F.col("subdirs") > 0, inner).when(F.col("files") > large, flat).otherwise(leaf)).alias("line"))


DEEPER = "datasets array<string>, deeper array<string>"


def deepen_all(files: DataFrame, root: str, connect: Callable[[], Callable[[str], str]], rounds: int = 3, **asking) -> DataFrame:
    """(path, round): datasets found in up to ``rounds`` rounds, each round one frame of the directories that are open.

    A round makes the lines of all open directories, asks about each (``inference.ask``) and reads from the answers, JSON with ``datasets`` and
    ``deeper``, what was found and what to open next, relative paths being below the directory asked about. A directory is opened once; an answer that is
    no such JSON finds nothing. Nothing but the number of open directories reaches the driver.
    """
    spark = files.sparkSession
    d = Described(*[durable(x) for x in described(files)])
    open_ = spark.createDataFrame([(root,)], "top string")
    seen, found = open_, spark.createDataFrame([], "path string, round int")
    for n in range(rounds):
        rows = annotated_each(d, open_).groupBy("top").agg(F.array_sort(F.collect_list(F.struct(F.concat("path", F.lit("/")).alias("at"), "line")))["line"].alias("lines"))
        prompts = rows.select(F.col("top").alias("key"), F.concat(F.lit("# "), "top", F.lit("\n"), F.array_join("lines", "\n")).alias("prompt"))
        told = durable(inference.ask(prompts, connect, "datasets", **asking).select(F.col("key").alias("top"), F.from_json("response", DEEPER).alias("a")))
        each = lambda c: told.select("top", F.explode(f"a.{c}").alias("p")).select(F.when(F.startswith("p", F.lit("/")), F.col("p")).otherwise(F.concat("top", F.lit("/"), "p")).alias("path")).distinct()
        found = durable(found.union(each("datasets").join(found, "path", "left_anti").withColumn("round", F.lit(n))))
        open_ = durable(each("deeper").select(F.col("path").alias("top")).join(seen, "top", "left_anti"))
        if open_.limit(1).count() == 0:
            break
        seen = durable(seen.union(open_))
    return found


def deepen(files: DataFrame, root: str, choose: Callable[[str, list[str]], tuple[list[str], list[str]]], rounds: int = 3) -> list[str]:
    """Paths of datasets found in up to ``rounds`` rounds.

    ``choose`` gets a directory and its lines and answers with the datasets in it and the directories to look at next, relative
    ones to it. Lines of one directory and its answers are what the driver holds.
    """
    open_, found, seen = [root], [], {root}
    for _ in range(rounds):
        below = []
        for top in open_:
            lines = [r.line for r in annotated(files, top).orderBy(F.concat("path", F.lit("/"))).collect()]
            chosen, deeper = ([p if p.startswith("/") else f"{top}/{p}" for p in some] for some in choose(top, lines))
            found += [p for p in chosen if p not in found]
            below += [p for p in deeper if p not in seen and not seen.add(p)]
        open_ = below
        if not open_:
            break
    return found


class Described(NamedTuple):
    """What the lines of any directory are made of; one row for each directory in each."""

    signals: DataFrame
    own: DataFrame
    tops: DataFrame


def described(files: DataFrame) -> Described:
    own = with_dir(files).groupBy(F.col("dir").alias("path")).agg(F.count(F.lit(1)).alias("files"))
    tops = extension_tops(files).withColumn("_t", F.struct(-F.col("n"), F.col("ext"), F.format_string("%s×%d", "ext", "n").alias("text")))
    return Described(signals(files, 1), own, tops.groupBy(F.col("dir").alias("path")).agg(F.array_join(F.array_sort(F.collect_list("_t"))["text"], ",").alias("types")))


def annotated(files: DataFrame, root: str) -> DataFrame:
    """(path, line) of ``root``; see ``annotated_each``."""
    spark = files.sparkSession
    return annotated_each(described(files), spark.createDataFrame([(root,)], "top string")).select("path", "line")


def annotated_each(d: Described, roots: DataFrame) -> DataFrame:
    """(top, path, line): for each root (top) an indented line for each directory at or below it that a reader has to judge.

    Directories with domain files, or above such, are one line and not opened, but for the root; deep empty ones and all
    below them are left out. Sorted by path with a slash appended, the lines are the tree. Directories meet the roots above them by equality.
    """
    up_ = d.signals.select("path", "signal", F.explode(ancestors("path", itself=True)).alias("top"))
    s = up_.join(roots.select("top").distinct(), "top").withColumn("indent", depth("path") - depth("top"))
    below = s.where("indent > 0").groupBy("top", parent("path").alias("path")).agg(F.count(F.lit(1)).alias("sub"), F.count_if(F.col("signal") == "Bio").alias("bio"))
    bio, empty = F.col("signal").isin("Bio", "PropagatedBio"), (F.col("signal") == "Empty") & (F.col("indent") > 1)
    shut = s.where((bio & (F.col("indent") > 0)) | empty).select("top", F.col("path").alias("_up"))
    up = s.select("top", "path", F.explode(ancestors("path")).alias("_up")).join(shut, ["top", "_up"], "left_semi").select("top", "path").distinct()
    rows = s.where(~empty).join(up, ["top", "path"], "left_anti").join(d.own, "path", "left").join(d.tops, "path", "left").join(below, ["top", "path"], "left").fillna(0, ["files", "sub", "bio"])
    icon = F.when(F.col("signal") == "PropagatedBio", "BIO↑").when(F.col("signal") == "Bio", "BIO").when(F.col("signal") == "Empty", "EMPTY").otherwise("?")
    head = F.concat(F.repeat(F.lit("  "), F.col("indent")), icon, F.lit(" "), base_name("path"), F.lit("/ ("))
    short = F.concat(F.format_string("auto:%d files", "files"), F.coalesce(F.concat(F.lit(" ["), "types", F.lit("]")), F.lit("")), F.format_string(" sub:%d/%d)", "bio", "sub"))
    sub = F.when(F.col("sub") > 0, F.format_string(" sub:%d", "sub")).otherwise("")
    info = F.when(F.col("sub") > 0, F.format_string(" | sub:%d bio:%d", "sub", "bio")).otherwise("")
    full = F.concat(F.format_string("f:%d ", "files"), F.coalesce("types", F.lit("none")), sub, F.lit(")"), info)
    return rows.select("top", "path", F.concat(head, F.when(bio & (F.col("indent") > 0), short).otherwise(full)).alias("line"))
