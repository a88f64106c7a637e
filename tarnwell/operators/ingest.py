"""From a scan to the catalogue: formats, rows, contexts, interpretations, their write-back, and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.functions import embed, formats, paths
from tarnwell.operators import catalog, datasets, discovery

LEAST_SCORE = 0.3


def with_formats(raw: DataFrame, detect=None) -> DataFrame:
    """Scanned files (path, source_server, size, mtime_secs, magic_bytes) with their format: a plugin's answer, else the built-in one.

    ``detect`` maps path and leading bytes to struct(file_type, mime), or null.
    """
    magic = F.when(F.length("magic_bytes") > 0, F.col("magic_bytes"))
    own = formats.detect("path", F.coalesce(magic, F.lit(b"")))
    if detect is not None:
        own = F.coalesce(detect(F.col("path"), magic)["file_type"], own)
    return raw.withColumn("format", own)


def contexts(files: DataFrame, format_col: str = "format") -> DataFrame:
    """What interpreters see of a file: no siblings and no header, three directory names, metadata files near, the format."""
    near = discovery.metadata_near(files)
    rows = files.withColumn("dir", paths.parent("path")).join(near, "dir", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("path").alias("file_path"), none.alias("siblings"), paths.ancestor_names("path").alias("directory_tree"), F.coalesce("metadata_files", none).alias("metadata_files"),
        F.lit("").alias("file_header_b64"), F.when(F.col(format_col).isNull(), none).otherwise(F.array(format_col)).alias("format_tags"),
    )


def interpretation(path: Column | str, kind: Column) -> Column:
    """struct(interpreter, score, assay_type, species, project, tags) of the best built-in interpreter."""

    def told(found: Column) -> Column:
        name = found["interpreter"]
        tags = F.when(name == "fastq", F.array(paths.paired_tag(path))).when(name == "annotation", F.array(F.lit("reference"))).otherwise(F.array().cast("array<string>"))
        return F.struct(
            name.alias("interpreter"), found["score"].alias("score"), F.when(name == "annotation", "annotation").alias("assay_type"), F.lit(None).cast("string").alias("species"),
            paths.project_of(paths.ancestor_names(path)).alias("project"), tags.alias("tags"),
        )

    # Arrays of one bind the format and the rules' answer; written out for each field they outgrow what can be compiled.
    one = F.transform(F.array(kind), lambda k: F.get(F.transform(F.array(formats.interpreter(path, k)), told), F.lit(0)))
    return F.get(one, F.lit(0))


def interpretations(files: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(id, interpreter, score, assay_type, species, project, tags) of files whose best score is ``least`` or more."""
    rows = files.select("id", interpretation("path", F.col("format")).alias("i")).where(F.col("i.score") >= least)
    return rows.select("id", "i.*")


def embedding_texts(files: DataFrame, told: DataFrame) -> DataFrame:
    """(id, text): name, format, what the interpretation says, and two directory names."""
    rows = files.join(told.select("id", F.col("assay_type").alias("_a"), F.col("species").alias("_s"), "project", "tags"), "id", "left")
    return rows.select("id", F.concat_ws(" ", paths.base_name("path"), "format", "_a", "_s", "project", "tags", paths.ancestor_names("path", 2)).alias("text"))


def run(files: DataFrame, tags: DataFrame, raw: DataFrame, now: int, scan_only: bool = False, detect=None, load=None) -> dict[str, DataFrame]:
    """The tables after a scan: files, and unless ``scan_only`` their tags and the vectors of what was scanned.

    An interpretation replaces the metadata that a file had.
    """
    found = with_formats(raw, detect).withColumnRenamed("mtime_secs", "mtime")
    after = catalog.upsert(files, found.select("path", "size", "mtime", "source_server", "format"), now)
    if scan_only:
        return {"files": after}
    seen = after.join(raw.select("path").distinct(), "path", "left_semi")
    told = interpretations(seen)
    after, tags = datasets.put_metadata(after, tags, told, now)
    vectors = embed.embed(embedding_texts(seen, told), "id", "text", load)
    return {"files": after, "tags": tags, "embeddings": vectors.select(F.col("id").alias("file_id"), "vector", F.lit(now).cast("long").alias("updated_at"))}


def siblings(files: DataFrame) -> DataFrame:
    """(dir, entries): the names of all files and directories directly in each directory."""
    rows = files.select(paths.parent("path").alias("dir"), paths.base_name("path").alias("name"))
    folders = files.select(F.explode(paths.ancestors("path")).alias("path")).distinct().select(paths.parent("path").alias("dir"), paths.base_name("path").alias("name")).where("dir != ''")
    return rows.union(folders).groupBy("dir").agg(F.sort_array(F.collect_set("name")).alias("entries"))
