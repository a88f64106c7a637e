"""Listings of files: local trees, TSV and JSON-lines listings, and merged views of them."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.catalog import latest

SCHEMA = "path string, size long, mtime_secs long"


SCANNED = "path string, source_server string, size long, mtime_secs long, magic_bytes binary, mime_type string"
MAGIC_BYTES = 512
#: Directories from which a listing is dealt to that many tasks, and rows of a batch.
LEAST_TASKS, BATCH = 64, 4096


def pruned(path: str, patterns: list[str]) -> bool:
    """Whether a file, or a directory with all below it, is left out; see ``paths.excluded``."""
    name = os.path.basename(path)
    return any(path.endswith(p[1:]) if p.startswith("*.") else name.startswith(".") if p == ".*" else path.startswith(p) for p in patterns)


def leading(path: str) -> bytes:
    """The first bytes of a file; none if it cannot be read."""
    try:
        with open(path, "rb") as f:
            return f.read(MAGIC_BYTES)
    except OSError:
        return b""


def describe(path: str, server: str, magic: bool) -> tuple:
    """The row of a file; size and time are 0, and the leading bytes empty, if it cannot be read."""
    try:
        s = os.stat(path)
        size, mtime = s.st_size, int(s.st_mtime)
    except OSError:
        size, mtime = 0, 0
    head = leading(path) if magic else b""
    return path, server, size, mtime, head, mimetypes.guess_type(path)[0] or "application/octet-stream"


def _entries(folder: str, patterns: list[str]) -> tuple[list[str], list[str]]:
    """(files, directories) of a directory, without links and what is left out; none if it cannot be read."""
    try:
        found = [e for e in os.scandir(folder) if not pruned(e.path, patterns)]
        return [e.path for e in found if e.is_file(follow_symlinks=False)], [e.path for e in found if e.is_dir(follow_symlinks=False)]
    except OSError:
        return [], []


def _split(roots: list[str], patterns: list[str]) -> list[tuple[str, bool]]:
    """(directory, whether with all below): level by level, until there are LEAST_TASKS trees or nothing is left below."""
    done, open_ = [], [r for r in roots if not pruned(r, patterns)]
    while open_ and len(open_) < LEAST_TASKS:
        done += [(d, False) for d in open_]
        open_ = [x for d in open_ for x in _entries(d, patterns)[1]]
    return done + [(d, True) for d in open_]


def scan_tree(spark: SparkSession, roots: list[str], exclude: list[str] | None = None, *, server: str = "local", precise: bool = False, skip_magic: list[str] | None = None) -> DataFrame:
    """Regular files under the roots (SCANNED columns), without following links; unreadable ones are skipped.

    A directory that ``exclude`` matches is not entered. Leading bytes are read if ``precise``, but for files directly in a directory of
    ``skip_magic``. Trees are split into tasks level by level; a task yields rows in batches.
    """
    patterns, skipped = list(exclude or []), frozenset(skip_magic or [])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for top, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                open_ = [top]
                while open_:
                    folder = open_.pop()
                    names, below = _entries(folder, patterns)
                    if deep:
                        open_ += below
                    for path in names:
                        held.append(describe(path, server, precise and folder not in skipped))
                        if len(held) >= BATCH:
                            yield _batch(held)
                            held = []
            if held:
                yield _batch(held)

    tops = _split(roots, patterns)
    return spark.createDataFrame(tops, "top string, deep boolean").repartition(max(1, len(tops))).mapInArrow(walk, SCANNED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("path", pa.string()), ("source_server", pa.string()), ("size", pa.int64()), ("mtime_secs", pa.int64()), ("magic_bytes", pa.binary()), ("mime_type", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [n for n, _ in kinds])


def scan_single(spark: SparkSession, path: str, server: str = "local", precise: bool = False) -> DataFrame:
    """The row of one file; none if it is no file."""
    return spark.createDataFrame([describe(path, server, precise)] if os.path.isfile(path) else [], SCANNED)


def stat_paths(paths: DataFrame, server: str = "local") -> DataFrame:
    """(path, exists, SCANNED columns) of changed paths as they are now; leading bytes are always read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, os.path.isfile(p)) for p in batch.column(0).to_pylist()]
            told = [describe(p, server, True) if ok else (p, server, 0, 0, b"", None) for p, ok in rows]
            if told:
                out = _batch(told)
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array([ok for _, ok in rows], pa.bool_())], [*out.schema.names, "exists"])

    return paths.select("path").distinct().mapInArrow(run, SCANNED + ", exists boolean")


def decode_base64(text: Column | str) -> Column:
    """Bytes of base64 text up to its padding, white space skipped; empty for anything else."""
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"\s", "")
    head = F.split_part(t, F.lit("="), F.lit(1))
    # A last group of one character holds no byte.
    whole = F.when(F.length(head) % 4 == 1, F.substr(head, F.lit(1), F.length(head) - 1)).otherwise(head)
    padded = F.concat(whole, F.repeat(F.lit("="), F.pmod(-F.length(whole), F.lit(4))))
    return F.when(head.rlike("^[A-Za-z0-9+/]*$"), F.unbase64(padded)).otherwise(F.lit(b""))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Listings of path, size and fractional mtime; malformed rows are dropped."""
    rows = spark.read.schema("path string, size long, mtime double").option("mode", "DROPMALFORMED").csv(path, sep="\t")
    return rows.select("path", "size", F.col("mtime").cast("long").alias("mtime_secs")).where(F.col("size").isNotNull() & F.col("mtime_secs").isNotNull())


def read_jsonl(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """JSON-lines listings; lines that are no JSON are skipped, missing fields are "" and 0; ``since`` is exclusive."""
    rows = spark.read.schema(SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    rows = rows.where("_bad IS NULL").select(F.coalesce("path", F.lit("")).alias("path"), F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("mtime_secs", F.lit(0)).alias("mtime_secs"))
    return rows if since is None else rows.where(F.col("mtime_secs") > since)


def merged(cached: DataFrame, newer: DataFrame) -> DataFrame:
    """A cached listing and newer rows; the latest row of each path wins."""
    return latest(cached.unionByName(newer), ["path"], ["mtime_secs", "size"])
