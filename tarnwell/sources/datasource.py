"""Listings as data sources: ``spark.read.format`` for trees, TSV and JSON lines, and ``spark.readStream.format`` for a watched tree.

``register(spark)`` makes the formats known:

- ``file_tree``: regular files under ``path`` (a root, or a JSON array of roots); options ``exclude`` and ``skip_magic`` (JSON arrays), ``server``, ``precise``.
- ``file_listing_tsv``, ``file_listing_jsonl``: listings of path, size and time; ``path`` is a file or a folder, ``split_bytes`` the size of a task.
- ``file_watch``: a stream of what changed under ``path``, see ``WatchReader``.

Comparisons of path, size and time and the ends and beginnings of paths are taken over from the query: directories that
no path of the query lies in are not entered, names are looked at before a file is, and sizes and times before its leading bytes are read.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains,
    StringEndsWith, StringStartsWith,
)

from tarnwell.sources import listing

SPLIT_BYTES = 64 << 20
#: Seconds that a watch stays behind the clock, as file systems stamp changes by a coarse one.
LAG = 0.1


def _strings(text: str | None) -> list[str]:
    """A JSON array, or one plain string."""
    if not text:
        return []
    return list(json.loads(text)) if text.lstrip().startswith("[") else [text]


class Wanted:
    """Conditions that a source took over, by column. Each tells whether a value that is not null can stay."""

    TESTS: dict[type, Callable] = {
        EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x,
        LessThanOrEqual: lambda v, x: v <= x, StringStartsWith: lambda v, x: v.startswith(x), StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
    }

    def __init__(self, columns: Sequence[str]) -> None:
        self.columns, self.taken = tuple(columns), []

    def take(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps what it can test and gives back the rest."""
        for f in filters:
            if type(f) in self.TESTS and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.taken.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def keeps(self, column: str, value) -> bool:
        return all(self.TESTS[kind](value, x) for c, kind, x in self.taken if c == column)

    def beginnings(self) -> list[tuple[str, ...]]:
        """For each condition that fixes how a path begins, the beginnings that it allows."""
        kinds = {StringStartsWith: lambda x: (x,), EqualTo: lambda x: (x,), In: tuple}
        return [kinds[kind](x) for c, kind, x in self.taken if c == "path" and kind in kinds]

    def enters(self, folder: str) -> bool:
        """Whether a path that can stay may lie below a directory."""
        at = folder.rstrip("/") + "/"
        return all(any(b.startswith(at) or at.startswith(b) for b in each) for each in self.beginnings())


class Tops(InputPartition):
    """Directories of one task, each with all below it or only its own files."""

    def __init__(self, tops: list[tuple[str, bool]]) -> None:
        self.tops = tops


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = _strings(options.get("path"))
        self.exclude, self.skip = _strings(options.get("exclude")), frozenset(_strings(options.get("skip_magic")))
        self.server, self.precise = options.get("server", "local"), options.get("precise", "false").lower() == "true"
        self.wanted = Wanted(("path", "size", "mtime_secs"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.wanted.take(filters)

    def _below(self, folder: str) -> tuple[list[str], list[str]]:
        names, below = listing._entries(folder, self.exclude)
        return [p for p in names if self.wanted.keeps("path", p)], [d for d in below if self.wanted.enters(d)]

    def partitions(self) -> Sequence[InputPartition]:
        done: list[tuple[str, bool]] = []
        open_ = [r for r in self.roots if not listing.pruned(r, self.exclude) and self.wanted.enters(r)]
        while open_ and len(open_) < listing.LEAST_TASKS:
            done += [(d, False) for d in open_]
            open_ = [x for d in open_ for x in self._below(d)[1]]
        # Directories that were opened to split the tree hold few files of their own, so one task reads them all.
        return [*([Tops(done)] if done else []), *[Tops([(d, True)]) for d in open_]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        # Spark gives None where there are no partitions.
        for top, deep in partition.tops if partition else ():
            open_ = [top]
            while open_:
                folder = open_.pop()
                names, below = self._below(folder)
                if deep:
                    open_ += below
                for path in names:
                    row = listing.describe(path, self.server, False)
                    if not (self.wanted.keeps("size", row[2]) and self.wanted.keeps("mtime_secs", row[3])):
                        continue
                    if self.precise and folder not in self.skip:
                        row = (*row[:4], listing.leading(path), row[5])
                    held.append(row)
                    if len(held) >= listing.BATCH:
                        yield listing._batch(held)
                        held = []
        if held:
            yield listing._batch(held)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return listing.SCANNED

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class Span(InputPartition):
    """The lines that begin in a part of a file."""

    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


def file_system(path: str):
    """(file system, path on it) of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def lines(path: str, start: int, end: int, block: int = 1 << 20) -> Iterator[bytes]:
    """Lines whose first byte lies from ``start`` to before ``end``."""
    files, at = file_system(path)
    with files.open_input_file(at) as f:
        here, rest = start, b""
        if start:
            # The line that spans the start belongs to the task before, unless it ends right there.
            f.seek(start - 1)
            while True:
                data = f.read(block)
                if not data:
                    return
                cut = data.find(b"\n")
                if cut >= 0:
                    here += cut if not rest else 0
                    rest = data[cut + 1 :]
                    break
                here += len(data)
        while True:
            while (cut := rest.find(b"\n")) >= 0:
                if here >= end:
                    return
                yield rest[:cut]
                here, rest = here + cut + 1, rest[cut + 1 :]
            if here >= end:
                return
            data = f.read(block)
            if not data:
                if rest:
                    yield rest
                return
            rest += data


def tsv_row(line: bytes) -> tuple[str, int, int] | None:
    """Path, size and time, which may have a fraction, cut off; None for a malformed line."""
    try:
        path, size, mtime = line.rstrip(b"\r").decode().split("\t")
        return path, int(size), int(float(mtime))
    except (ValueError, OverflowError):
        return None


def jsonl_row(line: bytes) -> tuple[str, int, int] | None:
    """A JSON object's path, size and mtime_secs, "" and 0 where they are missing; None for what is none."""
    try:
        row = json.loads(line)
        return (row.get("path") or "", int(row.get("size") or 0), int(row.get("mtime_secs") or 0)) if isinstance(row, dict) else None
    except (ValueError, TypeError):
        return None


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str], parse: Callable[[bytes], tuple[str, int, int] | None]) -> None:
        self.paths, self.split, self.parse = _strings(options.get("path")), int(options.get("split_bytes", SPLIT_BYTES)), parse
        self.wanted = Wanted(("path", "size", "mtime_secs"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return self.wanted.take(filters)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        out: list[InputPartition] = []
        for path in self.paths:
            files, at = file_system(path)
            scheme = path[: path.index("://") + 3] if "://" in path else ""
            found = files.get_file_info(at)
            if found.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            each = [found] if found.type == fs.FileType.File else files.get_file_info(fs.FileSelector(at, recursive=True))
            for f in each:
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")):
                    out += [Span(scheme + f.path, lo, min(lo + self.split, f.size)) for lo in range(0, f.size, self.split)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int]] = []
        for line in lines(partition.path, partition.start, partition.end) if partition else ():
            row = self.parse(line) if line.strip() else None
            if row is not None and self.wanted.keeps("path", row[0]) and self.wanted.keeps("size", row[1]) and self.wanted.keeps("mtime_secs", row[2]):
                held.append(row)
                if len(held) >= listing.BATCH:
                    yield _listed(held)
                    held = []
        if held:
            yield _listed(held)


def _listed(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))], ["path", "size", "mtime_secs"])


class TsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing_tsv"

    def schema(self) -> str:
        return listing.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options, tsv_row)


class JsonlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing_jsonl"

    def schema(self) -> str:
        return listing.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options, jsonl_row)


WATCHED = "path string, kind string, size long, mtime_secs long, names array<string>, seen timestamp"


class Window(InputPartition):
    def __init__(self, tops: list[tuple[str, bool]], start: float, end: float) -> None:
        self.tops, self.start, self.end = tops, start, end


class WatchReader(DataSourceStreamReader):
    """What changed under the roots since the batch before: "file" rows for new and changed files, "dir" rows with the ``names`` that a directory still has.

    An offset is a time, and a batch what the file system stamped from one to the next, so nothing is kept between batches and
    a restart goes on from its checkpoint without repeating. Each batch is read by tasks, a subtree each. A removed file leaves
    no stamp of its own but changes its directory, whose remaining names tell what is gone. The first batch holds what changes after the stream's start, or
    after ``since`` (seconds).
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.roots, self.exclude = _strings(options.get("path")), _strings(options.get("exclude"))
        self.since, self.lag = options.get("since"), float(options.get("lag", LAG))

    def initialOffset(self) -> dict:
        return {"until": float(self.since) if self.since is not None else time.time() - self.lag}

    def latestOffset(self) -> dict:
        return {"until": time.time() - self.lag}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["until"] <= start["until"]:
            return []
        tops = listing._split(self.roots, self.exclude)
        shallow = [t for t in tops if not t[1]]
        return [Window(part, start["until"], end["until"]) for part in [*([shallow] if shallow else []), *[[t] for t in tops if t[1]]]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        inside = lambda s: partition.start <= s.st_ctime < partition.end
        for top, deep in partition.tops:
            open_ = [top]
            while open_:
                folder = open_.pop()
                names, below = listing._entries(folder, self.exclude)
                if deep:
                    open_ += below
                try:
                    s = os.stat(folder)
                except OSError:
                    continue
                if inside(s):
                    held.append((folder, "dir", 0, int(s.st_mtime), [os.path.basename(p) for p in (*names, *below)], s.st_ctime))
                for path in names:
                    try:
                        s = os.stat(path)
                    except OSError:
                        continue
                    if inside(s):
                        held.append((path, "file", s.st_size, int(s.st_mtime), None, s.st_ctime))
                if len(held) >= listing.BATCH:
                    yield _watched(held)
                    held = []
        if held:
            yield _watched(held)


def _watched(rows: list[tuple]) -> pa.RecordBatch:
    path, kind, size, mtime, names, seen = zip(*rows)
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.timestamp("us", "UTC")]
    columns = [path, kind, size, mtime, names, [int(x * 1_000_000) for x in seen]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["path", "kind", "size", "mtime_secs", "names", "seen"])


class WatchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_watch"

    def schema(self) -> str:
        return WATCHED

    def streamReader(self, schema) -> DataSourceStreamReader:
        return WatchReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session, with filters taken over."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TreeSource, TsvSource, JsonlSource, WatchSource):
        spark.dataSource.register(source)
