"""A catalogue on plain Parquet with versions: written beside the old one, counted, then named in the manifest.

A version is a folder of tables. It exists once the manifest has its row, which is the last thing written, so a job
that fails or is repeated leaves readers on the version before. One writer at a time.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.operators.relational import BadRequest, NotFound

#: Layouts of the catalogue: what each added to the tables, as (table, column, type, default).
LAYOUTS: dict[int, tuple[tuple[str, str, str, object], ...]] = {
    0: (),
    1: (("files", "bio_metadata", "string", None),),
    2: (("files", "indexed_at", "long", 0), ("dataset", "species_confidence", "string", None)),
    3: (("dataset", "snapshot_id", "long", None), ("asset", "snapshot_id", "long", None)),
    4: (("dataset", "summary", "string", None), ("dataset", "updated_at", "long", 0)),
}
CURRENT = max(LAYOUTS)
NEEDED = ("dataset", "asset", "asset_file", "files")


def scratch_folder(spark: SparkSession) -> str:
    """Where derived tables of a session can be kept: ``spark.checkpoint.dir``, or on one machine a temporary folder. It goes when the session ends."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise Unavailable("set spark.checkpoint.dir to a folder that all machines share")
        folder = _temporary.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        _temporary[context.applicationId] = folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    own = f"{folder}/tarnwell-{context.applicationId}"
    path, fs = on_files(spark, own)
    fs.deleteOnExit(path)
    return own


def on_files(spark: SparkSession, path: str):
    """(path, file system) as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of all files at a path; another one whenever a table there was written anew."""
    found = [f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in _files(spark, path)]
    return hashlib.sha256("\n".join([path, *sorted(found)] if found else [path]).encode()).hexdigest()


def file_bytes(spark: SparkSession, path: str) -> int:
    """The size of all files at a path."""
    return sum(f.getLen() for f in _files(spark, path))


def _files(spark: SparkSession, path: str) -> Iterator:
    at, fs = on_files(spark, path)
    if fs.exists(at):
        seen = fs.listFiles(at, True)
        while seen.hasNext():
            yield seen.next()


def durable(df: DataFrame) -> DataFrame:
    """The rows as they are now, on the shared folder; they survive lost executors and are computed once."""
    scratch_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Remove a folder with all in it, if it is there."""
    path, fs = on_files(spark, folder)
    fs.delete(path, True)


_temporary: dict[str, str] = {}


class Unavailable(RuntimeError):
    """The store cannot be used now, or not by this program."""


def status_of(error: Exception) -> int:
    """The status code that a service answers with."""
    return 400 if isinstance(error, BadRequest) else 404 if isinstance(error, NotFound) else 503 if isinstance(error, Unavailable) else 500


class Store:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only

    def _manifest(self):
        try:
            return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def version(self) -> int:
        """The current version; 0 if nothing was committed."""
        row = self._manifest()
        return row.version if row else 0

    def has(self, table: str) -> bool:
        row = self._manifest()
        return row is not None and table in row.tables

    def read(self, table: str) -> DataFrame:
        """A table of the current version, with what later layouts added."""
        row = self._manifest()
        if row is None or table not in row.tables:
            raise NotFound(table)
        if row.layout > CURRENT:
            raise Unavailable(f"layout {row.layout} is newer than {CURRENT}")
        return migrate(table, self.spark.read.parquet(f"{self.root}/{_places(row)[table]}"), row.layout)

    def commit(self, tables: dict[str, DataFrame], expect: dict[str, int] | None = None, layout: int = CURRENT) -> int:
        """Write the tables as the next version and make it current; tables not given stay where they are, unless their layout changed.

        Rows are counted in what was written; if ``expect`` names other counts, the old version stays current.
        """
        if self.read_only:
            raise Unavailable("opened for reading")
        old = self._manifest()
        new = (old.version if old else 0) + 1
        places = _places(old) if old else {}
        rows = dict(old.rows) if old else {}
        if old and old.layout != layout:
            tables = {**{t: self.read(t) for t in old.tables if t not in tables}, **tables}
        for name, df in tables.items():
            places[name] = f"v{new}/{name}"
            df.write.mode("overwrite").parquet(f"{self.root}/{places[name]}")
            rows[name] = self.spark.read.parquet(f"{self.root}/{places[name]}").count()
        wrong = {t: (n, rows.get(t)) for t, n in (expect or {}).items() if rows.get(t) != n}
        if wrong:
            raise Unavailable(f"row counts differ, nothing was changed: {wrong}")
        entry = self.spark.createDataFrame([(new, layout, sorted(rows), rows, places)], "version long, layout int, tables array<string>, rows map<string,long>, places map<string,string>")
        entry.coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return new

    def ready(self) -> bool:
        """Whether a version of a known layout is there with all tables that queries need, and can be read."""
        row = self._manifest()
        if row is None or row.layout not in LAYOUTS or not set(NEEDED) <= set(row.tables):
            return False
        try:
            return all(self.read(t).limit(1).count() >= 0 for t in NEEDED)
        except AnalysisException:
            return False


def _places(row) -> dict[str, str]:
    """Where each table of a version is; manifests without places have all tables in the version's own folder."""
    return dict(row.places) if "places" in row and row.places else {t: f"v{row.version}/{t}" for t in row.tables}


def migrate(table: str, df: DataFrame, layout: int) -> DataFrame:
    """A table of an older layout with the columns that were added since, at their defaults."""
    for n in sorted(x for x in LAYOUTS if x > layout):
        for t, column, kind, default in LAYOUTS[n]:
            if t == table and column not in df.columns:
                df = df.withColumn(column, F.lit(default).cast(kind))
    return df
