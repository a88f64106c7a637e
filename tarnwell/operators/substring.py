"""Substring search by stored trigrams, verified on the rows.

Rows are indexed in lots as tasks read them. The index has a row for each lot, column and trigram with the ids that have it, in runs sorted by trigram,
and how many ids there are of each. A query of three characters or more reads the rows of its rarest trigrams, meets their ids within each
lot, and leaves the rest to ``holds`` on the rows that are left; a shorter one has no trigram and scans. Texts are compared but for ASCII case, as
``holds`` does, and nothing in a query is a wildcard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import LOWER, UPPER, fold

SIZE = 3
#: Trigrams of a query whose postings are read.
RAREST = 4
#: Characters of a lot, if it has more than one row.
LOT = 1 << 20


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lot, column, gram, ids) of rows with an id and text columns without ASCII capitals; a lot has as many rows as ``LOT`` characters allow."""
    part, no = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    for batch in batches:
        names = batch.schema.names[1:]
        sizes = sum(pc.fill_null(pc.utf8_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names)
        ends, lo = np.cumsum(sizes), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + LOT, "right")))
            for c in names:
                yield from _lot(batch.column(0).slice(lo, hi - lo), batch.column(c).slice(lo, hi - lo), c, (part << 33) + no)
            no, lo = no + 1, hi


def _lot(ids: pa.Array, texts: pa.Array, column: str, lot: int) -> Iterator[pa.RecordBatch]:
    """Every run of three characters of a text, with the ids that have it, each once."""
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    letters = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row, place = np.repeat(np.arange(len(length)), length), np.arange(len(letters)) - np.repeat(np.cumsum(length) - length, length)
    at = np.flatnonzero(place + SIZE <= length[row])
    if not len(at):
        return
    code = letters[at] << 42 | letters[at + 1] << 21 | letters[at + 2]
    known, code = np.unique(code, return_inverse=True)
    pair = np.unique(code * len(length) + row[at])
    code, row = pair // len(length), pair % len(length)
    heads = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    grams = ["".join(chr(int(g) >> k & 0x1FFFFF) for k in (42, 21, 0)) for g in known]
    held = pa.ListArray.from_arrays(pa.array(np.append(heads, len(code)), pa.int32()), ids.take(pa.array(row)))
    n = len(heads)
    yield pa.RecordBatch.from_arrays([pa.array([lot] * n, pa.int64()), pa.array([column] * n, pa.string()), pa.array(grams, pa.string()), held], ["lot", "column", "gram", "ids"])


class Trigrams:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, rows: DataFrame, columns: list[str], id_col: str = "id") -> None:
        """Index some text columns of rows; an index that is there is replaced."""
        kind = rows.schema[id_col].dataType.simpleString()
        texts = rows.select(F.col(id_col).alias("id"), *[fold(c).alias(c) for c in columns])
        flat = texts.mapInArrow(_postings, f"lot long, column string, gram string, ids array<{kind}>")
        flat.sortWithinPartitions("gram", "column", "lot").write.mode("overwrite").parquet(f"{self.root}/postings")
        sizes = self.spark.read.parquet(f"{self.root}/postings").groupBy("gram").agg(F.sum(F.size("ids")).cast("long").alias("n"))
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.root}/sizes")

    def built(self) -> bool:
        try:
            self.spark.read.parquet(f"{self.root}/sizes")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return False
            raise
        return True

    def candidates(self, query: str) -> DataFrame | None:
        """(id) of the rows that have the query's rarest trigrams in one column, repeats too; None if the query is too short to tell."""
        low = query.translate(str.maketrans(UPPER, LOWER))
        own = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
        if not own:
            return None
        sizes = {r.gram: r.n for r in self.spark.read.parquet(f"{self.root}/sizes").where(F.col("gram").isin(own)).collect()}
        if len(sizes) < len(own):
            return self.spark.read.parquet(f"{self.root}/postings").select(F.explode("ids").alias("id")).limit(0)
        rarest = sorted(own, key=lambda g: (sizes[g], g))[:RAREST]
        found = self.spark.read.parquet(f"{self.root}/postings").where(F.col("gram").isin(rarest))
        lots = found.groupBy("lot", "column").agg(F.collect_list("ids").alias("each")).where(F.size("each") == len(rarest))
        # An id that comes in several lots or columns is there as often.
        return lots.select(F.explode(F.aggregate(F.slice("each", 2, RAREST), F.col("each")[0], F.array_intersect)).alias("id"))

    def narrow(self, rows: DataFrame, query: str, id_col: str = "id") -> DataFrame:
        """Rows that can hold the query in an indexed column: those of its candidates, or all for a short query."""
        some = self.candidates(query)
        return rows if some is None else rows.join(some.select(F.col("id").alias(id_col)), id_col, "left_semi")
