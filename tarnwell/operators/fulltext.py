"""A stored full-text index over metadata, path and tags, in segments of plain Parquet.

Documents fall into blocks by their ids. A segment has one row for each term, field and block: how many documents, their largest frequency and
least length, and the documents with frequency, length and positions, in runs sorted by term. A search first reads only the
figures of its terms' blocks, which bound what any document of a block can score, then the documents of the best blocks, and then of those others whose
bound reaches the k-th score found so far. A frequent word's blocks are thus skipped where a rare word decides.

An id in a later segment hides what earlier ones have of it; a segment lists what it hides. Segments count once the manifest names them,
which is written last. Of more than ``MOST`` segments all but the first are merged. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.functions.text import tokens
from tarnwell.operators.search import B, K1, Query, parse
from tarnwell.sources.store import Unavailable, remove

FIELDS = ("metadata", "path", "tags")
#: Ids of a block, as a power of two.
BLOCK_BITS = 10
#: A search first reads blocks with so many documents of their rarest term for each that it is asked for, and so many blocks at most.
FIRST_DOCS, FIRST_BLOCKS = 4, 256
#: Blocks of a query's terms up to which all are read at once.
DIRECT = 256
#: Segments of an index before they are merged.
MOST = 8

#: Tokens that a task packs at a time.
TOKENS = 1 << 21

_DOCS = "id long, metadata string, path string, tags array<string>"
_POSTING = "struct<doc_id:long,tf:long,length:int,positions:array<int>>"


def packed(docs: DataFrame) -> DataFrame:
    """Rows as of ``blocks`` of documents with id, metadata, path and tags (an array); of a repeated id the last row by its texts counts.

    Only the texts are shuffled, by block. A task then meets its blocks in order and packs as many at a time as have ``TOKENS`` tokens, so the
    rows of a file are runs that are sorted by field, term and block. A block with more tokens has several rows of a term.
    """
    rows = docs.select(F.col("id").cast("long").alias("id"), *FIELDS).withColumn("block", F.shiftright("id", BLOCK_BITS)).repartition("block")
    one = rows.groupBy("block", "id").agg(F.max(F.struct(*FIELDS)).alias("d")).sortWithinPartitions("block", "id")
    words = [tokens(F.concat_ws(" ", f"d.{f}") if f == "tags" else F.col(f"d.{f}")).alias(f) for f in FIELDS]
    return one.select("block", "id", *words).mapInArrow(_pack, f"term string, field string, block long, n long, most long, least int, docs array<{_POSTING}>")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in FIELDS)
        block = batch.column(0).to_pandas().to_numpy()
        ends = [*(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), batch.num_rows]
        lo = 0
        for hi in ends:
            # A block is kept whole if it is small enough.
            while lo < hi:
                upto = lo + max(1, int(np.searchsorted(np.cumsum(sizes[lo:hi]), TOKENS, "right")))
                more = int(sizes[lo:upto].sum())
                if held and n + more > TOKENS:
                    yield from _runs(held)
                    held, n = [], 0
                held.append(batch.slice(lo, upto - lo))
                n, lo = n + more, upto
    if held:
        yield from _runs(held)


def _runs(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in order of their blocks as rows of terms."""
    rows = pa.Table.from_batches(parts)
    ids, blocks_ = rows.column("id").combine_chunks(), rows.column("block").combine_chunks()
    block_of = pc.fill_null(blocks_, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    for field in FIELDS:
        words = rows.column(field).combine_chunks()
        length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = int(length.sum())
        if not total:
            continue
        coded = words.flatten().dictionary_encode()
        names = coded.dictionary
        in_order = pc.array_sort_indices(names)
        rank = np.empty(len(names), np.uint16 if len(names) <= 1 << 16 else np.int32)
        rank[in_order.to_numpy()] = np.arange(len(names))
        code = rank[coded.indices.to_numpy()]
        order = np.argsort(code, kind="stable")
        code, doc = code[order], np.repeat(np.arange(len(length)), length)[order]
        place = (np.arange(total) - np.repeat(np.cumsum(length) - length, length))[order].astype(np.int32)
        # A posting is a term's run in a document, a row its run in a block.
        starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])]))
        tf = np.diff(np.append(starts, total))
        code, doc = code[starts], doc[starts]
        at = block_of[doc]
        heads = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (at[1:] != at[:-1])]))
        own = length[doc].astype(np.int32)
        places = pa.ListArray.from_arrays(pa.array(np.append(starts, total), pa.int32()), pa.array(place))
        postings = pa.StructArray.from_arrays([ids.take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(own), places], ["doc_id", "tf", "length", "positions"])
        out = pa.RecordBatch.from_arrays([
            names.take(in_order).take(pa.array(code[heads].astype(np.int64))), pa.array([field] * len(heads), pa.string()), blocks_.take(pa.array(doc[heads])),
            pa.array(np.diff(np.append(heads, len(code))), pa.int64()), pa.array(np.maximum.reduceat(tf, heads), pa.int64()), pa.array(np.minimum.reduceat(own, heads), pa.int32()),
            pa.ListArray.from_arrays(pa.array(np.append(heads, len(code)), pa.int32()), postings),
        ], ["term", "field", "block", "n", "most", "least", "docs"])
        for lo in range(0, out.num_rows, 4096):
            yield out.slice(lo, 4096)


def blocks(terms: DataFrame) -> DataFrame:
    """(term, field, block, n, most, least, docs): terms of documents packed by blocks of ids, of which each holds at most 2**BLOCK_BITS documents."""
    rows = terms.withColumn("block", F.shiftright("doc_id", BLOCK_BITS))
    return rows.groupBy("term", "field", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.sort_array(F.collect_list(F.struct("doc_id", "tf", "length", "positions"))).alias("docs"),
    )


class Read(NamedTuple):
    """What a search read: blocks of its terms, and of those, blocks whose documents were read."""

    all: int
    opened: int


class TextIndex:
    """``put`` and ``delete`` write segments that ``commit`` makes visible; ``search`` reads what its terms need.

    Frequencies and lengths count hidden documents until segments are merged or rebuilt, as is usual for segmented indexes.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False) -> None:
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self._pending: list[str] = []
        #: Of the last search.
        self.read: Read | None = None

    def _manifest(self):
        try:
            return self.spark.read.parquet(f"{self.root}/manifest").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _segments(self) -> list[str]:
        row = self._manifest()
        return list(row.segments) if row else []

    def applied(self) -> int:
        """The number of the last batch that a commit was given; -1 before the first."""
        row = self._manifest()
        return -1 if row is None or row.batch is None else row.batch

    def _read(self, segments: list[str], table: str) -> DataFrame:
        """A table of all segments, with each row's segment."""
        rows = self.spark.read.parquet(*[f"{self.root}/{s}/{table}" for s in segments])
        own = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)
        return rows.withColumn("segment", own if len(segments) > 1 else F.lit(segments[0]))

    def _check(self) -> None:
        if self.read_only:
            raise Unavailable("opened for reading")

    def _write(self, docs: DataFrame | None, gone: DataFrame | None) -> str:
        self._check()
        if docs is None:
            docs = self.spark.createDataFrame([], _DOCS)
        ids = docs.select(F.col("id").cast("long").alias("id"), F.lit(True).alias("put"))
        if gone is not None:
            ids = ids.union(gone.select(F.col("id").cast("long"), F.lit(False)))
        return self._store(packed(docs), ids.distinct())

    def _store(self, rows: DataFrame, ids: DataFrame) -> str:
        """Write a segment. How many tokens its fields have is counted in what was written, so that texts are read once."""
        name = f"s-{uuid.uuid4().hex}"
        at = f"{self.root}/{name}"
        rows.write.parquet(f"{at}/blocks")
        ids.write.parquet(f"{at}/ids")
        n = self.spark.read.parquet(f"{at}/ids").where("put").count()
        held = F.aggregate(F.col("docs.tf"), F.lit(0).cast("long"), lambda a, x: a + x)
        totals = {r.field: r.total for r in self.spark.read.parquet(f"{at}/blocks").groupBy("field").agg(F.sum(held).alias("total")).collect()}
        stats = self.spark.createDataFrame([(f, n, totals.get(f, 0)) for f in FIELDS], "field string, docs long, total long")
        stats.coalesce(1).write.parquet(f"{at}/stats")
        return name

    def put(self, docs: DataFrame) -> None:
        """Documents (id, metadata, path, tags) that replace those of their ids; visible after ``commit``."""
        self._pending.append(self._write(docs, None))

    def delete(self, ids: DataFrame) -> None:
        self._pending.append(self._write(None, ids))

    def _publish(self, segments: list[str], batch: int | None = None) -> None:
        """Name the segments in a new version, with the sums of their statistics, so that a search finds both in one read."""
        row = self._manifest()
        sums = self._read(segments, "stats").groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).collect()
        entry = (row.version + 1 if row else 1, segments, [(r.field, r.docs, r.total) for r in sums], batch if batch is not None else row.batch if row else None)
        kinds = "version long, segments array<string>, stats array<struct<field:string,docs:long,total:long>>, batch long"
        self.spark.createDataFrame([entry], kinds).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _hide(self, segments: list[str], name: str) -> None:
        """Write what a segment hides of earlier ones."""
        new = self._read([name], "ids").select("id")
        old = self._read(segments, "ids").where("put").select("id", F.col("segment").alias("victim")) if segments else new.limit(0).withColumn("victim", F.lit(""))
        old.join(new, "id", "left_semi").select("victim", F.col("id").alias("doc_id")).write.mode("overwrite").parquet(f"{self.root}/{name}/hides")

    def commit(self, batch: int | None = None) -> None:
        """Make pending segments visible; ``batch`` is kept with them, see ``applied``."""
        self._check()
        segments, old = self._segments(), []
        for name in self._pending:
            self._hide(segments, name)
            segments.append(name)
        if len(segments) > MOST:
            old = segments[1:]
            merged = self._merge(old)
            self._hide(segments[:1], merged)
            segments = [segments[0], merged]
        if self._pending or batch is not None and segments:
            self._publish(segments, batch)
            self._pending = []
        for name in old:
            remove(self.spark, f"{self.root}/{name}")

    def _merge(self, segments: list[str]) -> str:
        """One segment of what several, in order, still show; ids that they delete stay deleted."""
        last = self._last(segments)
        rows = self._postings(self._live(self._read(segments, "blocks"), segments)).drop("segment")
        return self._store(blocks(rows).repartitionByRange("term", "field", "block").sortWithinPartitions("term", "field", "block"), last.select("id", "put"))

    def rebuild(self, docs: DataFrame, expect: int | None = None) -> int:
        """Replace all segments by one of ``docs``. If the index has not as many documents as ``expect``, nothing changes."""
        name = self._write(docs, None)
        n = self.spark.read.parquet(f"{self.root}/{name}/ids").count()
        if expect is not None and n != expect:
            raise Unavailable(f"{n} documents were indexed, not {expect}; the old index stays")
        self._hide([], name)
        self._publish([name])
        return n

    def _last(self, segments: list[str]) -> DataFrame:
        """(id, put): whether the last segment that names an id puts it."""
        names = F.array(*[F.lit(s) for s in segments])
        rows = self._read(segments, "ids").groupBy("id").agg(F.max(F.struct(F.array_position(names, F.col("segment")).alias("no"), "put")).alias("m"))
        return rows.select("id", "m.put")

    def built(self) -> bool:
        return bool(self._segments())

    def num_docs(self) -> int:
        """Documents that a search can find."""
        segments = self._segments()
        return self._last(segments).where("put").count() if segments else 0

    def _postings(self, packed: DataFrame) -> DataFrame:
        return packed.select("segment", "term", "field", F.explode("docs").alias("d")).select("segment", "term", "field", "d.*")

    def _live(self, packed: DataFrame, segments: list[str]) -> DataFrame:
        """Blocks without the documents that a later segment hides."""
        if len(segments) == 1:
            return packed
        hidden = self._read(segments[1:], "hides").select("victim", F.shiftright("doc_id", BLOCK_BITS).alias("block"), "doc_id")
        hidden = hidden.groupBy(F.col("victim").alias("segment"), "block").agg(F.collect_set("doc_id").alias("_gone"))
        left = F.when(F.col("_gone").isNull(), F.col("docs")).otherwise(F.filter("docs", lambda d: ~F.array_contains("_gone", d["doc_id"])))
        return packed.join(hidden, ["segment", "block"], "left").withColumn("docs", left).drop("_gone")

    def _none(self) -> DataFrame:
        self.read = Read(0, 0)
        return self.spark.createDataFrame([], "doc_id long, score double")

    def search(self, text: str, k: int = 50) -> DataFrame:
        """(doc_id, score): the k best by BM25 summed over the fields, ties to smaller ids. Unparsable queries give nothing."""
        query, row = parse(text, FIELDS), self._manifest()
        words = sorted({t for _, c in (query.should + query.must + query.never) for t in c}) if query else []
        if row is None or not words or not query.should + query.must:
            return self._none()
        segments, stats = list(row.segments), {s.field: (s.docs, s.total) for s in row.stats}
        own = self._read(segments, "blocks").where(F.col("term").isin(words))
        sizes = own.groupBy("field", "term").agg(F.sum("n").alias("df"), F.count(F.lit(1)).alias("rows")).collect()
        df, all_ = {(r.field, r.term): r.df for r in sizes}, sum(r.rows for r in sizes)
        used = {(f, t): i for i, (f, t) in enumerate(sorted(df))}
        scoring = [x for x in used if clauses(query, *x)]
        if not scoring:
            return self._none()
        if all_ <= DIRECT:
            self.read = Read(all_, all_)
            return self._best(query, used, df, stats, segments, own, k)
        # The largest part of a score that a term can add in a block: by its largest frequency and least length there.
        part = F.coalesce(*[F.when((F.col("field") == f) & (F.col("term") == t), bm25(F.col("most"), F.col("least"), df[f, t], stats[f])) for f, t in scoring], F.lit(0.0))
        bounds = own.groupBy("segment", "block").agg(F.sum(part).alias("bound"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows"))
        head = bounds.orderBy(F.desc("bound"), "segment", "block").limit(FIRST_BLOCKS + 1).collect()
        first, held = [], 0
        for r in head[:FIRST_BLOCKS]:
            if held >= FIRST_DOCS * k:
                break
            first.append(r)
            held += r.n
        opened = sum(r.rows for r in first)
        best = self._best(query, used, df, stats, segments, self._pick(own, first), k)
        if len(first) == len(head):
            self.read = Read(opened, opened)
            return best
        found = best.collect()
        least = found[-1].score if len(found) == k else 0.0
        taken = F.lit(False)
        for s in segments:
            taken = taken | ((F.col("segment") == s) & F.col("block").isin([r.block for r in first if r.segment == s]))
        # Scores are rounded, and equal ones go by id, so what could only tie is read too.
        open_ = bounds.where(~taken & (F.col("bound") > 0)).withColumn("left", F.col("bound") >= least - 1e-6)
        sums = open_.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("left"), F.col("rows"))), F.lit(0))).first()
        self.read = Read(opened + sums[0], opened + sums[1])
        page = self.spark.createDataFrame(found, "doc_id long, score double")
        if not sums[1]:
            return page
        rest = own.join(open_.where("left").select("segment", "block"), ["segment", "block"], "left_semi")
        more = self._best(query, used, df, stats, segments, rest, k)
        return page.union(more).orderBy(F.desc("score"), "doc_id").limit(k)

    @staticmethod
    def _pick(own: DataFrame, first: list) -> DataFrame:
        """Rows of some blocks, as a condition that reaches the scan."""
        here = F.lit(False)
        for s in {r.segment for r in first}:
            here = here | ((F.col("segment") == s) & F.col("block").isin([r.block for r in first if r.segment == s]))
        return own.where(F.col("block").isin([r.block for r in first])).where(here)

    def _best(self, query: Query, used: dict, df: dict, stats: dict, segments: list[str], packed: DataFrame, k: int) -> DataFrame:
        """The k best documents of some blocks."""
        rows = self._postings(self._live(packed, segments))
        hit = lambda f, t: (F.col("field") == f) & (F.col("term") == t)
        columns = [F.max(F.when(hit(f, t), F.col(c))).alias(f"{c}{i}") for (f, t), i in used.items() for c in ("tf", "positions", "length")]
        per_doc = rows.groupBy("doc_id").agg(*columns)
        scored = per_doc.where(wanted(query, used)).select("doc_id", F.round(score(query, used, df, stats), 6).alias("score")).where("score > 0")
        return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def occurs(field: str, clause: list[str], used: dict[tuple[str, str], int]) -> Column:
    """Whether a field holds the clause: its word, or its words in a row."""
    if any((field, t) not in used for t in clause):
        return F.lit(False)
    at = [F.col(f"positions{used[field, t]}") for t in clause]
    if len(clause) == 1:
        return at[0].isNotNull()

    def here(p: Column) -> Column:
        out = F.lit(True)
        for i, x in enumerate(at[1:]):
            out = out & F.array_contains(x, p + (i + 1))
        return out

    return F.coalesce(F.exists(at[0], here), F.lit(False))


def anywhere(clause: tuple[str | None, list[str]], used: dict[tuple[str, str], int]) -> Column:
    field, words = clause
    out = F.lit(False)
    for f in FIELDS if field is None else (field,):
        out = out | occurs(f, words, used)
    return out


def wanted(query: Query, used: dict[tuple[str, str], int]) -> Column:
    out = F.lit(True)
    for c in query.must:
        out = out & anywhere(c, used)
    for c in query.never:
        out = out & ~anywhere(c, used)
    return out


def clauses(query: Query, field: str, term: str) -> list[list[str]]:
    """The clauses for which a term of a field counts."""
    return [c for f, c in query.should + query.must if term in c and f in (None, field)]


def bm25(tf: Column, length: Column, df: int, stats: tuple[int, int]) -> Column:
    """A term's part of a score; it grows with the frequency and falls with the length."""
    n, total = stats
    return F.log1p(F.lit((n - df + 0.5) / (df + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(max(total, 1) / max(n, 1))))


def score(query: Query, used: dict[tuple[str, str], int], df: dict[tuple[str, str], int], stats: dict[str, tuple[int, int]]) -> Column:
    """BM25 of each field's words, summed; the words of a phrase count where the phrase occurs."""
    out = F.lit(0.0)
    for (f, t), i in used.items():
        own = clauses(query, f, t)
        if not own:
            continue
        part = bm25(F.col(f"tf{i}"), F.col(f"length{i}"), df[f, t], stats[f])
        if [t] not in own:
            seen = F.lit(False)
            for c in own:
                seen = seen | occurs(f, c, used)
            part = F.when(seen, part)
        out = out + F.coalesce(part, F.lit(0.0))
    return out
