"""Maximum inner product search with score-aware (anisotropic) quantisation.

Unit vectors are cut into subspaces of two components, each quantised to 16 codewords (4 bits). Codewords
and assignments weigh the residual error parallel to the vector more than the orthogonal one, by
(d - 1) T**2 / (1 - T**2), as only the parallel part moves the scores of the vectors that matter. A query's table
of 16 products per subspace, two subspaces to a lookup, scans the codes of a block of vectors. The best by
that estimate give a bound, and all whose estimate comes within SIGMAS standard errors of the bound are reranked
exactly, so dense clusters of near-equal vectors get as many exact scores as they need.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import durable, rows_of

CODES, SUB = 16, 2
THRESHOLD = 0.2
SAMPLE = 8192
#: Vectors of a block, and queries that go to all blocks at once.
BLOCK, QUERIES = 8192, 8192
FIRST = 64
SIGMAS = 3.0


def parallel_weight(d: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))


def assign(x: np.ndarray, books: np.ndarray, weight: float, sweeps: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms): coordinate descent on the score-aware loss from the nearest codewords."""
    n, d = x.shape
    subs = d // SUB
    parts = x.reshape(n, subs, SUB)
    codes = np.empty((n, subs), np.uint8)
    along = np.zeros(n)
    for s in range(subs):
        gap = parts[:, s, None] - books[s]
        codes[:, s] = np.argmin((gap * gap).sum(-1), axis=1)
        along += ((parts[:, s] - books[s][codes[:, s]]) * parts[:, s]).sum(-1)
    for _ in range(sweeps):
        for s in range(subs):
            gap = parts[:, s, None] - books[s]
            dot = (gap * parts[:, s, None]).sum(-1)
            others = along - dot[np.arange(n), codes[:, s]]
            codes[:, s] = np.argmin((gap * gap).sum(-1) + (weight - 1) * (others[:, None] + dot) ** 2, axis=1)
            along = others + dot[np.arange(n), codes[:, s]]
    return codes, np.sqrt(((x - decode(codes, books)) ** 2).sum(1))


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return np.concatenate([books[s][codes[:, s]] for s in range(codes.shape[1])], axis=1)


def fit(x: np.ndarray, weight: float, rounds: int = 6, seed: int = 3) -> np.ndarray:
    """Codebooks (subspaces, 16, 2): assignments and weighted least squares by turns, on a bounded sample."""
    n, d = x.shape
    subs = d // SUB
    rng = np.random.default_rng(seed)
    parts = x.reshape(n, subs, SUB)
    books = np.stack([parts[rng.choice(n, CODES, replace=n < CODES), s] for s in range(subs)])
    for _ in range(rounds):
        codes, _ = assign(x, books, weight, sweeps=1)
        along = ((x - decode(codes, books)) * x).sum(1)
        for s in range(subs):
            p = parts[:, s]
            others = along - ((p - books[s][codes[:, s]]) * p).sum(1)
            for c in range(CODES):
                mine = codes[:, s] == c
                if mine.any():
                    q = p[mine]
                    left = len(q) * np.eye(SUB) + (weight - 1) * q.T @ q
                    right = (q * (1 + (weight - 1) * (others[mine] + (q * q).sum(1)))[:, None]).sum(0)
                    books[s][c] = np.linalg.solve(left, right)
            along = others + ((p - books[s][codes[:, s]]) * p).sum(1)
    return books


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def in_order(terms: np.ndarray) -> np.ndarray:
    """Sums of rows from the first component to the last, so that a score is the same wherever it is computed."""
    return np.add.accumulate(terms, axis=1)[:, -1]


def units(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Unit vectors for the index; an odd number of components gets a zero more."""
    return np.pad(vectors / norms[:, None], ((0, 0), (0, -vectors.shape[1] % SUB)))


def pack(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes to a byte."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | codes[:, 1::2] << 4


class Block:
    """Some vectors of the index: packed codes, and originals for exact scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, packed: np.ndarray, error: np.ndarray, books: np.ndarray) -> None:
        self.ids, self.vectors, self.error, self.books = ids, vectors, error, books
        self.norms = np.sqrt(in_order(vectors * vectors))
        self.packed = np.ascontiguousarray(packed.T)

    def estimate(self, query: np.ndarray) -> np.ndarray:
        table = np.einsum("skc,sc->sk", self.books, query.reshape(-1, SUB)).astype(np.float32)
        if len(table) % 2:
            table = np.pad(table, ((0, 1), (0, 0)))
        pairs = (table[::2, None, :] + table[1::2, :, None]).reshape(len(table) // 2, 256)
        out = np.zeros(self.packed.shape[1], np.float32)
        for lookup, code in zip(pairs, self.packed):
            out += lookup.take(code)
        return out

    def exact(self, which: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
        return in_order(self.vectors[which] * query) / (self.norms[which] * norm)

    def search(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k nearest in the block but the query's own row, ties to smaller ids."""
        norm = np.sqrt(in_order((query * query)[None])[0])
        estimate = self.estimate(units(query[None], np.array([norm]))[0])
        n = len(estimate)
        few = np.argpartition(-estimate, FIRST)[:FIRST] if n > FIRST else np.arange(n)
        few = few[self.ids[few] != own]
        if len(few) >= k and n > FIRST:
            bound = np.partition(self.exact(few, query, norm), -k)[-k]
            few = np.flatnonzero(estimate + SIGMAS * self.error / np.sqrt(len(query)) >= bound - 1e-6)
            few = few[self.ids[few] != own]
        score = self.exact(few, query, norm)
        best = np.lexsort((self.ids[few], -score))[:k]
        return self.ids[few][best], score[best]


def _encode(books: np.ndarray, weight: float, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 4096):
                v = _vectors(part.column(1), dims)
                codes, error = assign(units(v, np.sqrt(in_order(v * v))), books, weight)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in pack(codes)], pa.binary()), pa.array(error)], ["vec_id", "v", "codes", "error"])

    return run


def _search(books: np.ndarray, dims: int, k: int, asked):
    """The k nearest of each query in each block of a partition of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, vectors = asked.value
        rows = pa.Table.from_batches(held) if (held := [b for b in batches if b.num_rows]) else None
        for lo in range(0, rows.num_rows if rows else 0, BLOCK):
            part = rows.slice(lo, BLOCK).combine_chunks()
            packed = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(part.num_rows, -1)
            block = Block(part.column(0).to_numpy(), _vectors(part.column(1), dims), packed, part.column(3).to_numpy(), books)
            for at in range(0, len(queries), 1024):
                found = [(q, *block.search(q, v, k)) for q, v in zip(queries[at : at + 1024], vectors[at : at + 1024])]
                q = np.concatenate([np.full(len(i), q, np.int64) for q, i, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate([i for _, i, _ in found])), pa.array(np.concatenate([s for _, _, s in found]))], ["query_id", "vec_id", "score"])

    return run


def clean(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles; null, zero and non-finite ones and null ids do not."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = table.select(table[id_col].cast("long").alias("vec_id"), table[vector_col].cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def search(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each row whose id is divisible by ``every``.

    Every row but the query's own is a candidate; with fewer than k all are returned. Ties go to the smaller id.
    Of equal vectors only the k + 1 smallest ids can be among the nearest, so others leave before the search.
    The codebooks are fitted on about SAMPLE rows, chosen by hash of the id; all rows are indexed once, in blocks dealt by
    hash. Queries go to all blocks in chunks of about QUERIES by broadcast, so nothing is shuffled but each block's k best.
    A cosine needs vectors of one length: those of another length than most (the least such length at a tie) take no part.
    Without two usable vectors the result is empty. Rows that repeat an id are one row each as candidates; as queries one of
    them counts, the same in each run, and a query's own id is never its own neighbour. Other columns are ignored, whatever their names.
    """
    schema = "query_id long, vec_id long, score double"
    rows = clean(table, id_col, vector_col)
    key = Window.partitionBy("h1", "h2").orderBy("vec_id")
    hashed = rows.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(5), "v")})
    few = durable(hashed.withColumn("r", F.row_number().over(key)).where(F.col("r") <= k + 1).select("vec_id", "v"))
    n, dims = few.agg(F.count(F.lit(1)), F.mode(F.size("v"), True)).first()
    spark = table.sparkSession
    if not n:
        return spark.createDataFrame([], schema).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    few = few.where(F.size("v") == dims)
    share = min(1.0, SAMPLE / n)
    chosen = few.where(F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy("vec_id", "v").select("v").toArrow()
    sample = _vectors(chosen.column(0), dims) if chosen.num_rows else np.ones((1, dims))
    sample = units(sample, np.sqrt(in_order(sample * sample)))
    weight = parallel_weight(dims)
    books = fit(sample, weight)
    blocks = max(1, -(-n // BLOCK))
    dealt = few.repartition(blocks, F.xxhash64("vec_id", "v"))
    index = durable(dealt.mapInArrow(_encode(books, weight, dims), "vec_id long, v array<double>, codes binary, error double"))
    asked = rows.where((F.col("vec_id") % every == 0) & (F.size("v") == dims)).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = durable(asked)
    chunks = max(1, -(-asked.count() // QUERIES))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = []
    for c in range(chunks):
        mine = asked.where(F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(chunks)) == c).toArrow()
        shared = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), _vectors(mine.column("v"), dims)))
        hits = index.mapInArrow(_search(books, dims, k, shared), schema)
        top = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if chunks > 1:
            top = durable(top)
            shared.unpersist()
        found.append(top)
    return reduce(DataFrame.union, found)
