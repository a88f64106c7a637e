"""Importance resampling towards a target table, by features counted in word tries.

Features are runs of 1 to ``n`` consecutive words, joined by one space; a feature's bucket is the CRC-32 of its
UTF-8 bytes modulo the number of buckets. Each task keeps a trie whose edges are words: a node holds its run's count and
the CRC state there, so a run's bucket is found by carrying the state of the run before on over one more word. Full tries
are folded into the task's bucket totals and begun anew, which bounds memory and loses nothing. Totals of all tasks are merged by
one aggregation, and documents are scored along the paths of tries whose nodes hold their bucket's gain.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import durable, rows_of, running

BUCKETS = 10_000
SEED = 2024
#: Nodes of a trie from which it is folded and begun anew, looked at after each document.
NODES = 1 << 19

#: A-Z to lower case; what is no digit, letter or byte of a character beyond ASCII to a space.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_BYTES).split()


def runs(found: list[bytes], n: int) -> Iterator[tuple[tuple[bytes, ...], int]]:
    """Distinct runs of 1 to n words with how often each occurs."""
    for size in range(1, n + 1):
        yield from Counter(zip(*[found[i:] for i in range(size)])).items()


class Trie:
    """A node is [CRC state, value, children]; ``start`` gives a new node's value from its CRC."""

    def __init__(self, start) -> None:
        self.start = start
        self.clear()

    def clear(self) -> None:
        self.root: dict[bytes, list] = {}
        self.nodes: list[list] = []

    def node(self, run: tuple[bytes, ...]) -> list:
        children, crc, found = self.root, 0, None
        for word in run:
            if found is not None:
                if found[2] is None:
                    found[2] = {}
                children, crc, word = found[2], found[0], b" " + word
            found = children.get(word)
            if found is None:
                crc = zlib.crc32(word, crc)
                found = children[word] = [crc, self.start(crc), None]
                self.nodes.append(found)
        return found


def _count(n: int, buckets: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, totals = Trie(lambda crc: 0), np.zeros(buckets, np.int64)

        def fold() -> None:
            crc = np.fromiter((x[0] for x in trie.nodes), np.int64, len(trie.nodes))
            np.add.at(totals, crc % buckets, np.fromiter((x[1] for x in trie.nodes), np.int64, len(trie.nodes)))
            trie.clear()

        for batch in batches:
            for part in rows_of(batch):
                for text in part.column(0).to_pylist():
                    for run_, k in runs(words(text), n):
                        trie.node(run_)[1] += k
                    if len(trie.nodes) > limit:
                        fold()
        fold()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(totals[at])], ["bucket", "n"])

    return run


def bucket_totals(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS, limit: int = NODES) -> np.ndarray:
    """Features of all rows by bucket. The driver gets ``buckets`` sums, whatever the table's size."""
    found = docs.select(docs[text_col].cast("binary").alias("text")).mapInArrow(_count(n, buckets, limit), "bucket int, n long")
    totals = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        totals[r.bucket] = r.n
    return totals


def gains(source: np.ndarray, target: np.ndarray) -> list[int]:
    """Rounded down log ratios of smoothed shares, in thousandths, by bucket."""
    b, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    up, down = float(s_all + b), float(t_all + b)
    return [math.floor(1000 * math.log(float(t + 1) * up / (float(s + 1) * down))) for s, t in zip(source.tolist(), target.tolist())]


def noise(doc_id: str | None, seed: int) -> int:
    """A Gumbel value of the id, in thousandths; a null id is the empty string."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gain, n: int, seed: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = gain.value
        trie = Trie(lambda crc: own[crc % len(own)])
        for batch in batches:
            for part in rows_of(batch):
                out = []
                for text, doc_id in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    found = words(text)
                    features = weight = 0
                    for run_, k in runs(found, n):
                        features += k
                        weight += k * trie.node(run_)[1]
                    out.append((len(found), features, weight, weight + noise(doc_id, seed)))
                    if len(trie.nodes) > limit:
                        trie.clear()
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in zip(*out)]], ["id", "n_words", "n_features", "weight", "score"])

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 1,
    buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = SEED,
    limit: int = NODES,
) -> DataFrame:
    """(id, n_features, weight, score, rank) for every row of ``docs``.

    ``weight`` is the sum of the gains of a row's features, ``score`` adds the Gumbel value of its id, and of the N rows with
    ``least_words`` words or more the floor(percent * N / 100) of highest score are drawn, which is sampling without replacement
    by importance. ``rank`` counts them from 1; it is null for all others. Ties go to the smaller id, null last.

    A null or empty text has no features and weight 0. Texts of any length are taken whole. Repeated rows are rows of their own: they count, and are drawn, as
    often as they occur. An empty table gives an empty result, an empty target only smoothing. Other columns are
    ignored, whatever their names. Ranks come from a sort in range partitions, so no task gets all rows.
    """
    gain = docs.sparkSession.sparkContext.broadcast(gains(bucket_totals(docs, text_col, n, buckets, limit), bucket_totals(target, text_col, n, buckets, limit)))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("binary").alias("text"), docs[id_col].cast("string").alias("label"))
    scored = durable(rows.mapInArrow(_score(gain, n, seed, limit), f"id {kind}, n_words long, n_features long, weight long, score long"))
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    order = [(~able).cast("int"), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = running(scored, order, {"place": F.lit(1)})
    rank = F.when(able & (F.col("place") < drawn), F.col("place") + 1).cast("long")
    return placed.select(F.col("id").alias(id_col), "n_features", "weight", "score", rank.alias("rank"))
