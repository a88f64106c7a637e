"""Vector best-fit packing of token sequences.

Bins have three capacities: tokens, documents and attention cost (the sum of squared lengths). Items are
placed by decreasing length. Of the bins that hold an item in every dimension, the one is taken that
scores best by the residuals: least weighted norm of what is left after placing ("norm"), or largest
weighted dot product of the item with what is left before ("dot").

Items are dealt to groups of GROUP items by hash; a group is packed in one task. Each group
leaves a few part-filled bins among tens of thousands, so the packing stays as tight at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.bpe import ByteBpe
from tarnwell.llm.common import durable, groups, rows_of

GROUP = 50_000
TOKENS, DOCUMENTS = 1024, 1024
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of items given by decreasing length. Bins of equal residuals are one state with a stack."""
    cap = np.array(capacity, np.float64)
    w = np.array(weights, np.float64)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left = np.zeros((1024, 3), np.int64)
    stacks: list[list[int]] = []
    of: dict[tuple[int, int, int], int] = {}
    spare: list[int] = []
    made = 0
    smallest = int(lengths[-1]) if len(lengths) else 0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1, n * n])
        used = left[: len(stacks)]
        able = np.flatnonzero((used[:, 0] >= n) & (used[:, 1] >= 1) & (used[:, 2] >= n * n))
        if len(able):
            if score == "norm":
                rest = (used[able] - need) / cap
                k = able[np.argmin((rest * rest) @ w)]
            else:
                k = able[np.argmax((used[able] / cap) @ (w * need / cap))]
            state, b = left[k].copy(), stacks[k].pop()
            if not stacks[k]:
                del of[tuple(state.tolist())]
                left[k] = -1
                spare.append(int(k))
        else:
            state, b = np.array(capacity, np.int64), made
            made += 1
        bins[i], offsets[i] = b, capacity[0] - state[0]
        state -= need
        if state[0] >= smallest and state[1] >= 1 and state[2] >= smallest * smallest:
            key = tuple(state.tolist())
            k = of.get(key)
            if k is None:
                if spare:
                    k = spare.pop()
                else:
                    k = len(stacks)
                    stacks.append([])
                    if k >= len(left):
                        left = np.concatenate([left, np.zeros_like(left)])
                of[key] = k
                left[k] = state
            stacks[k].append(b)
    return bins, offsets


def _pieces(path: str, ranks_path: str, pattern: str, end_id: int, tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path, ranks_path, pattern)
        for batch in batches:
            for part in rows_of(batch):
                row, piece, start, length, crc = [], [], [], [], []
                for r, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(bpe.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                    at, k = 0, 0
                    while at < len(ids):
                        n = (len(ids) - at) % tokens or tokens
                        row.append(r)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(ids[at : at + n]))
                        at, k = at + n, k + 1
                ids_ = part.column(0).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids_, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["id", "piece", "start", "length", "ids_crc32"])

    return run


def _pack(capacity, weights, score):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in groups(batches, "group"):
            rows = rows.sort_by([("length", "descending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")]).combine_chunks()
            bins, offsets = best_fit(rows.column("length").to_numpy(), capacity, weights, score)
            out = rows.drop_columns(["group"]).append_column("sequence_id", pa.array(bins + (int(group) << 32))).append_column("offset", pa.array(offsets))
            yield from out.to_batches(max_chunksize=10_000)

    return run


def pack(
    docs: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    tokens: int = TOKENS,
    documents: int = DOCUMENTS,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row.

    A document is its ids and ``end_id``; null is the empty text, so it has one token. Longer documents are
    cut into pieces of ``tokens``, the first of which takes the remainder. ``attention`` is the capacity for
    the sum of squared piece lengths, by default that of one full piece, which the token capacity implies.
    Repeated rows are packed as often as they occur; an empty table gives an empty result; other columns are ignored,
    whatever their names. ``path`` and ``ranks_path`` are the tokenizer's two files, on every machine.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(path, ranks_path, pattern, end_id, tokens), f"id {kind}, piece int, start long, length long, ids_crc32 long"))
    n = max(1, -(-pieces.count() // GROUP))
    # The rows are fixed by the checkpoint, so numbers by partition deal them alike in every attempt.
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(n)))
    capacity = (tokens, documents, attention or tokens * tokens)
    packed = dealt.repartition(n, "group").sortWithinPartitions("group").mapInArrow(_pack(capacity, weights, score), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)
