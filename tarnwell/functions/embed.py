"""Text embeddings: feature hashing, and pooled outputs of a model that the caller brings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

DIM = 384
#: Weight and suffix of the three buckets of a word.
BUCKETS = ((1.0, ""), (0.7, "_2"), (0.5, "_3"))
#: White space as Unicode has it; Python's \s has four control characters more.
WORD = re.compile(r"(?:\S|[\x1c-\x1f])+")


def siphash13(items: list[bytes]) -> np.ndarray:
    """SipHash-1-3 with a zero key of each item; items with as many eight-byte blocks are hashed together."""
    out = np.zeros(len(items), np.uint64)
    blocks = np.array([len(x) // 8 + 1 for x in items], np.int64)
    for n in np.unique(blocks):
        at = np.flatnonzero(blocks == n)
        raw = b"".join(items[i].ljust(n * 8 - 1, b"\0") + bytes([len(items[i]) & 255]) for i in at)
        words = np.frombuffer(raw, "<u8").reshape(len(at), n)
        v = [np.full(len(at), c, np.uint64) for c in (0x736F6D6570736575, 0x646F72616E646F6D, 0x6C7967656E657261, 0x7465646279746573)]
        for column in words.T:
            v[3] ^= column
            _round(v)
            v[0] ^= column
        v[2] ^= np.uint64(0xFF)
        for _ in range(3):
            _round(v)
        out[at] = v[0] ^ v[1] ^ v[2] ^ v[3]
    return out


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(v: list[np.ndarray]) -> None:
    for a, b, first, c, d, second in ((0, 1, 13, 2, 3, 16), (2, 1, 17, 0, 3, 21)):
        v[a] = v[a] + v[b]
        v[b] = _turn(v[b], first) ^ v[a]
        if a == 0:
            v[0] = _turn(v[0], 32)
            v[c] = v[c] + v[d]
            v[d] = _turn(v[d], second) ^ v[c]
        else:
            v[2] = _turn(v[2], 32)
            v[c] = v[c] + v[d]
            v[d] = _turn(v[d], second) ^ v[c]


def hash_embed(texts: list[str | None], dim: int = DIM) -> np.ndarray:
    """One row per text: each word adds to three hashed buckets, then rows get length 1. Texts without words are zeros."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    distinct = sorted({w for row in words for w in row})
    place = {w: i for i, w in enumerate(distinct)}
    at = [(siphash13([(w + suffix).encode("utf-8", "surrogatepass") + b"\xff" for w in distinct]) % np.uint64(dim)).astype(np.int64) for _, suffix in BUCKETS]
    out = np.zeros((len(texts), dim))
    for row, mine in zip(out, words):
        which = np.array([place[w] for w in mine], np.int64)
        for (weight, _), bucket in zip(BUCKETS, at):
            row += weight * np.bincount(bucket[which], minlength=dim)
    return unit(out, 0.0).astype(np.float32)


def unit(rows: np.ndarray, least: float = 1e-12) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(norm > least, norm, 1.0 if least == 0 else least)


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps, then length 1."""
    m = mask[:, :, None].astype(np.float64)
    return unit((hidden * m).sum(1) / np.maximum(m.sum(1), 1e-9)).astype(np.float32)


class Model(Protocol):
    """Token outputs of a batch of texts: (texts, tokens, dimensions) and the mask (texts, tokens)."""

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]: ...


def embed(rows: DataFrame, id_col: str, text_col: str, load: Callable[[], Model] | None = None, dim: int = DIM, size: int = 32) -> DataFrame:
    """(id, vector) of each row.

    ``load`` makes the model once per task; if it fails, or is not given, all texts are hashed. A model's own errors
    are raised. Texts under two bytes, null too, are always hashed, to DIM dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        if load is not None:
            try:
                model = load()
            except Exception:  # noqa: BLE001 - any failure to load means hashing
                model = None
        for batch in batches:
            for lo in range(0, batch.num_rows, size):
                part = batch.slice(lo, size)
                texts = [t or "" for t in part.column(1).to_pylist()]
                out = list(hash_embed(texts, DIM if model else dim))
                long_ = [i for i, t in enumerate(texts) if len(t.encode("utf-8", "surrogatepass")) >= 2]
                if model and long_:
                    for i, vector in zip(long_, pool(*model([texts[i] for i in long_]))):
                        out[i] = vector
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tolist() for v in out], pa.list_(pa.float32()))], ["_id", "vector"])

    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(rows[id_col].alias("_id"), rows[text_col].alias("_text"))
    return picked.mapInArrow(run, f"_id {kind}, vector array<float>").withColumnRenamed("_id", id_col)


#: Dimensions of known models; others are taken to have 384.
DIMENSIONS = {"all-MiniLM-L6-v2": 384, "all-mpnet-base-v2": 768, "gte-small": 384, "gte-base": 768}


def dimensions(model: str) -> int:
    return DIMENSIONS.get(model, 384)


def decode_floats(rows: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """(id, vector) from little-endian 32-bit floats; bytes after the last whole one are dropped, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [None if b is None else np.frombuffer(b, "<f4", len(b) // 4).tolist() for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], ["_id", "vector"])

    kind = rows.schema[id_col].dataType.simpleString()
    picked = rows.select(rows[id_col].alias("_id"), rows[blob_col].alias("_blob"))
    return picked.mapInArrow(run, f"_id {kind}, vector array<float>").withColumnRenamed("_id", id_col)
