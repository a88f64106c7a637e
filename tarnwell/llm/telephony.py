"""Telephony audio as a media column: mu-law, A-law and IMA ADPCM, and resampled PCM.

A payload of bytes is stored losslessly as 8-bit mu-law samples in a WAV file. Reading gives the
stored bytes back; they are expanded by lookup tables (as mu-law and as A-law), decoded as blocks
of 4-bit ADPCM, and resampled from 8 to 16 kHz PCM. ADPCM is sequential within a block, so the
decoder steps through the sample positions once and treats all blocks of many rows as one vector.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import rows_of

UNIT = 64
RATE = 8000
MULAW, PCM = 7, 1

#: Fixed values of the IMA ADPCM format.
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45,
    50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307,
    337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066,
    2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899,
    15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: complemented bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: even bits inverted, sign, 3-bit exponent, 4-bit mantissa."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, low = code >> 4 & 7, ((code & 15) << 4) + 8
    size = np.where(exponent == 0, low, low + 256 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def payload(text: str | None) -> bytes:
    """UTF-8 bytes, and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav(samples: bytes, kind: int, bits: int, rate: int) -> bytes:
    body = samples + b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHHH4sI", b"RIFF", 38 + len(body), b"WAVE", b"fmt ", 18, kind, 1, rate, rate * bits // 8, bits // 8, bits, 0, b"data", len(samples))
    return head + body


def wav_samples(media: bytes | None) -> tuple[int, bytes] | None:
    """(format code, sample bytes) of a WAV file, by walking its chunks; None if it is none or has no samples."""
    if media is None or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, kind = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt " and at + 10 <= len(media):
            kind = struct.unpack_from("<H", media, at + 8)[0]
        elif name == b"data":
            return (kind, media[at + 8 : at + 8 + size]) if at + 8 + size <= len(media) else None
        at += 8 + size + size % 2
    return None


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, 1 + 2 * (width - 4)) samples of IMA ADPCM blocks, one row of bytes each.

    A block starts with its first sample (16 bits), the step index and a reserved byte; indices
    beyond the table are clamped. One pass over the positions serves all blocks.
    """
    n, width = blocks.shape
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[0] = value
    data = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(width - 4):
        for k, code in enumerate((data[i] & 15, data[i] >> 4)):
            code = code.astype(np.int32)
            step = STEPS[index]
            change = step >> 3
            change += np.where(code & 4, step, 0)
            change += np.where(code & 2, step >> 1, 0)
            change += np.where(code & 1, step >> 2, 0)
            value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
            index = np.clip(index + INDEX_STEP[code], 0, 88)
            out[1 + 2 * i + k] = value
    return out.T


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean with its successor (the last repeats), rounded down."""
    wide = pcm.astype(np.int32)
    out = np.empty(2 * len(wide), np.int16)
    out[::2] = pcm
    out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
    if len(wide):
        out[-1] = pcm[-1]
    return out


def features(samples: bytes, adpcm: np.ndarray) -> tuple[str, np.ndarray]:
    """(features, PCM at twice the rate) of stored samples and the ADPCM decoding of their blocks; integers only."""
    codes = np.frombuffer(samples, np.uint8)
    mu, a = MULAW_PCM[codes], ALAW_PCM[codes]
    wide = mu.astype(np.int64)
    pcm = resample_double(mu)
    crossings = int(np.count_nonzero((mu[1:] < 0) != (mu[:-1] < 0)))
    text = (
        f"mulaw:energy={int(wide @ wide) // max(1, len(mu))};peak={int(np.abs(wide).max(initial=0))};crossings={crossings}"
        f"|alaw:sum={int(a.sum(dtype=np.int64))};peak={int(np.abs(a.astype(np.int32)).max(initial=0))}"
        f"|adpcm:sum={int(adpcm.sum(dtype=np.int64))};crc={zlib.crc32(np.ascontiguousarray(adpcm, '<i2'))}"
        f"|pcm16k:samples={len(pcm)};crc={zlib.crc32(pcm.astype('<i2', copy=False))}"
    )
    return text, pcm


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as a mu-law WAV file. Null is the empty text: 64 zero bytes.

    Repeated rows are alike; an empty table gives an empty result; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                texts = part.column(1).to_pylist()
                size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
                media = [wav(payload(t), MULAW, 8, RATE) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(media, pa.binary())], ["_id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def decode_media(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, media, payload, feature, pcm): stored files read back, decoded and measured.

    ``pcm`` is the mu-law expansion at 16 kHz as a 16-bit PCM WAV file. ADPCM blocks are of 64 bytes, the last filled with
    zeros; the blocks of up to 256 rows are decoded together. Null media, and what is no whole mu-law WAV file, give null payload,
    feature and pcm. One pass, no shuffle; equal media, equal values; an empty table gives an empty result; other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, most=1 << 23):
                read = map(wav_samples, part.column(2).to_pylist())
                stored = [r[1] if r and r[0] == MULAW else None for r in read]
                whole = [(s or b"") + bytes(-len(s or b"") % UNIT) for s in stored]
                cuts = np.append(0, np.cumsum([len(s) // UNIT for s in whole]))
                blocks = decode_adpcm(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, UNIT))
                found = [(None, None) if s is None else features(s, blocks[lo:hi].ravel()) for s, lo, hi in zip(stored, cuts[:-1], cuts[1:])]
                pcm = [None if p is None else wav(p.astype("<i2").tobytes(), PCM, 16, 2 * RATE) for _, p in found]
                columns = [*part.columns, pa.array(stored, pa.binary()), pa.array([t for t, _ in found], pa.string()), pa.array(pcm, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["_id", "n_bytes", "media", "payload", "feature", "pcm"])

    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(media[id_col].alias("_id"), media["n_bytes"].cast("long").alias("n_bytes"), media["media"].alias("media"))
    return rows.mapInArrow(run, f"_id {kind}, n_bytes long, media binary, payload binary, feature string, pcm binary").withColumnRenamed("_id", id_col)


#: Bytes of a WAV file before its samples.
HEAD = 46


def media_digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of decoded media: sizes, SHA-256 and CRC-32 of what was read back, and of the stored PCM file and its samples."""
    return decoded.select(
        id_col,
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -UNIT, UNIT)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
        F.crc32(F.expr(f"substring(pcm, {HEAD + 1})")).alias("pcm_crc32"),
    )
