"""Language identification by nearest centroids.

A text is a vector of hashed runs of 2 to 4 bytes over its lower-cased letters: 1 + ln(count), times the inverse document frequency, scaled to
length 1. Each language gets several centroids by spherical k-means, and a text the language of the centroid with
the largest cosine. Cosines grow with a text's length, so rejection compares them with a limit for the
language and the text's number of different runs, set from the training texts' own cosines.

Document frequencies are counted over all training rows. Clusters are fitted on a sample of ``SAMPLE`` different texts of each language,
chosen by hash of the text; that bounds what one task clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import join_small, rows_of

DIMS = 1 << 13
SIZES = (2, 3, 4)
CENTROIDS = 4
#: Different texts of each language that its centroids are fitted on.
SAMPLE = 512
#: A text is rejected below this share of the least cosine that training texts of its length reached.
SLACK = 0.7
UNKNOWN = "und"

_BLOCK = 1 << 20
_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_LETTER = regex.compile(r"\p{L}")
_BANDS = DIMS.bit_length() + 1


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, counts) of a whole text, block by block, so memory follows the text and not its runs."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_BYTES) + b" ", np.uint8)
    raw = raw[np.append(True, (raw[1:] != 32) | (raw[:-1] != 32))]
    total = np.zeros(DIMS, np.int64)
    for at in range(0, len(raw), _BLOCK):
        for size in SIZES:
            part = raw[at : at + _BLOCK + size - 1].astype(np.uint64)
            code = np.full(max(0, len(part) - size + 1), size, np.uint64)
            for i in range(size):
                code = code << np.uint64(8) | part[i : i + len(code)]
            total += np.bincount((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[at]
    return v / max(1e-12, float(np.sqrt(v @ v)))


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def band(n: int) -> int:
    return int(n).bit_length()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(DIMS + 1, np.int64)
    for batch in batches:
        for part in rows_of(batch):
            for text in part.column(0).to_pylist():
                if has_letter(text):
                    seen[grams(text)[0]] += 1
                    seen[DIMS] += 1
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["dim", "n"])


def _vectors(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch):
                lang, dims, values = [], [], []
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if has_letter(text):
                        at, n = grams(text)
                        lang.append(name)
                        dims.append(at.astype(np.int32))
                        values.append(vector(at, n, idf.value).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(dims, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], ["lang", "dims", "vals"])

    return run


def cluster(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centroids of length 1 by spherical k-means, from a start of far rows: each next one is the row least like those taken."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        far = int(np.argmin(near))
        if near[far] > 1 - 1e-6:
            break
        chosen.append(far)
        near = np.maximum(near, x @ x[far])
    centers, of = x[chosen].copy(), None
    for _ in range(rounds):
        now = np.argmax(x @ centers.T, axis=1)
        if of is not None and (now == of).all():
            break
        of = now
        for j in range(len(centers)):
            if (of == j).any():
                centers[j] = x[of == j].mean(0)
        centers /= np.maximum(1e-12, np.sqrt((centers * centers).sum(1, keepdims=True)))
    return centers


def _clusters(k: int):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("dims").to_pylist(), table.column("vals").to_pylist()))
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, (at, v) in enumerate(rows):
            x[i, at] = v
        centers = cluster(x, k)
        best = (x @ centers.T).max(1)
        limits = np.full(_BANDS, np.nan)
        for b, value in zip([band(len(r[0])) for r in rows], best):
            limits[b] = np.nanmin([limits[b], value])
        n, lang = len(centers), table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "no": pa.array(range(n), pa.int32()), "center": pa.array(list(centers), pa.list_(pa.float32())), "limits": pa.array([limits] * n, pa.list_(pa.float64()))})

    return run


class Model(NamedTuple):
    idf: np.ndarray
    langs: list[str]
    """Of each centroid."""
    centers: np.ndarray
    """A row for each dimension, a column for each centroid."""
    limits: np.ndarray
    """Of each centroid and band of length: the least cosine of training texts, from the next shorter band (else the next longer) where a band has none."""

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(nearest language, cosine in 0 to 1, rejected); UNKNOWN without letters, or where nothing was learned."""
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, n = grams(text)
        cosine = vector(at, n, self.idf) @ self.centers[at]
        best = int(np.argmax(cosine))
        score = float(min(1.0, max(0.0, cosine[best])))
        return self.langs[best], score, score < SLACK * self.limits[best, band(len(at))]


def _filled(limits: np.ndarray) -> np.ndarray:
    out = limits.copy()
    known = np.flatnonzero(~np.isnan(limits))
    for b in range(len(out)):
        if np.isnan(out[b]):
            below = known[known < b]
            out[b] = limits[below[-1] if len(below) else known[0]]
    return out


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", centroids: int = CENTROIDS, sample: int = SAMPLE) -> Model:
    """The model of labelled rows; those without a language or a letter teach nothing.

    Frequencies come from all rows. About ``sample`` different texts of each language, by hash, are clustered, each language in
    one task; the driver gets ``centroids`` rows of DIMS numbers a language.
    """
    spark = rows.sparkSession
    known = rows.select(rows[lang_col].cast("string").alias("lang"), rows[text_col].alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    found = known.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(DIMS + 1, np.float64)
    for r in found:
        seen[r.dim] = r.n
    idf = np.log((1 + seen[DIMS]) / (1 + seen[:DIMS])) + 1
    hashed = F.xxhash64("text")
    sizes = known.groupBy("lang").agg(F.approx_count_distinct(hashed).alias("n")).withColumn("up_to", (F.lit(float(sample)) / F.greatest("n", F.lit(1)) * (1 << 30)).cast("long"))
    chosen = join_small(known, sizes, "lang").where(F.pmod(hashed, F.lit(1 << 30)) < F.col("up_to")).select("lang", "text", hashed.alias("hash")).dropDuplicates(["lang", "hash"])
    vectors = chosen.select("lang", "text").mapInArrow(_vectors(spark.sparkContext.broadcast(idf)), "lang string, dims array<int>, vals array<float>")
    made = vectors.groupBy("lang").applyInArrow(_clusters(centroids), "lang string, no int, center array<float>, limits array<double>").collect()
    made.sort(key=lambda r: (r.lang, r.no))
    centers = np.array([r.center for r in made], np.float64).reshape(-1, DIMS).T
    return Model(idf, [r.lang for r in made], np.ascontiguousarray(centers), np.array([_filled(np.array(r.limits)) for r in made]).reshape(-1, _BANDS))


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a row is kept from learning, by the CRC-32 of its id as text; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from its text alone.

    ``lang_pred`` is the nearest centroid's language and ``score`` its cosine, 0 to 1. ``rejected`` is true where the
    text lies further from it than training texts of its length do; a caller that wants no guess there takes only rows
    that are not rejected. Texts that are null, empty or without a letter get "und", 0 and true, as all do if nothing was learned. Ties go to the
    language that sorts first. Texts of any length are taken whole; repeated rows are alike; an empty table gives an empty result;
    other columns are ignored, whatever their names. One pass, no shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for part in rows_of(batch):
                lang, score, rejected = zip(*[m.predict(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array([bool(x) for x in rejected])], ["_id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("_id", id_col)
