"""A corpus pipeline: quality, line dedup, near-dedup, source mixing and packing of ``documents``.

Each stage reads what its predecessor wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwell.llm import linedup, mixing, neardup, packing, quality
from tarnwell.llm.common import durable, join_small, phase, release, remove, shared_folder, table

#: No SQL expresses a trained classifier, hash thresholds or best-fit packing; tests compare with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps, all rows of them. Null and blank texts, repeated rows, empty tables and other columns: see ``quality.classify``."""
    return quality.filter_documents(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier line repeats. Documents that lose all lines go; null and blank texts stay as they are.

    ``n_chars`` follows the text. Repeated rows of one id and text stay alike; an empty table gives an empty one; other columns pass through.
    """
    out = linedup.dedup_lines(docs, counts=False, keep_emptied=False)
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles, that of the smallest id.

    Line dedup takes from a near copy what it shares with its original, and what is left of both is rarely alike. So groups are
    first found on the whole texts that ``documents`` has for the ids that are still there, then on the texts as they are now.
    The whole text counts only where an id has one row there and one here, and each line here is one of its lines.

    Rows that repeat an id and a text are one document, and one of them stays. Rows of one id with different texts go by
    their own texts. Texts without words, and null ids, are linked with nothing. An empty table gives an empty one; other columns
    pass through.
    """
    key = [F.col("id"), F.col("text_hash")]
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash"))
    hashes = durable(docs.select(docs["doc_id"].alias("id"), F.xxhash64(docs["text"]).alias("text_hash")))
    whole = table(spark, sf_dir, "documents").select("doc_id", "text")
    with phase(spark):
        first = neardup.near_duplicates(whole, width=5, only=_unchanged(docs, whole)).where("NOT kept").select(F.col("doc_id").alias("id"))
        first = durable(hashes.join(first, "id", "left_semi").distinct(), stay=True)
    release(spark)
    left = hashes.join(first.select("id"), "id", "left_anti").select("id").distinct()
    with phase(spark):
        second = neardup.near_duplicates(docs.select("doc_id", "text"), width=5, text_hash=True, only=left).where("NOT kept").select(F.col("doc_id").alias("id"), "text_hash")
        gone = durable(first.union(second.distinct()).toDF("of", "hash"), stay=True)
    kept = join_small(rows, gone, (F.col("id") == F.col("of")) & (F.col("text_hash") == F.col("hash")), "left_anti")
    again = durable(hashes.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("of"), F.col("text_hash").alias("hash")))
    n = again.count()
    if n:
        same = F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("hash"))
        one = join_small(kept, again, same, "left_semi", n).groupBy(*key).agg(F.min_by("row", F.to_json("row")).alias("row"))
        kept = join_small(kept, again, same, "left_anti", n).select("row").union(one.select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def _unchanged(docs: DataFrame, whole: DataFrame) -> DataFrame:
    """Ids with one row in both tables whose text in ``docs`` has only lines of the text in ``whole``."""

    def lines(df: DataFrame, name: str) -> DataFrame:
        hashed = F.array_distinct(F.transform(F.split(df["text"], "\n"), lambda x: F.xxhash64(x)))
        own = df.select(df["doc_id"].alias("id"), hashed.alias("lines")).where("id IS NOT NULL")
        return own.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.first("lines").alias(name)).where("n = 1").select("id", name)

    both = lines(docs, "here").join(lines(whole, "there"), "id")
    return both.where(F.size(F.array_except("here", "there")) == 0).select("id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, so rows repeat. Those without words (null and blank texts) are taken once, as they cost nothing.

    A null source is one of its own. An empty table gives an empty one; other columns pass through.
    """
    return mixing.take(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens. A null text is an empty one, repeated rows are packed as
    often as they occur, an empty table gives an empty result, and other columns are ignored."""
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Stages are written to the shared folder that the session names, read again, and removed when the next
    is written; checkpoints of a stage go when it is written, those of the last stay, as its rows are read from them."""
    docs, last = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with phase(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}"
    # Pieces are checkpointed and numbered before the result is lazy, so only they are needed from here on.
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, folder)
    return out
