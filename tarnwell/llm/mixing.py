"""Mixing sources to target weights by hash thresholds, with DataFrame functions only.

A document's place in its source is a keyed hash of its id. For each source the mix takes every
document a whole number of times, and once more those whose hash lies below a threshold. The
threshold comes from histograms: words are summed by source and hash bucket, the bucket in
which the budget ends is found from running sums, and only that bucket is split again. Rows
are never sorted. As thresholds grow with the budget, a smaller mix is part of a larger one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import durable, join_small, running

BITS = 10
LEVELS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target): water-filling of ``share`` times all words by weight.

    The weights repeat over the sources in code point order, null last. A target stops at ``cap``
    times its source's words and the excess goes to the others by weight until none is above.
    In order of cap / weight the capped sources are a prefix, so running sums replace the loop. They are taken over range
    partitions, so sources may be as many as documents; only totals of all sources reach the driver.
    """
    all_words = sources.agg(F.sum("source_size")).first()[0] or 0
    ranked = running(sources, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    t = running(t, [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()], {"used": F.col("most"), "gone": F.col("weight")})
    all_weight = t.agg(F.sum("weight")).first()[0] or 0.0
    budget = F.lit(float(all_words) * float(share))
    t = durable(t.withColumn("capped", F.col("most") * (F.lit(all_weight) - F.col("gone")) <= (budget - F.col("used")) * F.col("weight")))
    spent, rest = t.agg(F.sum(F.when(F.col("capped"), F.col("most"))), F.sum(F.when(~F.col("capped"), F.col("weight")))).first()
    level = (budget - F.lit(spent or 0.0)) / F.lit(rest or 1.0)
    return t.select("source", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(level * F.col("weight")).alias("target"))


def _place(doc_id: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - BITS * LEVELS)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), _place(docs[id_col], seed).alias("place"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """(id, size, source_size, target, taken) for every row.

    ``taken`` is the words that the mix takes of the document, repeats counted: always a whole
    multiple of its size, at most ceil(cap) times it. A source's taken words end within one last
    hash bucket of its target. Null texts have size 0; null is a source of its own, ordered last;
    rows that repeat an id are taken alike; an empty table gives an empty result; other columns are ignored, whatever their names. Reruns agree,
    as places depend on ids and ``seed`` alone.
    """
    sized = durable(_sized(docs, id_col, text_col, source_col, seed))
    plan = thresholds(sized, weights, share, cap)
    both = join_small(sized.withColumnRenamed("source", "s"), plan, F.col("s").eqNullSafe(F.col("source")))
    return both.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def take(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, as often as ``mix`` takes them.

    Rows without words (null and blank texts) cost nothing and are taken once. Null is a source of its own; repeated rows are decided
    alike; an empty table gives an empty one; columns of any name pass through. Each row is decided by its own source, id and words
    as it is read; only the plan, one row per source, is joined to it.
    """
    sized = durable(_sized(docs, id_col, text_col, source_col, seed))
    plan = thresholds(sized, weights, share, cap).withColumnRenamed("source", "s")
    rows = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("row"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), _place(docs[id_col], seed).alias("place"))
    both = join_small(rows, plan, F.col("source").eqNullSafe(F.col("s")))
    often = F.when(F.col("size") > 0, times()).otherwise(1).cast("int")
    return both.select("row", F.explode(F.array_repeat(F.lit(0), often))).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def times() -> Column:
    """How often the mix takes a document, by its place and its source's row of the plan."""
    extra = (F.col("place") < F.col("at")) | ((F.col("place") == F.col("at")) & F.col("whole"))
    return F.col("passes") + extra.cast("long")


def thresholds(sized: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """(source, source_size, target, passes, at, whole): whole passes over each source and where the last one ends.

    Places below ``at`` are taken once more, the place ``at`` itself only if ``whole``.
    """
    width = BITS * LEVELS
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    plan = durable(plan.withColumn("at", F.lit(0).cast("long")).withColumn("held", F.col("source_size")))
    n = plan.count()
    running = Window.partitionBy("source").orderBy("bucket")
    for level in range(1, LEVELS + 1):
        shift = width - BITS * level
        inside = join_small(sized.withColumnRenamed("source", "s"), plan.select("source", "at", "left"), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("place", shift + BITS) == F.col("at")), rows=n)
        sums = inside.groupBy("source", F.shiftright("place", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        sums = sums.withColumn("upto", F.sum("words").over(running))
        edge = sums.where(F.col("upto") > F.col("left")).groupBy("source").agg(F.min_by(F.struct("bucket", "words", "upto"), "bucket").alias("edge"))
        edge = edge.withColumnRenamed("source", "s")
        plan = durable(
            plan.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").select(
                "source", "source_size", "target", "passes",
                F.coalesce(F.col("left") - (F.col("edge.upto") - F.col("edge.words")), F.lit(0.0)).alias("left"),
                F.coalesce("edge.bucket", F.lit(-1).cast("long")).alias("at"),
                F.coalesce("edge.words", F.lit(0).cast("long")).alias("held"),
            )
        )
    return plan.withColumn("whole", F.col("left") * 2 > F.col("held"))
