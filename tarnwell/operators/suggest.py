"""Related datasets of the same species."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.functions.text import fold

# Dataset types and those that complement them.
COMPLEMENTS = {
    "RNA-seq": ("ChIP-seq", "ATAC-seq", "WGBS"),
    "transcriptome": ("epigenome", "genome", "proteome"),
    "WGS": ("WGBS", "RNA-seq", "ChIP-seq"),
    "genome": ("transcriptome", "genome_annotation", "epigenome"),
    "genome_annotation": ("transcriptome", "proteome", "functional"),
    "scRNA-seq": ("scATAC-seq", "CITE-seq"),
    "ChIP-seq": ("RNA-seq", "ATAC-seq"),
    "ATAC-seq": ("RNA-seq", "ChIP-seq"),
    "WGBS": ("RNA-seq", "WGS"),
}


def suggest(datasets: DataFrame, dataset_id: int, n: int = 10, complements: dict = COMPLEMENTS) -> DataFrame:
    """The n best of the newest max(20 n, 100) datasets of the same species.

    0.5 for the species, 0.35 for a complementary type or else 0.15 for another one, 0.05 for high confidence.
    """
    own = datasets.where(F.col("id") == dataset_id).select(fold("species").alias("_s"), fold(F.coalesce("dataset_type", F.lit(""))).alias("_t"))
    pool = datasets.where(F.col("id") != dataset_id).withColumn("_s", fold("species")).join(F.broadcast(own), "_s")
    pool = pool.orderBy(F.desc("updated_at"), "id").limit(max(20 * n, 100))
    mine = fold(F.coalesce("dataset_type", F.lit("")))
    fits = F.lit(False)
    for source, wanted in complements.items():
        fits = fits | ((F.col("_t") == source.lower()) & mine.isin(*[w.lower() for w in wanted]))
    other = (mine != F.col("_t")) & (mine != "")
    high = F.coalesce(F.col("confidence") == "high", F.lit(False))
    score = F.lit(0.5) + F.when(fits, 0.35).when(other, 0.15).otherwise(0.0) + F.when(high, 0.05).otherwise(0.0)
    why = F.concat_ws(", ", F.lit("same species"), F.when(fits, "complementary dataset type").when(other, "different dataset type"), F.when(high, "high-confidence species"))
    return pool.select("id", "path", F.round(score, 6).alias("score"), why.alias("summary")).orderBy(F.desc("score"), "path").limit(n)
