"""The registered inference run, with a client that answers by rule."""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import functions as F

from tarnwell.operators import discovery, inferring
from tarnwell.plans.queries import PARTS
from tarnwell.plans.registry import register
from tarnwell.sources.store import scratch_folder

NOW = 2_000_000_000

TABLES = {
    "dataset": "id long, name string, path string, dataset_type string, species string, confidence string, summary string, indexed_at long, updated_at long, snapshot_id long",
    "asset": "id long, dataset_id long, name string, asset_type string, snapshot_id long",
    "asset_file": "asset_id long, file_id long, role string",
    "snapshot": "id long, created_at long, trigger string, summary string",
    "tags": "file_id long, tag string",
}

_SECTION = re.compile(r"^--- Dataset: (\S*) \(path: (\S+)\) ---$")


def by_rule():
    """A client that finds one dataset in each section: its type by its language, and its first file as the primary one."""

    def answer(prompt: str) -> str:
        found: list[dict] = []
        for line in prompt.splitlines():
            if section := _SECTION.match(line):
                lang = section[1].split("_")[0]
                found.append({"name": section[1], "type": "genome" if lang == "en" else "transcriptome", "species": lang if lang != "de" else "null", "assets": []})
            elif found and "e.g. " in line and not found[-1]["assets"]:
                found[-1]["assets"] = [{"name": "main", "type": "raw", "files": [{"path": line.rpartition("e.g. ")[2], "role": "primary"}]}]
        return json.dumps({"datasets": found})

    return answer


def empty_catalogue(spark, files) -> inferring.Catalogue:
    none = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    return inferring.Catalogue(files=files, **none)


@register(PARTS + """, d as (select dir, lang, source, min(name) as first, count(*) as n, bool_or(ext in ('fastq.gz', 'bam', 'vcf.gz', 'h5', 'gtf', 'fq')) as bio from extended group by all)
select dir as path, lang || '_' || source as name, case when lang = 'en' then 'genome' else 'transcriptome' end as dataset_type, case when lang <> 'de' then lang end as species,
  case when n > 1 then 2 else 1 end as assets, 1 as primary_files, n - 1 as auxiliary_files, 1 as described, n as texts, 1 as snapshot_id from d where bio""")
def infer_run(c):
    none = lambda kind: F.lit(None).cast(kind)
    files = c.docs.select("id", "path", "size", none("string").alias("bio_metadata"), none("string").alias("species"), none("string").alias("assay_type"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("updated_at"))
    ledger = inferring.Ledger(c.spark, f"{scratch_folder(c.spark)}/ledger-{uuid.uuid4().hex}")
    targets = discovery.targets(discovery.signals(c.docs, 1))
    out = inferring.infer(empty_catalogue(c.spark, files), targets, "/data", lambda: by_rule(), ledger, now=NOW)
    t = out.tables
    links = t.asset_file.join(t.asset.select(F.col("id").alias("asset_id"), "dataset_id"), "asset_id")
    told = links.join(t.files.where("assay_type IS NOT NULL").select(F.col("id").alias("file_id"), F.lit(1).alias("told")), "file_id", "left")
    told = told.join(out.texts.select(F.col("id").alias("file_id"), F.lit(1).alias("text")), "file_id", "left")
    per = told.groupBy("dataset_id").agg(
        F.count_distinct("asset_id").alias("assets"), F.count_if(F.col("role") == "primary").alias("primary_files"), F.count_if(F.col("role") == "auxiliary").alias("auxiliary_files"),
        F.count("told").alias("described"), F.count("text").alias("texts"),
    )
    return t.dataset.join(per, F.col("id") == F.col("dataset_id")).select("path", "name", "dataset_type", "species", *[c for c in per.columns if c != "dataset_id"], "snapshot_id")
