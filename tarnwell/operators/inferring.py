"""The inference run from files to datasets, resumable.

Candidates become sections, sections prompts, and prompts are asked once: a ledger keeps each answer under the hash of its prompt, so a
run that was stopped asks only what has no answer yet, and a run over changed files asks only what changed. What the answers name is
merged into the catalogue by stable keys (path, dataset and name, asset and file), so applying the same answers
again changes nothing.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnwell.functions.paths import base_name, dataset_name, parent
from tarnwell.operators import containment, datasets, discovery, inference, trees
from tarnwell.sources.store import durable, remove

#: Directories that a section shows; it says how many more there are.
SHOWN = 200
HEAD = inference.layered_prompt("Group these files into datasets, each with assets, each with files.")
TAIL = 'Answer in JSON: {"datasets":[{"name":"","type":"","species":"","assets":[{"name":"","type":"","files":[{"path":"","role":""}]}]}]}'

_ANSWER = "key string, response string, error string, asked_at long"


class Ledger:
    """Prompts and their answers under a folder, for one run at a time. Answers are appended wave by wave; a wave that fails leaves those before it."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def answers(self) -> DataFrame:
        """(key, response): the last usable answer of each prompt."""
        try:
            rows = self.spark.read.schema(_ANSWER).parquet(f"{self.root}/answers")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _ANSWER)
        return rows.where("response IS NOT NULL").groupBy("key").agg(F.max_by("response", "asked_at").alias("response"))

    def failures(self) -> DataFrame:
        """(key, tries, error) of prompts that never had a usable answer."""
        answered = self.answers().select("key")
        rows = self.spark.read.schema(_ANSWER).parquet(f"{self.root}/answers").join(answered, "key", "left_anti")
        return rows.groupBy("key").agg(F.count(F.lit(1)).alias("tries"), F.max_by("error", "asked_at").alias("error"))

    def ask(
        self,
        prompts: DataFrame,
        connect: Callable[[], Callable[[str], str]],
        wanted: str = "datasets",
        *,
        wave: int = 1000,
        at_once: int = 8,
        retries: int = 2,
        wait: Callable[[float], None] = time.sleep,
        clock: Callable[[], float] = time.time,
    ) -> int:
        """Ask the prompts (key, prompt) that have no answer yet, and how many those were.

        They are dealt to waves of about ``wave`` by their keys, each a job of ``at_once`` calls at a time that ends with its answers on disk.
        Failures are kept with their error and asked again by the next run.
        """
        open_ = f"{self.root}/open"
        remove(self.spark, open_)
        left = prompts.select("key", "prompt").dropDuplicates(["key"]).join(self.answers().select("key"), "key", "left_anti")
        left.write.parquet(f"{open_}/all")
        left = self.spark.read.parquet(f"{open_}/all")
        n = left.count()
        if n:
            waves = -(-n // wave)
            left.withColumn("wave", F.pmod(F.xxhash64("key"), F.lit(waves))).repartition("wave").write.partitionBy("wave").parquet(f"{open_}/waves")
            own = self.spark.read.schema("key string, prompt string, wave long").parquet(f"{open_}/waves")
            for k in range(waves):
                rows = own.where(F.col("wave") == k).select("key", "prompt").repartition(at_once)
                told = inference.ask(rows, connect, wanted, retries, wait).withColumn("asked_at", F.lit(int(clock() * 1000)))
                told.write.mode("append").parquet(f"{self.root}/answers")
        remove(self.spark, open_)
        return n


def sections(files: DataFrame, candidates: DataFrame, root: str, shown: int = SHOWN) -> DataFrame:
    """(path, name, section, kids): each candidate's text for a prompt, and whether others lie directly in it.

    Directories are described once and then joined to the candidates above them; a section shows the first ``shown`` of them by path.
    Candidates without files are left out.
    """
    own = candidates.select("path").where(F.col("path") != root).distinct()
    listed = trees.file_list(files).where(F.col("dir") != "")
    held = containment.containment(listed.select(F.col("dir").alias("id"), F.col("dir").alias("path")), own.select(F.col("path").alias("id"), "path"))
    rows = held.select(F.col("dataset_path").alias("path"), F.col("file_id").alias("dir")).join(listed, "dir")
    below = F.when(F.col("dir") == F.col("path"), ".").otherwise(F.substr("dir", F.length("path") + 1))
    line = F.concat(F.lit("  "), below, F.lit(": "), F.col("files").cast("string"), F.lit(" files ["), "types", F.lit("]  e.g. "), "sample")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("path").orderBy("dir"))).where(F.col("_r") <= shown)
    lines = first.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(F.struct("_r", line.alias("line"))))["line"], "\n").alias("lines"))
    dirs = rows.groupBy("path").agg(F.count(F.lit(1)).alias("_n"))
    pairs = discovery.children(own)
    inside = pairs.select(F.col("parent").alias("path"), base_name("child").alias("_b")).groupBy("path").agg(F.array_join(F.sort_array(F.collect_list("_b")), ", ").alias("_kids"))
    above = pairs.select(F.col("child").alias("path"), base_name("parent").alias("_up"))
    all_ = lines.join(dirs, "path").join(inside, "path", "left").join(above, "path", "left")
    name = dataset_name("path", root)
    more = F.when(F.col("_n") > shown, F.format_string("\n  ... +%d more directories", F.col("_n") - shown)).otherwise("")
    note = F.concat(
        F.when(F.col("_kids").isNotNull(), F.concat(F.lit("[also candidates: "), "_kids", F.lit("]\n"))).otherwise(""),
        F.when(F.col("_up").isNotNull(), F.concat(F.lit("[in candidate: "), "_up", F.lit("]\n"))).otherwise(""),
    )
    text = F.concat(F.lit("\n--- Dataset: "), name, F.lit(" (path: "), "path", F.lit(") ---\n"), note, "lines", more, F.lit("\n"))
    return all_.select("path", name.alias("name"), text.alias("section"), F.col("_kids").isNotNull().alias("kids"))


class Prompts(NamedTuple):
    prompts: DataFrame
    """(key, prompt); the key is the prompt's SHA-256."""
    members: DataFrame
    """(batch, pos, name, path): the candidates of each prompt, ``batch`` being its key."""


def prompts(files: DataFrame, candidates: DataFrame, root: str, head: str = HEAD, tail: str = TAIL, limit: int = inference.LIMIT, most: int | None = None) -> Prompts:
    """Candidates put into prompts of at most ``limit`` bytes, where one section fits."""
    rows = sections(files, candidates, root).withColumns({"root": F.lit(root), "size": F.octet_length("section")})
    dealt = inference.batches(rows, "root", "path", "size", "kids", limit, most, base=len(head.encode()))
    packed = rows.join(dealt, ["root", "path"]).groupBy("root", "batch").agg(F.array_sort(F.collect_list(F.struct("path", "name", "section"))).alias("m"))
    text = F.concat(F.lit(head), F.array_join("m.section", ""), F.lit(tail))
    out = packed.select(F.sha2(text, 256).alias("key"), text.alias("prompt"), "m")
    members = out.select(F.col("key").alias("batch"), F.posexplode("m").alias("pos", "m")).select("batch", F.col("pos").cast("long").alias("pos"), "m.name", "m.path")
    return Prompts(out.select("key", "prompt"), members)


class Catalogue(NamedTuple):
    """The tables that a run reads and gives back changed."""

    files: DataFrame
    tags: DataFrame
    dataset: DataFrame
    asset: DataFrame
    asset_file: DataFrame
    snapshot: DataFrame


def merge_assets(assets: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or update by dataset and name: a known asset keeps its id. ``new``: (dataset_id, name, asset_type), each pair once."""
    told = new.select(F.col("dataset_id").alias("_d"), F.col("name").alias("_name"), F.col("asset_type").alias("_type"))
    same = (F.col("dataset_id") == F.col("_d")) & (F.col("name") == F.col("_name"))
    kept = assets.join(told, same, "left").withColumn("asset_type", F.when(F.col("_d").isNotNull(), F.col("_type")).otherwise(F.col("asset_type"))).select(assets.columns)
    fresh = new.join(assets.select("dataset_id", "name").distinct(), ["dataset_id", "name"], "left_anti")
    return datasets.put_assets(kept, fresh)


def _differs(old: list[Column], new: list[Column]) -> Column:
    out = F.lit(False)
    for a, b in zip(old, new):
        out = out | ~a.eqNullSafe(b)
    return out


class Result(NamedTuple):
    tables: Catalogue
    texts: DataFrame
    """(id, metadata, path, tags) for the full-text index: files of datasets that this run added or changed."""
    asked: int
    changed: int
    """Datasets that this run added or changed; with none, no snapshot is made."""


def infer(
    tables: Catalogue,
    candidates: DataFrame,
    root: str,
    connect: Callable[[], Callable[[str], str]],
    ledger: Ledger,
    *,
    now: int,
    trigger: str = "infer",
    limit: int = inference.LIMIT,
    most: int | None = None,
    keep: Callable[[DataFrame], DataFrame] = durable,
    **asking,
) -> Result:
    """Run the inference over live files, and what the catalogue is then.

    Prompts are made of the candidates and asked as far as the ledger has no answer. Named datasets are put by path, assets by dataset
    and name, links by asset and file; the metadata of named files is written where it differs; files of a dataset that no answer links
    become auxiliary. New datasets and assets belong to a new snapshot. Candidates that no answer names change nothing. ``keep`` cuts the lineage of the
    few small tables that are used again.
    """
    live = tables.files.where("NOT deleted").select("id", "path")
    asked_for = prompts(live, candidates, root, limit=limit, most=most)
    made = Prompts(keep(asked_for.prompts), keep(asked_for.members))
    asked = ledger.ask(made.prompts, connect, **asking)
    responses = made.prompts.join(ledger.answers(), "key").select(F.col("key").alias("batch"), "response")
    boxes = made.members.select(F.col("path").alias("id"), "path").distinct()
    held = containment.containment(live, boxes).select(F.col("dataset_path").alias("path"), "file_id")
    named = held.join(live.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id").select("path", "file_id", "file_path")
    found, links, told = (keep(x) for x in inference.parse_datasets(responses, made.members, named))

    # Datasets: of several answers for a path the least name counts; what is as it was is left alone.
    put = found.groupBy("path").agg(F.min(F.struct("name", "dataset_type", "species", "confidence")).alias("d")).select("path", "d.*")
    fields = ("name", "dataset_type", "species", "confidence")
    have = tables.dataset.select("path", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_known"))
    put = keep(put.join(have, "path", "left").where(F.col("_known").isNull() | _differs([F.col(c) for c in fields], [F.col(f"_{c}") for c in fields])).select("path", *fields))
    changed = put.count()
    dataset = keep(datasets.put_datasets(tables.dataset, put, now)) if changed else tables.dataset

    # Assets and links, with the files that no answer links as one more asset of their dataset.
    ids = dataset.select(F.col("id").alias("dataset_id"), "path")
    told_links = links.select("path", F.coalesce("asset", F.lit("unnamed")).alias("name"), "asset_type", "file_id", "role").join(ids, "path")
    linked = told_links.select("dataset_id", "file_id").union(tables.asset_file.join(tables.asset.select(F.col("id").alias("asset_id"), "dataset_id"), "asset_id").select("dataset_id", "file_id"))
    inside = containment.containment(live, dataset.select("id", "path")).select("dataset_id", "file_id")
    rest = inside.join(linked, ["dataset_id", "file_id"], "left_anti").select("dataset_id", F.lit(datasets.AUXILIARY).alias("name"), F.lit(datasets.AUXILIARY).alias("asset_type"), "file_id", F.lit("auxiliary").alias("role"))
    every = keep(told_links.select("dataset_id", "name", "asset_type", "file_id", "role").union(rest))
    asset = keep(merge_assets(tables.asset, every.groupBy("dataset_id", "name").agg(F.min("asset_type").alias("asset_type"))))
    of = every.join(asset.select(F.col("id").alias("asset_id"), "dataset_id", "name"), ["dataset_id", "name"]).select("asset_id", "file_id", "role")
    asset_file = datasets.link_files(tables.asset_file, of)

    # Metadata of named files, where it differs.
    one = told.groupBy("file_id").agg(F.min(F.struct("assay_type", "species")).alias("m")).select(F.col("file_id").alias("id"), "m.*")
    was = tables.files.select("id", F.col("assay_type").alias("_a"), F.col("species").alias("_s"))
    one = one.join(was, "id").where(_differs([F.col("assay_type"), F.col("species")], [F.col("_a"), F.col("_s")])).select("id", "assay_type", "species")
    one = keep(one.withColumns({"project": F.lit(None).cast("string"), "tags": F.array().cast("array<string>")}))
    files, tags = datasets.put_metadata(tables.files, tables.tags, one, now)

    snapshot = tables.snapshot
    if changed:
        snapshot = datasets.create_snapshot(tables.snapshot, trigger, f"{changed} datasets", now)
        number = snapshot.agg(F.max("id")).first()[0]
        fresh = dataset.join(tables.dataset.select("id"), "id", "left_anti").select("id")
        dataset = datasets.stamp(dataset, fresh, number)
        asset = datasets.stamp(asset, asset.join(tables.asset.select("id"), "id", "left_anti").select("id"), number)
    touched = dataset.join(put.select("path"), "path", "left_semi")
    texts = datasets.enrichment_texts(asset_file, asset, touched, files).withColumn("tags", F.array().cast("array<string>"))
    return Result(Catalogue(files, tags, dataset, asset, asset_file, snapshot), texts.select("id", "metadata", "path", "tags"), asked, changed)
