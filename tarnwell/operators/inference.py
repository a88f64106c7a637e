"""Enrichment by a language model: batches of candidates, calls, answers as rows, review.

The model is a function that the caller brings. Everything around it is relational: sizes are folded into
batches as a stream, answers are parsed by schema, and what they name is joined to the catalogue.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.operators import batching
from tarnwell.operators.catalog import number

LIMIT = 12_000
CHUNK = 100

_PROJECT = "name string, id string, dirs array<string>, paths array<string>, assay_type string, species string, species_confidence string, summary string"
_RELATION = "project_a string, project1 string, project_b string, project2 string, relation string, relationship string, score double"
PROJECTS = f"projects array<struct<{_PROJECT.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<{_RELATION.replace(' ', ':').replace(',:', ',')}>>, relationships array<struct<{_RELATION.replace(' ', ':').replace(',:', ',')}>>"
DATASETS = "datasets array<struct<name:string,type:string,species:string,assets:array<struct<name:string,type:string,files:array<struct<path:string,role:string>>>>>>"


def batches(candidates: DataFrame, root: str, order: str, size: str, has_children: str, limit: int = LIMIT, most: int | None = None, base: int = 0) -> DataFrame:
    """(root, order, batch): candidates of a scan root, in order, put into prompts of at most ``limit`` bytes.

    See ``batching.batches``.
    """
    return batching.batches(candidates, root, order, size, has_children, limit, most, base)


def chunks(rows: DataFrame, order: list[str], size: int = CHUNK) -> DataFrame:
    """Rows with ``chunk``: ``size`` rows each, in an order."""
    return number(rows, order, "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


class Busy(RuntimeError):
    """The service asks to try again (overload, gateway or transport errors)."""


def ask(prompts: DataFrame, connect: Callable[[], Callable[[str], str]], wanted: str | None = None, retries: int = 2, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, response, error) of (key, prompt) rows, answered by ``connect()``'s function, one client per task.

    Busy is tried again after 2**n seconds, ``retries`` times. An answer that is no JSON object with the array ``wanted``
    is asked for once more. The number of partitions is the number of calls at a time. Failures are rows with an error.
    """
    kind = prompts.schema["key"].dataType.simpleString()

    def good(answer: str) -> bool:
        try:
            return wanted is None or isinstance(json.loads(answer)[wanted], list)
        except (ValueError, KeyError, TypeError):
            return False

    def call(client: Callable[[str], str], prompt: str, tries: int) -> str:
        for n in range(tries + 1):
            try:
                return client(prompt)
            except Busy:
                if n == tries:
                    raise
                wait(2.0**n)
        raise AssertionError

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for part in parts:
            answers, errors = [], []
            for prompt in part.column(1).to_pylist():
                try:
                    client = client or connect()
                    answer = call(client, prompt, retries)
                    if not good(answer):
                        answer = call(client, prompt, 1)
                    answers.append(answer if good(answer) else None)
                    errors.append(None if good(answer) else "no usable answer")
                except Exception as e:  # noqa: BLE001 - reported as a row
                    answers.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())], ["key", "response", "error"])

    return prompts.select("key", "prompt").mapInArrow(run, f"key {kind}, response string, error string")


def parse_projects(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Projects (key, pos, name, dirs, ...) and relations (key, pos, project_a, project_b, relation, score) of (key, response) rows.

    Old field names count too. A response that is no such JSON, or in which a project lacks its name or directories or a
    relation one of its fields, gives no rows; without relations it gives projects only.
    """
    r = responses.select("key", F.from_json("response", PROJECTS).alias("r"))
    pick = lambda s, *names: F.coalesce(*[s[n] for n in names])
    relations = F.coalesce("r.relations", "r.relationships", F.array().cast("array<struct<" + _RELATION.replace(" ", ":").replace(",:", ",") + ">>"))
    parts = lambda s: (pick(s, "project_a", "project1"), pick(s, "project_b", "project2"), pick(s, "relation", "relationship"), s["score"])
    whole_p = F.forall("r.projects", lambda p: pick(p, "name", "id").isNotNull() & pick(p, "dirs", "paths").isNotNull())
    whole_r = F.forall(relations, lambda s: F.array(*[x.cast("string").isNotNull() for x in parts(s)]).eqNullSafe(F.array(*[F.lit(True)] * 4)))
    ok = r.withColumn("rel", relations).where(F.col("r.projects").isNotNull() & whole_p & whole_r)
    p = ok.select("key", F.posexplode("r.projects").alias("pos", "p"))
    projects = p.select("key", "pos", pick(p.p, "name", "id").alias("name"), pick(p.p, "dirs", "paths").alias("dirs"), "p.assay_type", "p.species", "p.species_confidence", "p.summary")
    s = ok.select("key", F.posexplode("rel").alias("pos", "s"))
    a, b, name, score = parts(s.s)
    return projects, s.select("key", "pos", a.alias("project_a"), b.alias("project_b"), name.alias("relation"), score.alias("score"))


def tails(col: str, mark: str) -> Column:
    """What follows each ``mark`` in a text, to its end."""
    parts = F.slice(F.split(col, mark), 2, F.greatest(F.size(F.split(col, mark)) - 1, F.lit(0)))
    return F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), mark))


def parse_datasets(responses: DataFrame, members: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Datasets, asset links and file metadata that (batch, response) rows name.

    members: (batch, pos, name, path), the candidates of each batch; files: (path, file_id, file_path), the files of each. A
    named dataset is the first member with that name, or a path that ends with /name, or a name that ends with _name;
    one that matches none is dropped. A named file is the smallest id of the dataset whose path ends with it. Returned are
    (path, name, dataset_type, species, confidence), (path, asset, asset_type, pos, file_id, role) and (file_id, assay_type, species).
    """
    d = responses.select("batch", F.from_json("response", DATASETS)["datasets"].alias("ds")).select("batch", F.posexplode("ds").alias("d", "s"))
    d = d.select("batch", "d", F.coalesce("s.name", F.lit("unnamed")).alias("said"), F.coalesce("s.type", F.lit("other")).alias("dataset_type"), F.when(F.col("s.species") != "null", F.col("s.species")).alias("species"), "s.assets")
    # All names that a member answers to, so that said ones meet them by equality.
    names = F.array_compact(F.concat(F.array("name"), F.coalesce(tails("path", "/"), F.array()), F.coalesce(tails("name", "_"), F.array())))
    m = members.select("batch", F.explode(F.array_distinct(names)).alias("said"), F.struct("pos", "name", "path").alias("m"))
    m = m.groupBy("batch", "said").agg(F.min("m").alias("m"))
    # Places in an answer never join one reading of it with another: an answer made anew can list the same in another order.
    named = d.join(m, ["batch", "said"])
    datasets = named.select(F.col("m.path").alias("path"), F.col("said").alias("name"), "dataset_type", "species", F.lit("high").alias("confidence"))
    a = named.select("batch", "d", F.col("m.path").alias("path"), "dataset_type", "species", F.posexplode("assets").alias("pos", "asset"))
    f = a.select("batch", "d", "path", "dataset_type", "species", "pos", F.col("asset.name").alias("asset"), F.col("asset.type").alias("asset_type"), F.posexplode("asset.files").alias("f", "file"))
    f = f.withColumn("said", F.coalesce("file.path", F.lit("")))
    # Paths are cut to the lengths of the names that their dataset is asked for, and meet them by equality.
    ends = f.select("path", F.length("said").alias("n")).distinct().join(files, "path").select("path", F.right("file_path", F.col("n")).alias("said"), "file_id")
    ends = ends.groupBy("path", "said").agg(F.min("file_id").alias("file_id"))
    links = f.join(ends, ["path", "said"]).select("path", "asset", "asset_type", "pos", "file_id", F.col("file.role").alias("role"), "dataset_type", "species")
    told = links.where((F.col("dataset_type") != "other") | F.col("species").isNotNull()).select("file_id", F.col("dataset_type").alias("assay_type"), "species").distinct()
    return datasets, links.drop("dataset_type", "species"), told


def pending_review(projects: DataFrame, now: int) -> DataFrame:
    """Projects whose species was told with low or medium confidence."""
    low = projects.where(F.col("species_confidence").isin("low", "medium"))
    return low.select(F.col("name").alias("project"), F.lit("species").alias("field"), F.col("species").alias("current_value"), F.col("species_confidence").alias("confidence"), F.lit(now).cast("long").alias("timestamp"))


def merge_projects(projects: DataFrame, order: str = "id", prefix: int = 4) -> DataFrame:
    """Projects with ``base``: the first, in order, of the same species with as long a common prefix of the name.

    Sharing the first characters is an equivalence, so pairwise merging until nothing changes is one grouping. Projects
    without species, or with shorter names, are their own.
    """
    key = F.when(F.col("species").isNotNull() & (F.length("name") >= prefix), F.struct("species", F.substring("name", 1, prefix).alias("head")))
    rows = projects.withColumn("_key", key)
    bases = rows.where("_key IS NOT NULL").groupBy("_key").agg(F.min(order).alias("base"))
    return rows.join(bases, "_key", "left").withColumn("base", F.coalesce("base", order)).drop("_key")


def rule_lines(patterns: DataFrame, least: int = 3) -> DataFrame:
    """(line) for prompts of patterns that were corrected often enough."""
    return patterns.where(F.col("count") >= least).select(F.concat(F.lit("- "), "pattern").alias("line"))


def candidate_list(answer: Column) -> Column:
    """Comma-separated candidates of an answer, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(answer, ","), lambda x: F.trim(x)), lambda x: x != "")


def clean_species(answer: Column) -> Column:
    """The last line of an answer if it is two or three words without Chinese, leading marks stripped; else null."""
    text = F.trim(F.element_at(F.split(F.regexp_replace(answer, r"^[\s\-:：]+", ""), "\n"), -1))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(words.between(2, 3) & ~text.rlike(r"[\x{4E01}-\x{10FFFF}]"), text)


def layered_prompt(system: str, rules: str = "", learned: str = "") -> str:
    """A prompt of up to three layers: the system's text, the user's rules, and rules learned from corrections."""
    parts = [system] + [f"# {title}\n{text}" for title, text in (("Rules", rules), ("Learned", learned)) if text]
    return "\n".join(parts) + "\n"
