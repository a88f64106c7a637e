"""The inference run: prompts, a ledger that outlives a killed run, and writes that can be repeated."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import datasets, inference, inferring
from tarnwell.plans.inferring import TABLES, by_rule, empty_catalogue

FILES = "id long, path string, size long, bio_metadata string, species string, assay_type string, deleted boolean, updated_at long"


def files(spark, names, deleted=()):
    return spark.createDataFrame([(i, p, 1, None, None, None, p in deleted, 0) for i, p in enumerate(names)], FILES)


def candidates(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


NAMES = [f"/r/en/s{k}/{n}" for k in range(8) for n in ("a.bam", "b.bam", "c.txt")] + ["/r/en/s0/deep/x.bam", "/r/en/s0/deep/.git/y", "/r/other.txt"]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_sections_and_prompts(spark):
    some = files(spark, NAMES)
    picked = candidates(spark, "/r", "/r/en/s0", "/r/en/s0/deep", "/r/en/s1", "/none")
    got = {r.path: r for r in inferring.sections(some, picked, "/r").collect()}
    assert set(got) == {"/r/en/s0", "/r/en/s0/deep", "/r/en/s1"}
    assert got["/r/en/s0"].kids and not got["/r/en/s1"].kids
    assert got["/r/en/s0"].section == "\n--- Dataset: en_s0 (path: /r/en/s0) ---\n[also candidates: deep]\n  .: 3 files [.bam×2, .txt×1]  e.g. a.bam\n  /deep: 1 files [.bam×1]  e.g. x.bam\n"
    assert "[in candidate: s0]" in got["/r/en/s0/deep"].section
    cut = {r.path: r.section for r in inferring.sections(some, picked, "/r", shown=1).collect()}
    assert cut["/r/en/s0"].endswith("e.g. a.bam\n  ... +1 more directories\n")
    size = len(got["/r/en/s1"].section.encode()) + len(inferring.HEAD.encode())
    made = inferring.prompts(some, candidates(spark, *[f"/r/en/s{k}" for k in range(1, 8)]), "/r", limit=size + 10)
    assert made.prompts.count() == 7 and made.members.count() == 7
    assert {len(r.key) for r in made.prompts.collect()} == {64}
    one = inferring.prompts(some, candidates(spark, *[f"/r/en/s{k}" for k in range(1, 8)]), "/r")
    assert one.prompts.count() == 1 and [r.pos for r in one.members.orderBy("pos").collect()] == list(range(7))


def counting(folder, die_at=None):
    """A client whose calls leave a file each; it takes its process with it at call ``die_at``."""

    def connect():
        answer = by_rule()

        def call(prompt):
            if die_at is not None and len(os.listdir(folder)) >= die_at:
                os._exit(1)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            return answer(prompt)

        return call

    return connect


def run(spark, tables, client, root, **more):
    size = 500
    return inferring.infer(tables, candidates(spark, *[f"/r/en/s{k}" for k in range(8)]), "/r", client, inferring.Ledger(spark, root), now=100, limit=size, most=1, wave=2, at_once=1, **more)


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    tables = empty_catalogue(spark, files(spark, NAMES, deleted=("/r/en/s7/b.bam",)))
    with pytest.raises(Exception):
        run(spark, tables, counting(str(calls), die_at=4), f"{tmp_path}/ledger")
    before = inferring.Ledger(spark, f"{tmp_path}/ledger").answers().count()
    made = len(os.listdir(calls))
    assert 0 < before <= made == 4
    out = run(spark, tables, counting(str(calls)), f"{tmp_path}/ledger")
    # Only what has no answer on disk was asked: a wave of two is the most that a kill can lose.
    assert out.asked == 8 - before and len(os.listdir(calls)) == made + 8 - before and made - before < 2 + 1
    whole = run(spark, tables, counting(str(calls)), f"{tmp_path}/other")
    assert whole.asked == 8
    for a, b in zip(out.tables, whole.tables):
        assert rows(a.drop("tags")) == rows(b.drop("tags"))
    assert rows(out.texts.drop("tags")) == rows(whole.texts.drop("tags")) and out.texts.count() == 25
    assert not [x for x in os.listdir(tmp_path / "ledger") if x.startswith("open")]


def test_what_a_run_writes(spark, tmp_path):
    tables = empty_catalogue(spark, files(spark, NAMES))
    out = run(spark, tables, lambda: by_rule(), f"{tmp_path}/ledger").tables
    assert [tuple(r) for r in out.dataset.select("id", "name", "path", "dataset_type", "species", "confidence", "updated_at", "snapshot_id").orderBy("id").limit(2).collect()] == [
        (1, "en_s0", "/r/en/s0", "genome", "en", "high", 100, 1), (2, "en_s1", "/r/en/s1", "genome", "en", "high", 100, 1),
    ]
    assert rows(out.snapshot) == [(1, 100, "infer", "8 datasets")]
    of = out.asset_file.join(out.asset.select(F.col("id").alias("asset_id"), "dataset_id", "name", "snapshot_id"), "asset_id")
    assert rows(of.where("dataset_id = 1").select("name", "file_id", "role", "snapshot_id")) == [("auxiliary_files", 1, "auxiliary", 1), ("auxiliary_files", 2, "auxiliary", 1), ("auxiliary_files", 24, "auxiliary", 1), ("auxiliary_files", 25, "auxiliary", 1), ("main", 0, "primary", 1)]
    assert rows(out.files.where("assay_type IS NOT NULL").select("id", "species", "bio_metadata"))[0] == (0, "en", '{"assay_type":"genome","species":"en","tags":[]}')
    assert out.files.where("assay_type IS NOT NULL").count() == 8


def test_repeated_runs_change_nothing(spark, tmp_path):
    first = run(spark, empty_catalogue(spark, files(spark, NAMES)), lambda: by_rule(), f"{tmp_path}/ledger")
    keep = inferring.Catalogue(*[t.checkpoint() for t in first.tables])

    def never():
        raise AssertionError("asked again")

    again = run(spark, keep, never, f"{tmp_path}/ledger")
    assert again.asked == 0 and again.changed == 0 and again.texts.count() == 0
    for a, b in zip(keep, again.tables):
        assert rows(a.drop("tags")) == rows(b.drop("tags"))


def test_new_files_ask_only_their_own_prompts(spark, tmp_path):
    first = run(spark, empty_catalogue(spark, files(spark, NAMES)), lambda: by_rule(), f"{tmp_path}/ledger")
    more = files(spark, [*NAMES, "/r/en/s3/0.bam"])
    keep = inferring.Catalogue(*[t.checkpoint() for t in first.tables])
    was = keep.files.select("id", "bio_metadata", "species", "assay_type", "updated_at")
    now = more.drop("bio_metadata", "species", "assay_type", "updated_at").join(was, "id", "left").select(more.columns)
    out = run(spark, keep._replace(files=now), lambda: by_rule(), f"{tmp_path}/ledger")
    assert out.asked == 1 and out.changed == 0
    links = out.tables.asset_file.join(out.tables.asset.select(F.col("id").alias("asset_id"), "dataset_id", "name"), "asset_id").where("dataset_id = 4")
    assert rows(links.select("file_id", "role", "name")) == [(9, "primary", "main"), (10, "auxiliary", "auxiliary_files"), (11, "auxiliary", "auxiliary_files"), (27, "primary", "main")]
    assert rows(out.tables.snapshot) == rows(keep.snapshot)


def test_failures_are_kept_and_asked_again(spark, tmp_path):
    ledger = inferring.Ledger(spark, f"{tmp_path}/ledger")
    prompts = spark.createDataFrame([("a", "good"), ("b", "bad"), ("a", "good")], "key string, prompt string")
    answer = json.dumps({"datasets": []})

    def half():
        def call(prompt):
            if prompt == "bad":
                raise RuntimeError("no")
            return answer

        return call

    assert ledger.ask(prompts, half) == 2
    assert rows(ledger.answers()) == [("a", answer)] and rows(ledger.failures()) == [("b", 1, "no")]
    assert ledger.ask(prompts, half) == 1 and rows(ledger.failures()) == [("b", 2, "no")]
    assert ledger.ask(prompts, lambda: lambda p: answer) == 1
    assert rows(ledger.answers()) == [("a", answer), ("b", answer)] and rows(ledger.failures()) == []
    assert ledger.ask(prompts, half) == 0


def test_nothing_to_infer(spark, tmp_path):
    none = empty_catalogue(spark, files(spark, NAMES).limit(0))
    out = run(spark, none, lambda: by_rule(), f"{tmp_path}/ledger")
    assert out.asked == 0 and out.changed == 0 and all(t.count() == 0 for t in out.tables)


def test_assets_merge_by_dataset_and_name(spark):
    old = spark.createDataFrame([(5, 1, "main", "raw", None), (6, 1, "x", "raw", 2)], TABLES["asset"])
    new = spark.createDataFrame([(1, "main", "clean"), (2, "main", "raw")], "dataset_id long, name string, asset_type string")
    assert rows(inferring.merge_assets(old, new).select("id", "dataset_id", "name", "asset_type")) == [(5, 1, "main", "clean"), (6, 1, "x", "raw"), (7, 2, "main", "raw")]
    assert datasets.AUXILIARY and inference.CHUNK
