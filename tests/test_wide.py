"""Filters, facets in one scan and trigrams, each against the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import text
from tarnwell.operators import containment, endpoints, relational, substring


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def tree(spark):
    rng = random.Random(2)
    dirs = ["/" + "/".join(rng.choice("abcdefg") + str(rng.randint(0, 20)) for _ in range(rng.randint(1, 6))) for _ in range(1500)]
    files = spark.createDataFrame([(i, f"{rng.choice(dirs)}/f{i}") for i in range(6000)] + [(6000, "plain"), (6001, "/top"), (6002, None)], "id long, path string")
    sets = spark.createDataFrame([(i, d) for i, d in enumerate(sorted(set(rng.sample(dirs, 400))))] + [(1000, "/top"), (1001, "/none")], "id long, path string")
    return files.cache(), sets.cache()


def test_the_filter_drops_ancestors_and_loses_nothing(spark, tree):
    files, sets = tree
    assert rows(containment.containment(files, sets, broadcast_rows=0)) == rows(containment.containment(files, sets))
    up = files.select(F.explode(containment.ancestors("path", itself=True)).alias("path"))
    keeps = containment.PathFilter(sets.select("path"), sets.count())
    total, kept = up.count(), up.where(keeps.holds(F.col("path"))).count()
    true = up.join(sets, "path", "left_semi").count()
    # Nearly all that is shuffled then is a match.
    assert true <= kept < true + 0.02 * total and kept < 0.3 * total
    assert containment.containment(files, sets.limit(0), broadcast_rows=-1).count() == 0


def test_the_filter_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(containment, "MOST_BITS", 1 << 12)
    many = spark.range(3000).selectExpr("id", "concat('/x/', id) AS path")
    assert containment.PathFilter(many.select("path"), 3000).bits == 1 << 12
    files = spark.range(5000).selectExpr("id", "concat('/x/', id, '/f') AS path")
    assert containment.containment(files, many, broadcast_rows=0).count() == 3000


def test_paths_are_measured_before_they_are_broadcast(spark, tree, monkeypatch):
    files, sets = tree
    monkeypatch.setattr(containment, "BROADCAST_BYTES", 100)
    plan = containment.containment(files, sets)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan


DATASET = "id long, name string, species string, dataset_type string, summary string"


def test_facets_in_one_scan(spark, tmp_path):
    data = [(1, "rice", "Oryza", "genome", "x"), (2, "Rice b", "oryza", None, None), (3, "soy", None, "unknown", "rice too"), (4, "rice", " ", "genome", ""), (5, "none", "Zea", "rna", "")]
    spark.createDataFrame(data, DATASET).coalesce(1).write.parquet(f"{tmp_path}/d")
    d = spark.read.parquet(f"{tmp_path}/d")
    got = relational.facet_counts(d, "RICE", None, "genome")
    assert rows(got.where("facet = 'species'").drop("facet")) == rows(relational.facets(d, "species"))
    assert rows(got.where("facet = 'dataset_type'").drop("facet")) == rows(relational.facets(d, "dataset_type"))
    assert rows(got.where("facet = 'query_type'").drop("facet")) == rows(relational.type_counts(d, "RICE", None)) == [("genome", 2), ("unknown", 2)]
    assert rows(got.where("facet = 'query_species'").drop("facet")) == [(" ", 1), ("Oryza", 1)]
    assert rows(relational.facet_counts(d, "rice", "ORYZA").where("facet = 'query_type'").drop("facet")) == [("genome", 1), ("unknown", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert [r.value for r in relational.facet_counts(d, most=1).where("facet = 'dataset_type'").collect()] == ["genome"]
    assert relational.facet_counts(d.limit(0)).count() == 0
    assert endpoints.facets({"dataset": d})["dataset_type"] == [("genome", 2), ("rna", 1), ("unknown", 1)]


def test_trigrams_equal_the_scan(spark, tmp_path):
    rng = random.Random(8)
    alphabet = "aAbB%_é\\ßİñ. /"
    data = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))), None if i % 5 == 0 else "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 9)))) for i in range(400)]
    data += [(400, "x" * 200_000 + "needle", "aaa"), (400, "other needle", None), (None, "needle", None)]
    frame = spark.createDataFrame(data, "id long, path string, note string").cache()
    index = substring.Trigrams(spark, str(tmp_path / "grams"))
    assert not index.built()
    index.build(frame, ["path", "note"])
    assert index.built()
    queries = ["a", "%_", "aA", "needle", "NEEDLE", "aaaa", "zzz", "_%é"]
    for n in (3, 4, 5, 7, 12, 20):
        for _ in range(3):
            t = rng.choice([d for d in data[:400] if len(d[1]) >= n])[1]
            at = rng.randint(0, len(t) - n)
            queries.append(t[at : at + n].swapcase() if rng.random() < 0.3 else t[at : at + n])
    for q in queries:
        here = text.holds("path", q) | text.holds("note", q)
        want = rows(frame.where(here & F.col("id").isNotNull()).select("id", "path"))
        assert rows(index.narrow(frame, q).where(here & F.col("id").isNotNull()).select("id", "path")) == want, q
    assert index.candidates("ab") is None and index.candidates("zzz").count() == 0
    assert index.candidates("needle").count() <= 2
