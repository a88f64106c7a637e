"""What goes wrong only over larger tables, in small: sampled ranges, rows made anew in another order, uneven groups, builds."""

import datetime

import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnwell.operators import catalog, fulltext, inference, relational, substring
from tarnwell.plans import catalogue, enrichment, queries, writing  # noqa: F401 - registers queries
from tarnwell.plans.registry import QUERIES, SQL


@pytest.fixture
def setting(spark):
    """Settings for one test."""
    old = {}

    def put(key, value):
        old.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_numbers_where_ranges_are_sampled(spark, setting):
    setting("spark.sql.execution.rangeExchange.sampleSizePerPartition", 1)
    setting("spark.sql.adaptive.coalescePartitions.enabled", "false")
    n = 60_000
    rows = spark.range(0, n, 1, 8).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("a name of some length "), F.col("id").cast("string")).alias("name"))
    got = catalog.number(rows, ["k"], "n")
    assert sorted(got.columns) == ["k", "n", "name"]
    assert got.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_if(F.col("n") != F.col("k") + 1), F.min(F.length("name"))).first()[:] == (n, 1, n, 0, 23)


def test_changes_of_a_name_that_repeats(spark, monkeypatch):
    """The pairs of one name, even of equal rows, are many tasks'; which there are is what a plain join says."""
    monkeypatch.setattr(catalog, "PAIRS", 2000, raising=False)
    monkeypatch.setattr(catalog, "EQUAL", 16, raising=False)
    kind = "name string, dataset_type string, species string"
    old = [("a", "x", "s")] * 400 + [("a", None, "t"), ("b", "x", "s"), ("c", "x", None), (None, "x", "s")] + [(f"n{i % 5}", f"t{i % 7}", f"s{i % 3}") for i in range(100)]
    new = [("a", "y", "s")] * 400 + [("a", None, "t"), ("b", "x", "s"), ("c", "y", None), (None, "y", "s")] + [(f"n{i % 5}", f"t{i % 11}", f"s{i % 2}") for i in range(90)]
    got = catalog.snapshot_modified(spark.createDataFrame(old, kind), spark.createDataFrame(new, kind))
    differ = lambda a, b: a is not None and b is not None and a != b
    want = [(n, t, s, u, v) for n, t, s in new for m, u, v in old if n is not None and n == m and (differ(t, u) or differ(s, v))]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    per_task = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) < 0.2 * len(want)


def test_changes_come_in_small_runs(spark, setting):
    """What reads one pair has few made: not all pairs of a row that its name's old rows repeat, which one task would hold at once."""
    setting("spark.sql.adaptive.enabled", "false")
    kind = "name string, dataset_type string, species string"
    old = spark.range(5000).select(F.lit("a").alias("name"), F.concat(F.lit("t"), (F.col("id") % 10).cast("string")).alias("dataset_type"), F.lit("s").alias("species"))
    cut = catalog.snapshot_modified(old, spark.createDataFrame([("a", "y", "s")] * 64, kind)).limit(1)
    assert len(cut.collect()) == 1
    made, plans = [], [cut._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
        if plan.nodeName() == "Generate":
            made.append(plan.metrics().apply("numOutputRows").value())
    assert made and 0 < max(made) <= catalog.EQUAL**2


def test_answers_made_anew_in_another_order(spark):
    """An answer is read several times; each time it may list its datasets and files otherwise, as a grouping over several machines does."""
    names = [f"n{i}" for i in range(40)]
    ends = [f"/f{j}" for j in range(6)]

    def answer(_):
        import json
        import random

        rng = random.SystemRandom()
        each = [{"name": n, "type": "genome", "assets": [{"name": "g", "files": [{"path": n + e, "role": e} for e in rng.sample(ends, len(ends))]}]} for n in names]
        return json.dumps({"datasets": rng.sample(each, len(each))})

    responses = spark.range(3).select(F.col("id").alias("batch"), F.udf(answer, "string").asNondeterministic()("id").alias("response"))
    members = spark.createDataFrame([(b, i, n, f"/d{b}/{n}") for b in range(3) for i, n in enumerate(names)], "batch long, pos int, name string, path string")
    files = [(f"/d{b}/{n}", 1000 * b + 10 * i + j, f"/d{b}/{n}{e}") for b in range(3) for i, n in enumerate(names) for j, e in enumerate(ends)]
    datasets, links, _ = inference.parse_datasets(responses, members, spark.createDataFrame(files, "path string, file_id long, file_path string"))
    assert sorted(map(tuple, links.select("path", "file_id", "role").collect())) == sorted((p, i, f"/{f.rsplit('/', 1)[1]}") for p, i, f in files)
    assert sorted(map(tuple, datasets.select("path", "name").collect())) == sorted((f"/d{b}/{n}", n) for b in range(3) for n in names)


def test_sizes_of_half_a_tenth(spark, tmp_path):
    prices = [262144.5, 786432.0, 1310720.0, 1835008.9, 2 * 262144.0, 52428.0, 52429.0, 0.0, -262144.0, -1.5, -262145.0]
    rows = [(i, i, "O", float(p), datetime.datetime(1995, 1, 1), "1-URGENT") for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    duck = oracle.connection(str(tmp_path))
    for t in ("part", "lineitem", "documents", "supplier", "nation"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    assert oracle.spark_rows(QUERIES["list_lines"](spark, str(tmp_path))) == oracle.sql_rows(duck, SQL["list_lines"])


def test_an_index_reads_each_text_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return f"apache thing {i} " * (i % 3 + 1)

    docs = spark.range(3000).select("id", F.udf(read, "string").asNondeterministic()("id").alias("metadata"), F.lit("/a").alias("path"), F.array(F.lit("t")).alias("tags"))
    index = fulltext.TextIndex(spark, str(tmp_path / "index"))
    assert index.rebuild(docs) == 3000 and seen.value == 3000
    assert sorted((s.field, s.docs, s.total) for s in index._manifest().stats) == [("metadata", 3000, 18000), ("path", 3000, 3000), ("tags", 3000, 3000)]


def test_blocks_packed_in_pieces(monkeypatch):
    """However many documents are packed at a time, and however batches fall, the postings are the same; so are a null id's, and none of empty texts."""
    docs = [(i // 8, i, [f"w{i % 5}", "all", "é", f"w{i % 5}"][: i % 5], None if i % 4 == 0 else ["p", f"w{i}"], []) for i in range(50)] + [(None, None, ["all"], ["p"], ["t"])]
    kind = pa.schema([("block", pa.int64()), ("id", pa.int64()), *[(f, pa.list_(pa.string())) for f in fulltext.FIELDS]])
    found = []
    for most, step in ((1 << 21, 100), (1 << 21, 7), (9, 7), (1, 50)):
        monkeypatch.setattr(fulltext, "TOKENS", most)
        batches = [pa.RecordBatch.from_pylist([dict(zip(kind.names, d)) for d in docs[lo : lo + step]], kind) for lo in range(0, len(docs), step)]
        out = [r for b in fulltext._pack(iter(batches)) for r in b.to_pylist()]
        assert all(r["n"] == len(r["docs"]) and r["most"] == max(d["tf"] for d in r["docs"]) and r["least"] == min(d["length"] for d in r["docs"]) for r in out)
        found.append(sorted(str((r["term"], r["field"], r["block"], d)) for r in out for d in r["docs"]))
        if most > 100:
            assert len({(r["term"], r["field"], r["block"]) for r in out}) == len(out)
    want = sorted(
        str((t, f, d[0], {"doc_id": d[1], "tf": w.count(t), "length": len(w), "positions": [k for k, x in enumerate(w) if x == t]}))
        for d in docs for f, w in zip(fulltext.FIELDS, d[2:]) for t in set(w or ())
    )
    assert found == [want] * 4


def test_trigrams_are_packed_and_texts_read_once(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def read(i):
        seen.add(1)
        return f"/srv/{i % 7}/F{i}.dat"

    rows = spark.range(0, 5000, 1, 2).select("id", F.udf(read, "string").asNondeterministic()("id").alias("path"), F.lit("{}x").alias("note"))
    index = substring.Trigrams(spark, str(tmp_path / "grams"))
    index.build(rows, ["path", "note"])
    assert seen.value == 5000
    stored = spark.read.parquet(f"{tmp_path}/grams/postings")
    assert stored.count() < 5000 and stored.select(F.sum(F.size("ids"))).first()[0] == sum(len({p[k : k + 3] for k in range(len(p) - 2)}) + 1 for p in (f"/srv/{i % 7}/F{i}.dat" for i in range(5000)))
    assert sorted({r.id for r in index.candidates("/f49").collect()}) == [i for i in range(5000) if str(i).startswith("49")]
    # Several lots a batch.
    monkeypatch.setattr(substring, "LOT", 30)
    batch = pa.RecordBatch.from_pylist([{"id": i, "path": t} for i, t in enumerate(["abcabc", None, "", "xabcx" * 10, "bca", "ab"])])
    out = [r for b in substring._postings(iter([batch])) for r in b.to_pylist()]
    assert {g: sorted(i for r in out if r["gram"] == g for i in r["ids"]) for g in ("abc", "bca", "xxa")} == {"abc": [0, 3], "bca": [0, 4], "xxa": [3]}
    assert len({r["lot"] for r in out}) == 3 and len({(r["lot"], r["gram"]) for r in out}) == len(out)


def test_lines_are_dealt_before_they_are_grouped(spark, monkeypatch):
    """Assets and links are nearly as many as lines, so tasks get a bounded share of lines each, and none groups a file that it reads."""
    monkeypatch.setattr(catalogue, "PART", 20_000, raising=False)
    c = catalogue.Catalogue(spark, "/root/testdata/sf0.01")
    for rows in (c.assets, c.links):
        per_task = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) > 50_000 and max(per_task) < 0.05 * sum(per_task)
    duck = oracle.connection(c.dir)
    assert oracle.spark_rows(QUERIES["dataset_list"](spark, c.dir)) == oracle.sql_rows(duck, SQL["dataset_list"])


@pytest.mark.parametrize("parts", [None, 7])
def test_counts_of_repeats_and_nulls(spark, parts):
    assets = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 11), (4, None), (None, 12), (100, 10)], "id long, dataset_id long")
    links = spark.createDataFrame([(1, 100), (1, 100), (2, 100), (2, 101), (9, 5), (3, None), (None, 7)], "asset_id long, file_id long")
    got = relational.dataset_counts(assets, links, parts)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(["(10, 3, 2)", "(11, 1, 0)", "(None, 1, 0)", "(12, 0, 0)"])
