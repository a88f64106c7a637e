"""A watched tree into the catalogue and the index: flushes by number and time, restarts, buckets, and a crash between two sinks."""

import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import catalog, fulltext
from tarnwell.sources import datasource
from tarnwell.sources.buckets import Buckets
from tarnwell.sources.store import Unavailable
from tarnwell.streaming import watching

FILES = "id long, path string, size long, mtime long, source_server string, format string, deleted boolean, indexed_at long, updated_at long, bio_metadata string, species string, assay_type string"
DELTA = "path string, size long, mtime long, source_server string, format string"


def files(spark, *rows):
    return spark.createDataFrame([(i, p, n, 1, "s", None, gone, 9, 9, "{}", None, None) for i, p, n, gone in rows], FILES)


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def touched(folder):
    """Files of each bucket."""
    return {d: sorted(x for x in os.listdir(folder / d) if x.endswith(".parquet")) for d in os.listdir(folder) if d.startswith("bucket=")}


def test_a_small_batch_rewrites_only_its_buckets(spark, tmp_path):
    many = spark.range(20_000).selectExpr("id + 1 AS id", "concat('/d/', id % 50, '/f', id) AS path", "id AS size", "1L AS mtime", "'s' AS source_server", "CAST(NULL AS string) AS format", "id % 9 = 0 AS deleted", "9L AS indexed_at", "9L AS updated_at", "'{}' AS bio_metadata", "CAST(NULL AS string) AS species", "CAST(NULL AS string) AS assay_type")
    table = Buckets(spark, str(tmp_path / "t"))
    table.create(many, 1000)
    before = touched(tmp_path / "t" / "files")
    delta = spark.createDataFrame([(f"/d/{i % 50}/f{i}", -1, 7, "s", None) for i in range(0, 70, 10)] + [("/new/a", 5, 7, "s", "BAM"), ("/d/0/f0", -2, 6, "s", None)], DELTA)
    gone = paths(spark, "/d/1/f1", "/none")
    hit = table.change(delta, gone, 100, batch=4)
    after = touched(tmp_path / "t" / "files")
    changed = {d for d in after if after[d] != before.get(d)}
    assert len(before) == 1000 and 0 < len(changed) <= 10 and changed <= {f"bucket={b}" for b in hit}
    assert sum(len(set(after[d]) - set(before.get(d, []))) for d in after) == len(changed)
    want = catalog.soft_delete(catalog.upsert(many, delta, 100), gone, 100)
    columns = ["path", "size", "mtime", "format", "deleted", "indexed_at", "updated_at", "bio_metadata"]
    assert rows(table.read().select(columns)) == rows(want.select(columns))
    known = table.read().join(many.select("path", F.col("id").alias("was")), "path")
    assert known.where("id <> was").count() == 0 and table.read().select("id").distinct().count() == 20_001
    assert table.applied() == 4 and table.at(paths(spark, "/new/a", "/nothing")).select("id").first()[0] > 20_000


def test_ids_stay_apart_over_batches(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"))
    table.create(files(spark, (50, "/a", 1, False), (3, "/b", 1, True)), 3)
    for step in range(3):
        table.change(spark.createDataFrame([(f"/n{step}/{i}", i, step, "s", None) for i in range(12)] + [("/b", 9, step, "s", None)], DELTA), paths(spark, "/a"), step)
    got = {r.path: r for r in table.read().collect()}
    assert len(got) == 38 and len({r.id for r in got.values()}) == 38
    assert (got["/a"].id, got["/a"].deleted) == (50, True) and (got["/b"].id, got["/b"].deleted, got["/b"].size) == (3, False, 9)
    assert min(r.id for p, r in got.items() if p.startswith("/n")) > 50
    # The same batch once more changes nothing.
    before = rows(table.read())
    table.change(spark.createDataFrame([(f"/n2/{i}", i, 2, "s", None) for i in range(12)], DELTA), paths(spark), 2)
    assert rows(table.read()) == before


def test_purge_and_empty_tables(spark, tmp_path):
    table = Buckets(spark, str(tmp_path / "t"))
    with pytest.raises(Unavailable):
        table.change(spark.createDataFrame([], DELTA), paths(spark), 1)
    table.create(files(spark, *[(i, f"/f{i}", 1, i < 3) for i in range(6)]), 50)
    assert len(table.purge(86400 * 40, 30)) <= 3 and sorted(r.id for r in table.read().collect()) == [3, 4, 5] and table.purge(86400 * 40, 30) == []
    none = Buckets(spark, str(tmp_path / "none"))
    none.create(files(spark), 4)
    assert none.read().count() == 0 and none.change(spark.createDataFrame([], DELTA), paths(spark, "/x"), 1, batch=0) != [] and none.read().count() == 0
    none.change(spark.createDataFrame([("/a", 1, 1, "s", None), ("/b", 1, 1, "s", None)], DELTA), paths(spark), 1)
    assert none.read().count() == 2 and none.applied() == 0


def write(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def window(top, start, end):
    r = datasource.WatchReader({"path": str(top)})
    return sorted((x["path"], x["kind"]) for part in r.partitions({"until": start}, {"until": end}) for b in r.read(part) for x in b.to_pylist())


def test_windows_are_disjoint_and_whole(tmp_path):
    t0 = time.time() - 1
    write(tmp_path / "a" / "1")
    time.sleep(0.2)
    t1 = time.time()
    time.sleep(0.2)
    write(tmp_path / "a" / "2")
    (tmp_path / "a" / "b").mkdir()
    os.remove(tmp_path / "a" / "1")
    t2 = time.time() + 0.1
    a, top = str(tmp_path / "a"), str(tmp_path)
    assert window(tmp_path, t0, t1) == [(top, "dir")]
    assert window(tmp_path, t1, t2) == [(a, "dir"), (f"{a}/2", "file"), (f"{a}/b", "dir")]
    assert window(tmp_path, t2, t2 + 5) == [] and window(tmp_path, t2, t2) == []


@pytest.fixture
def timers(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watching.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run(spark, changes, checkpoint, act, done, most=90):
    """Let a stream run while ``act`` does something, until ``done`` of what it gave."""
    got = []
    q = changes.writeStream.foreachBatch(lambda b, n: got.extend((n, time.time(), r) for r in b.collect())).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()
    try:
        end = time.time() + most
        while not q.recentProgress and time.time() < end:
            time.sleep(0.2)
        act()
        while not done(got) and time.time() < end:
            assert q.exception() is None
            time.sleep(0.2)
        time.sleep(1)
    finally:
        q.stop()
    return got


def test_flush_by_number_and_by_time_and_after_a_restart(spark, tmp_path, timers):
    (tmp_path / "w").mkdir()
    stream = lambda: watching.gathered(watching.watch(spark, str(tmp_path / "w"), exclude='["*.no"]').where("kind = 'file'"), at_most=10, seconds=4)
    began = []

    def act():
        began.append(time.time())
        for i in range(13):
            write(tmp_path / "w" / "d" / f"f{i}")
            write(tmp_path / "w" / "d" / f"f{i}.no")

    got = run(spark, stream(), str(tmp_path / "cp"), act, lambda g: len(g) >= 13)
    by = {cause: [(t, r) for _, t, r in got if r.cause == cause] for cause in ("number", "time")}
    assert len(by["number"]) == 10 and len(by["time"]) == 3
    assert min(t for t, _ in by["time"]) - began[0] >= 4 and {r.flush for _, r in by["number"]} == {0} and {r.flush for _, r in by["time"]} == {1}
    assert len({r.path for _, _, r in got}) == 13

    def again():
        began.append(time.time())
        write(tmp_path / "w" / "d" / "f3", "again")
        write(tmp_path / "w" / "late")

    # What was flushed before comes once more only where it changed.
    got = run(spark, stream(), str(tmp_path / "cp"), again, lambda g: len(g) >= 2)
    assert sorted(os.path.basename(r.path) for _, _, r in got) == ["f3", "late"] and {r.flush for _, _, r in got} == {2}


def test_watched_tree_into_catalogue_and_index(spark, tmp_path):
    top = tmp_path / "w"
    for name in ("a/keep.bam", "a/drop.bam", "old/x.vcf", "old/sub/y.vcf"):
        write(top / name)
    table, index = Buckets(spark, str(tmp_path / "t")), fulltext.TextIndex(spark, str(tmp_path / "index"))
    table.create(files(spark, *[(i + 1, str(top / n), 1, False) for i, n in enumerate(("a/keep.bam", "a/drop.bam", "old/x.vcf", "old/sub/y.vcf"))]), 8)
    go = lambda: watching.watch_into(watching.watch(spark, str(top), since=str(began)), table, index, str(tmp_path / "cp"), seconds=None, clock=lambda: 77).awaitTermination(120)
    time.sleep(0.3)
    began = time.time()
    write(top / "new" / "rice.vcf")
    os.remove(top / "a" / "drop.bam")
    shutil.rmtree(top / "old")
    time.sleep(0.3)
    go()
    got = {os.path.relpath(r.path, top): (r.id, r.deleted, r.format) for r in table.read().collect()}
    assert got.pop("new/rice.vcf")[1:] == (False, "VCF")
    assert got == {"a/keep.bam": (1, False, None), "a/drop.bam": (2, True, None), "old/x.vcf": (3, True, None), "old/sub/y.vcf": (4, True, None)}
    assert [r.doc_id for r in index.search("rice").collect()] == [r.id for r in table.at(paths(spark, str(top / "new" / "rice.vcf"))).collect()]
    before = rows(table.read())
    go()
    assert rows(table.read()) == before and index.num_docs() == 1


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("where", ["put", "commit"])
def test_a_crash_between_the_sinks_heals(spark, tmp_path, monkeypatch, where):
    src, real = tmp_path / "in", tmp_path / "data"
    src.mkdir()
    write(real / "one.bam")
    write(real / "two.vcf")
    (src / "1.json").write_text("\n".join(f'{{"path":"{real / n}"}}' for n in ("one.bam", "two.vcf", "never")))
    table, index = Buckets(spark, str(tmp_path / "t")), fulltext.TextIndex(spark, str(tmp_path / "index"))
    table.create(files(spark, (9, str(real / "never"), 1, False)), 4)
    stream = lambda: spark.readStream.schema("path string").json(str(src))
    start = lambda: watching.watch_into(stream(), table, index, str(tmp_path / "cp"), seconds=None, clock=lambda: 50)
    with monkeypatch.context() as m:
        m.setattr(fulltext.TextIndex, where, lambda *a, **b: (_ for _ in ()).throw(Broken()))
        with pytest.raises(Exception, match="Broken"):
            start().awaitTermination(120)
    assert table.applied() == 0 and index.applied() == -1 and not index.built()
    catalogue = rows(table.read())
    index = fulltext.TextIndex(spark, str(tmp_path / "index"))
    start().awaitTermination(120)
    assert rows(table.read()) == catalogue and index.applied() == 0
    ids = {os.path.basename(r.path): r.id for r in table.read().where("NOT deleted").collect()}
    assert {r.doc_id for r in index.search("one two").collect()} == set(ids.values()) and set(ids) == {"one.bam", "two.vcf"}
    # Given again, the batch changes nothing in either.
    watching.put_paths(paths(spark, str(real / "one.bam")), table, index, 0, 60)
    assert rows(table.read()) == catalogue and len(index._segments()) == 1


def test_removed_names(spark):
    some = files(spark, (1, "/d/a/x", 1, False), (2, "/d/a/y", 1, False), (3, "/d/b/z/q", 1, False), (4, "/e/x", 1, False), (5, "/d/a/w", 1, True))
    dirs = spark.createDataFrame([("/d/a", ["x"]), ("/d", ["a"]), ("/none", [])], "path string, names array<string>")
    assert rows(watching.removed(some, dirs)) == [("/d/a/y",), ("/d/b/z/q",)]
