"""Listings by ``spark.read.format``: what is read, what is taken over from the query, and what is then never looked at."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tarnwell.sources import datasource, listing


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    datasource.register(spark)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for k in range(4):
        for n in range(5):
            for name in (f"s{k}/f{n}.txt", f"s{k}/deep/er/g{n}.bam", f"s{k}/.hidden/h{n}"):
                path = top / name
                path.parent.mkdir(parents=True, exist_ok=True)
                path.write_bytes(b"BAM\x01" * (n + 1))
                os.utime(path, (1000 * k + n, 1000 * k + n))
    os.symlink(top / "s0", top / "link")
    return str(top)


def rows(df):
    return sorted((r.path, r.source_server, r.size, r.mtime_secs, bytes(r.magic_bytes), r.mime_type) for r in df.collect())


def load(spark, path, **options):
    return spark.read.format("file_tree").options(path=path, **options).load()


def test_tree_equals_the_scan(spark, tree):
    assert rows(load(spark, tree)) == rows(listing.scan_tree(spark, [tree])) and load(spark, tree).count() == 60
    options = {"exclude": json.dumps([".*", "*.txt"]), "precise": "true", "server": "box", "skip_magic": json.dumps([f"{tree}/s1/deep/er"])}
    want = listing.scan_tree(spark, [tree], [".*", "*.txt"], server="box", precise=True, skip_magic=[f"{tree}/s1/deep/er"])
    assert rows(load(spark, tree, **options)) == rows(want)
    both = load(spark, json.dumps([f"{tree}/s0", f"{tree}/s2/deep", "/none/such"]))
    assert rows(both) == rows(listing.scan_tree(spark, [f"{tree}/s0", f"{tree}/s2/deep"]))


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


def test_conditions_are_taken_over(spark, tree, capsys):
    all_ = rows(load(spark, tree))
    q = load(spark, tree).where(F.col("path").endswith(".bam") & (F.col("mtime_secs") > 2001) & (F.col("size") <= 16) & F.col("path").startswith(f"{tree}/s"))
    assert rows(q) == [r for r in all_ if r[0].endswith(".bam") and r[3] > 2001 and r[2] <= 16]
    told = plan(q, capsys)
    for part in ("StringEndsWith(path,.bam)", "GreaterThan(mtime_secs,2001)", "LessThanOrEqual(size,16)", "StringStartsWith(path,"):
        assert part in told
    odd = load(spark, tree).where((F.length("path") % 2 == 0) & (F.col("mime_type") == "text/plain") & F.col("path").isin(all_[0][0], all_[5][0], all_[6][0]))
    assert rows(odd) == [r for r in (all_[0], all_[5], all_[6]) if len(r[0]) % 2 == 0 and r[5] == "text/plain"]


def reader(tree, *filters, **options):
    r = datasource.TreeReader({"path": tree, **options})
    assert list(r.pushFilters(list(filters))) == []
    return r


def read(r):
    return sorted(p for part in r.partitions() for b in r.read(part) for p in b.column(0).to_pylist())


def test_names_come_before_files_and_directories_are_not_entered(tree, monkeypatch):
    looked, entered = [], []
    describe, entries = listing.describe, listing._entries
    monkeypatch.setattr(listing, "describe", lambda path, *a: looked.append(path) or describe(path, *a))
    monkeypatch.setattr(listing, "_entries", lambda folder, *a: entered.append(folder) or entries(folder, *a))
    got = read(reader(tree, datasource.StringEndsWith(("path",), ".bam"), datasource.StringStartsWith(("path",), f"{tree}/s1/de")))
    assert len(got) == 5 and sorted(looked) == got
    assert set(entered) == {tree, f"{tree}/s1", f"{tree}/s1/deep", f"{tree}/s1/deep/er"}
    opened = []
    monkeypatch.setattr(listing, "leading", lambda path: opened.append(path) or b"")
    got = read(reader(tree, datasource.GreaterThan(("mtime_secs",), 3002), precise="true"))
    assert len(got) == 6 and sorted(opened) == got
    assert read(reader(tree, datasource.EqualTo(("path",), f"{tree}/s2/f3.txt"))) == [f"{tree}/s2/f3.txt"]


def test_a_tree_is_dealt_to_tasks(tree, monkeypatch):
    monkeypatch.setattr(listing, "LEAST_TASKS", 3)
    r = reader(tree)
    parts = r.partitions()
    assert len(parts) == 5 and parts[0].tops == [(tree, False)] and len(read(r)) == 60


TSV = "/a\t3\t5.9\nbroken\n/b\t4\t-1.5\r\n/c\tx\t1\n\n/dé\t5\t7\n/e\t1\t2\t3\n/nan\t1\tnan\n/last\t9\t1e3"
JSONL = "\n".join(['{"path":"/a","size":3,"mtime_secs":5}', "no json", "[]", '{"size":4}', '{"path":"/é","mtime_secs":9}', "", '{"path":null}', '{"path":"/x","size":"q"}'])


@pytest.mark.parametrize("split", [1, 7, 1 << 20])
def test_listings_are_split_by_bytes(spark, tmp_path, split, capsys):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "1.tsv").write_text(TSV, newline="")
    (tmp_path / "l" / "2.tsv").write_text("/second\t1\t1\n")
    (tmp_path / "l" / "_skip").write_text("/never\t1\t1\n")
    (tmp_path / "j.jsonl").write_text(JSONL)
    tsv = spark.read.format("file_listing_tsv").options(path=str(tmp_path / "l"), split_bytes=split).load()
    assert sorted(map(tuple, tsv.collect())) == [("/a", 3, 5), ("/b", 4, -1), ("/dé", 5, 7), ("/last", 9, 1000), ("/second", 1, 1)]
    json_ = spark.read.format("file_listing_jsonl").options(path=f"file://{tmp_path}/j.jsonl", split_bytes=split).load()
    assert sorted(map(tuple, json_.collect())) == [("", 0, 0), ("", 4, 0), ("/a", 3, 5), ("/é", 0, 9)]
    newer = json_.where("mtime_secs > 5")
    assert [r.path for r in newer.collect()] == ["/é"] and "GreaterThan(mtime_secs,5)" in plan(newer, capsys)


def test_lines_meet_at_any_cut(tmp_path):
    text = b"a\n\nbb\nccc\r\n\xc3\xa9\n\nend"
    (tmp_path / "t").write_bytes(text)
    want = text.split(b"\n")
    for cut in range(1, len(text)):
        for block in (1, 3, 100):
            got = [*datasource.lines(str(tmp_path / "t"), 0, cut, block), *datasource.lines(str(tmp_path / "t"), cut, len(text), block)]
            assert got == want, (cut, block)


def test_missing_and_empty(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        spark.read.format("file_listing_tsv").option("path", f"{tmp_path}/none").load().count()
    (tmp_path / "empty.tsv").write_text("")
    assert spark.read.format("file_listing_tsv").option("path", f"{tmp_path}/empty.tsv").load().count() == 0
    assert load(spark, f"{tmp_path}/none").count() == 0
