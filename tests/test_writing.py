"""The write path: stored index, scans, streams into a store, endpoints, projects and metadata."""

import json

import pytest
from pyspark.sql import functions as F

from tarnwell.operators import datasets, endpoints, fulltext, ingest, projects
from tarnwell.operators.relational import BadRequest, NotFound, Page
from tarnwell.sources import listing
from tarnwell.sources.store import Store, Unavailable
from tarnwell.streaming import changes

FILES = "id long, path string, size long, mtime long, source_server string, format string, deleted boolean, indexed_at long, updated_at long, bio_metadata string, species string, assay_type string"


def documents(spark, *rows):
    return spark.createDataFrame(rows, "id long, metadata string, path string, tags array<string>")


def found(index, query, k=50):
    return [r.doc_id for r in index.search(query, k).orderBy(F.desc("score"), "doc_id").collect()]


def test_index_replaces_deletes_and_rebuilds(spark, tmp_path):
    index = fulltext.TextIndex(spark, str(tmp_path / "index"))
    assert found(index, "rice") == [] and index.num_docs() == 0
    index.put(documents(spark, (1, "rice genome", "/data/a.fa", ["plant"]), (2, "soy", "/data/rice/b.fq", []), (3, None, None, None)))
    assert index.num_docs() == 0
    index.commit()
    assert sorted(found(index, "rice")) == [1, 2] and index.num_docs() == 3
    index.put(documents(spark, (1, "maize genome", "/data/a.fa", ["plant"])))
    index.delete(spark.createDataFrame([(3,), (77,)], "id long"))
    index.commit()
    assert found(index, "rice") == [2] and found(index, "maize") == [1] and index.num_docs() == 2
    index.put(documents(spark, (3, "rice again", "/x", [])))
    index.commit()
    assert sorted(found(index, "rice")) == [2, 3] and index.num_docs() == 3
    whole = documents(spark, (1, "maize", "/a", []), (9, "rice", "/b", []))
    with pytest.raises(Unavailable):
        index.rebuild(whole, expect=5)
    assert index.num_docs() == 3
    assert index.rebuild(whole, expect=2) == 2 and found(index, "rice") == [9]
    with pytest.raises(Unavailable):
        fulltext.TextIndex(spark, str(tmp_path / "index"), read_only=True).put(whole)


def test_index_query_grammar(spark, tmp_path):
    index = fulltext.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(documents(spark, (1, "red apple pie", "/home/x", ["food"]), (2, "apple red", "/food/y", []), (3, "green pear", "/z", ["apple"]), (4, "", "", [])))
    assert found(index, '"red apple"') == [1] and sorted(found(index, "apple -pie")) == [2, 3] and sorted(found(index, "apple")) == [1, 2, 3]
    assert found(index, "tags:apple") == [3] and sorted(found(index, "food")) == [1, 2] and found(index, "path:food") == [2]
    assert found(index, "red AND pie") == [1] and found(index, "+apple +green") == [3] and found(index, "apple", 1) and len(found(index, "apple", 1)) == 1
    assert found(index, '"broken') == [] and found(index, "") == [] and found(index, "-apple") == [] and found(index, "absent") == []


def test_scan_prunes_and_reads_leading_bytes(spark, tmp_path, monkeypatch):
    for name, data in {"a.txt": b"x", "b.tmp": b"y", ".hidden/c.txt": b"z", "deep/er/d.fq": b"@read1\nAC", "deep/raw/e.bam": b"BAM\x01" + b"0" * 600, "skip/f.bam": b"BAM\x01"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    (tmp_path / "link").symlink_to(tmp_path / "deep")
    for least in (1, 64):
        monkeypatch.setattr(listing, "LEAST_TASKS", least)
        rows = listing.scan_tree(spark, [str(tmp_path)], [".*", "*.tmp"], precise=True, skip_magic=[str(tmp_path / "skip")])
        got = {r.path.removeprefix(f"{tmp_path}/"): r for r in rows.collect()}
        assert set(got) == {"a.txt", "deep/er/d.fq", "deep/raw/e.bam", "skip/f.bam"}
        assert len(got["deep/raw/e.bam"].magic_bytes) == 512 and got["deep/raw/e.bam"].size == 604 and not got["skip/f.bam"].magic_bytes
        assert got["a.txt"].mime_type == "text/plain" and got["skip/f.bam"].mime_type == "application/octet-stream"
        kinds = {r.path.rsplit("/", 1)[1]: r.format for r in ingest.with_formats(rows).collect()}
        assert kinds == {"a.txt": "text", "d.fq": "FASTQ", "e.bam": "BAM", "f.bam": "BAM"}
    assert listing.scan_single(spark, str(tmp_path / "a.txt")).count() == 1 and listing.scan_single(spark, str(tmp_path)).count() == 0
    assert listing.scan_tree(spark, [str(tmp_path)], [str(tmp_path)]).count() == 0


@pytest.mark.parametrize(("text", "data"), [("aGVs\nbG8=", b"hello"), ("aGVsbG8", b"hello"), ("aGk=xx!", b"hi"), ("a!b", b""), ("", b"")])
def test_base64(spark, text, data):
    assert bytes(spark.createDataFrame([(text,)], "t string").select(listing.decode_base64("t")).first()[0]) == data


def test_scan_to_catalogue(spark, tmp_path):
    base = tmp_path / "projects" / "lung_cancer"
    base.mkdir(parents=True)
    (base / "s_R1.fastq").write_bytes(b"@read1")
    (base / "g.gtf").write_bytes(b"chr1")
    files = spark.createDataFrame([(5, str(base / "g.gtf"), 1, 1, "local", "GFF", True, 9, 9, '{"species":"rice"}', "rice", None)], FILES)
    tags = spark.createDataFrame([(5, "old"), (8, "stays")], "file_id long, tag string")
    raw = listing.scan_tree(spark, [str(tmp_path)], precise=True)
    out = ingest.run(files, tags, raw, 100)
    got = {r.path.rsplit("/", 1)[1]: r for r in out["files"].collect()}
    assert (got["g.gtf"].id, got["g.gtf"].deleted, got["g.gtf"].assay_type, got["g.gtf"].species) == (5, False, "annotation", None)
    assert json.loads(got["s_R1.fastq"].bio_metadata) == {"project": "lung_cancer", "tags": ["paired-end"]} or json.loads(got["s_R1.fastq"].bio_metadata)["tags"] == ["paired-end"]
    assert sorted(map(tuple, out["tags"].collect())) == [(5, "reference"), (6, "paired-end"), (8, "stays")]
    assert {r.file_id for r in out["embeddings"].collect()} == {5, 6}
    assert set(ingest.run(files, tags, raw, 100, scan_only=True)) == {"files"}


def test_stream_into_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"files": spark.createDataFrame([(1, "/a", 1, 1, "s", "BAM", False, 9, 9, None, None, None), (2, "/b", 1, 1, "s", None, False, 9, 9, None, None, None)], FILES), "asset": spark.range(3)})
    src = tmp_path / "in"
    src.mkdir()
    write = lambda name, rows: (src / name).write_text("\n".join(json.dumps({"event": e, "path": p, "size": n, "mtime_secs": t}) for e, p, n, t in rows))
    write("1.json", [("mod", "/a", 7, 2), ("add", "/c.vcf", 3, 2), ("del", "/b", 0, 3), ("rename", "/d", 1, 1)])
    go = lambda: changes.store_changes(changes.read_changes(spark, str(src)), store, str(tmp_path / "cp"), seconds=None, clock=lambda: 50).awaitTermination(120)
    go()
    got = {r.path: (r.id, r.size, r.deleted, r.format) for r in store.read("files").collect()}
    assert got == {"/a": (1, 7, False, "unknown"), "/b": (2, 1, True, None), "/c.vcf": (3, 3, False, "VCF")}
    version = store.version()
    write("2.json", [("add", "/b", 4, 9)])
    go()
    assert store.version() == version + 1 and not store.read("files").where("path = '/b'").first().deleted and store.read("asset").count() == 3
    # Tables that a version does not change are not written again.
    assert not (tmp_path / "store" / f"v{version + 1}" / "asset").exists()
    assert changes.purge_daily(store, 86400 * 40, 30, None) == 40 and store.version() == version + 2
    assert changes.purge_daily(store, 86400 * 40 + 5, 30, 40) == 40 and store.version() == version + 2


def test_stream_looks_at_paths(spark, tmp_path):
    real = tmp_path / "x.bam"
    real.write_bytes(b"BAM\x01")
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"files": spark.createDataFrame([(1, "/gone", 1, 1, "s", None, False, 9, 9, None, None, None)], FILES)})
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"event": e, "path": p}) for e, p in [("del", str(real)), ("mod", "/gone")]))
    changes.store_changes(changes.read_changes(spark, str(src)), store, str(tmp_path / "cp"), seconds=None, look=True).awaitTermination(120)
    got = {r.path: (r.deleted, r.format, r.size) for r in store.read("files").collect()}
    assert got == {"/gone": (True, None, 1), str(real): (False, "BAM", 4)}


def test_count_triggers_keep_state(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    seen = []
    rows = spark.readStream.schema("server string, path string").json(str(src))
    for name, n in (("1.json", 12), ("2.json", 9)):
        (src / name).write_text("\n".join(json.dumps({"server": "s", "path": f"/{name}/{i}"}) for i in range(n)))
        q = changes.count_stream(rows, "server").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        q.foreachBatch(lambda df, _: seen.extend((r.n, r.fires) for r in df.collect())).start().awaitTermination(120)
    assert seen == [(12, 1), (21, 1)]


def test_daily_window():
    day = 86400
    assert changes.due(5 * day + 3 * 3600 + 60, (3, 0), None) and not changes.due(5 * day + 3 * 3600 + 600, (3, 0), None)
    assert not changes.due(5 * day + 3 * 3600, (3, 0), 5) and changes.due(6 * day + 3 * 3600, (3, 0), 5) and not changes.due(4 * 3600, (3, 0), None)


def tables(spark):
    d = spark.createDataFrame([(1, "rice", "/p1", "genome", "Oryza", "s", 1), (2, "rice", "/p2", "rna", "Oryza", None, 1), (3, "soy", "/p3", None, None, None, 1)], "id long, name string, path string, dataset_type string, species string, summary string, updated_at long")
    a = spark.createDataFrame([(10, 1, "a", "x"), (11, 1, "b", "x")], "id long, dataset_id long, name string, asset_type string")
    li = spark.createDataFrame([(10, 100, "p"), (10, 101, "p"), (11, 102, "p")], "asset_id long, file_id long, role string")
    f = spark.createDataFrame([(100, "/d/a.fa", 5, False), (101, "/d/b.fa", -1, False), (102, "/d/c.fa", 1, True)], "id long, path string, size long, deleted boolean")
    return {"dataset": d, "asset": a, "asset_file": li, "files": f}


def test_endpoints(spark):
    t = tables(spark)
    own, assets = endpoints.dataset(t, 1)
    assert own.name == "rice" and [(r.id, r.file_count) for r in assets] == [(10, 2), (11, 1)]
    for bad, error in ((0, BadRequest), (9, NotFound)):
        with pytest.raises(error):
            endpoints.dataset(t, bad)
        with pytest.raises(error):
            endpoints.files(t, bad)
    page = endpoints.files(t, 1, limit=1)
    assert (page.has_more, page.next_cursor, [r.file_name for r in page.rows]) == (True, (100, 10), ["a.fa"])
    page = endpoints.files(t, 1, cursor=page.next_cursor, limit=1)
    assert (page.has_more, page.next_cursor, page.rows[0].size) == (False, None, 0)
    assert endpoints.files(t, 1, asset_id=11).rows == [] and endpoints.files(t, 3).rows == []
    page = endpoints.datasets(t, Page(query="RICE", sort="relevance", limit=1))
    assert page.has_more and page.next_cursor == (0, 1) and page.type_counts == {"genome": 1, "rna": 1}
    assert endpoints.dataset_by_name(t, "rice")[0].id == 1
    with pytest.raises(NotFound):
        endpoints.dataset_by_name(t, "Rice")
    assert endpoints.facets(t)["species"] == [("Oryza", 2)]


def test_cached_values_age():
    now, calls = [0.0], []
    value = endpoints.Cached(lambda: calls.append(1) or len(calls), 60, lambda: now[0])
    assert value.get() == value.get() == 1
    now[0] = 60.0
    assert value.get() == 2


def test_project_show(spark):
    p = spark.createDataFrame([(1, "a", "x"), (2, "b", None), (3, "a", None)], "id long, name string, species string")
    links = spark.createDataFrame([(1, 7), (1, 8), (3, 9)], "project_id long, file_id long")
    relations = spark.createDataFrame([(2, 1, "next", 0.5)], "a long, b long, relation string, score double")
    own, near = projects.show(p, links, relations, "a")
    assert (own.first().id, own.first().files) == (1, 2) and [tuple(r) for r in near.collect()] == [("b", "next", 0.5)]
    with pytest.raises(NotFound):
        projects.show(p, links, relations, "c")


def test_metadata_text(spark):
    one = spark.createDataFrame([({"tissue": "leaf", "species": "no"},)], "m map<string,string>")
    text = datasets.metadata_json(F.lit("WGS"), F.lit("rice"), F.lit(None).cast("string"), F.array(F.lit("t")), F.col("m"))
    r = one.select(text.alias("t")).select("t", datasets.metadata_fields("t").alias("f")).first()
    assert json.loads(r.t) == {"assay_type": "WGS", "species": "rice", "tags": ["t"], "tissue": "leaf"}
    assert (r.f.assay_type, r.f.species, r.f.project, r.f.tags, r.f.extra) == ("WGS", "rice", None, ["t"], {"tissue": "leaf"})
    assert spark.range(1).select(datasets.metadata_fields(F.lit("[1]"))).first()[0] is None


def test_vectors_from_bytes(spark):
    import struct

    from tarnwell.functions import embed

    blobs = [(1, bytearray(struct.pack("<3f", 1, -2, 0.5))), (2, bytearray(struct.pack("<f", 4) + b"ab")), (3, None), (4, bytearray())]
    got = {r.file_id: r.vector for r in embed.decode_floats(spark.createDataFrame(blobs, "file_id long, vector binary"), "file_id", "vector").collect()}
    assert got == {1: [1.0, -2.0, 0.5], 2: [4.0], 3: None, 4: []}
    assert embed.dimensions("gte-base") == 768 and embed.dimensions("other") == 384


def test_deepening_stops(spark):
    from tarnwell.operators import trees

    files = spark.createDataFrame([(i, f"/r/{d}/x{i}.txt", 1) for i, d in enumerate(["a/b/c", "a/b/d", "e"])], "id long, path string, size long")
    asked = []

    def choose(top, lines):
        asked.append(top)
        return (["e"], ["a", "/r/a/b"]) if top == "/r" else (["b/c"] if top == "/r/a" else [], ["b", "/r"])

    assert trees.deepen(files, "/r", choose) == ["/r/e", "/r/a/b/c"] and asked == ["/r", "/r/a", "/r/a/b", "/r/a/b/b"]


def test_deepening_in_rounds(spark, tmp_path):
    import os
    import uuid

    from tarnwell.operators import trees

    files = spark.createDataFrame([(i, f"/r/{d}/x{i}.txt", 1) for i, d in enumerate(["a/b/c", "a/b/d", "e", "f/g"])], "id long, path string, size long")
    asked = str(tmp_path)

    def connect():
        answers = {"/r": (["e"], ["a", "f", "/r/a/b"]), "/r/a": (["b/c"], ["b", "/r"]), "/r/f": (["e", "g"], []), "/r/a/b": (["/r/e"], ["d"])}

        def call(prompt):
            top, *lines = prompt.split("\n")
            with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
                f.write(prompt)
            found, deeper = answers.get(top[2:], ([], []))
            return json.dumps({"datasets": found, "deeper": deeper}) if top != "# /r/a/b/d" else "no JSON"

        return call

    got = {r.path: r.round for r in trees.deepen_all(files, "/r", connect, wait=lambda s: None).collect()}
    assert got == {"/r/e": 0, "/r/a/b/c": 1, "/r/f/e": 1, "/r/f/g": 1}
    texts = [open(f"{asked}/{x}").read() for x in os.listdir(asked)]
    # The answer that is no JSON is asked for once more; every directory else once, those of a round together.
    assert sorted(t.split("\n")[0][2:] for t in texts) == ["/r", "/r/a", "/r/a/b", "/r/a/b/d", "/r/a/b/d", "/r/f"]
    want = [r.line for r in trees.annotated(files, "/r/a").orderBy(F.concat("path", F.lit("/"))).collect()]
    assert next(t for t in texts if t.startswith("# /r/a\n")).split("\n")[1:] == want


def test_small_rules(spark):
    from tarnwell.functions import embed, paths, plugins

    assert embed.dimensions("gte-base") == 768 and embed.dimensions("anything else") == 384
    rows = spark.createDataFrame([("/a/.git/x",), ("/a/target/b/c",), ("/a/targets/b",), ("/node_modules/x",), ("/a/x.DS_Store",), ("/a/.DS_Store",)], "path string")
    assert [r[0] for r in rows.where(~paths.in_noise("path")).collect()] == ["/a/targets/b", "/a/x.DS_Store"]
    known = plugins.Registry()
    for name, least, priority in (("low", 0.2, 90), ("mid", 0.5, 10), ("high", 0.9, 50)):
        known.interpreters.append(plugins.Interpreter(name, lambda p, s=least: F.lit(s), lambda p, n=name: F.struct(F.lit(n).alias("project")), priority))
    got = rows.limit(1).select(known.answers(F.col("path")).alias("a")).first().a
    assert [(x.name, x.context.project) for x in got] == [("high", "high"), ("mid", "mid")]
