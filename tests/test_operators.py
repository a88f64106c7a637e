import json

import pytest
from pyspark.sql import functions as F

from tarnwell.functions import formats, paths, text
from tarnwell.operators import catalog, containment, relational, search
from tarnwell.operators.relational import BadRequest, Page
from tarnwell.sources import listing
from tarnwell.streaming import changes


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(expr).first()[0]


@pytest.mark.parametrize(
    ("name", "ext"),
    [("a.fastq.gz", "fastq.gz"), ("A.FNA.bz2", "fna.bz2"), ("x.tar.gz", "gz"), ("t.csv.gz", "csv.gz"), ("noext", "(noext)"), ("s.mzML", "mzml"), (".hidden", "hidden")],
)
def test_extension(spark, name, ext):
    assert one(spark, paths.extension(F.lit(name))) == ext


def test_the_second_rule_of_extensions(spark):
    names = {"a.FASTQ.gz": "fastq.gz", "b.fa.gz": "fa.gz", "c.tar.gz": "gz", "d.": "", "noext": "(noext)", ".hidden": "hidden", "x.vcf.gz.tmp": "tmp", "xfastq.gz": "gz", "é.TSV.GZ": "tsv.gz"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", paths.second_extension("name").alias("ext"))
    assert {r.name: r.ext for r in rows.collect()} == names


def test_bio_extensions_ignore_case(spark):
    assert one(spark, paths.is_bio(F.lit("narrowPeak"))) and one(spark, paths.is_bio(F.lit("fna.zst"))) and not one(spark, paths.is_bio(F.lit("csv.gz")))


@pytest.mark.parametrize(
    ("path", "magic", "kind"),
    [("x.bam", b"BAM\x01zz", "BAM"), ("x.fq.gz", b"\x1f\x8b\x08\x00", "gzip(gzip)"), ("x", b">chr1", "FASTA"), ("x", b"@SQ\tSN", "SAM"), ("x", b"@read1", "FASTQ"), ("x.csv", b"", "CSV"), ("x", b"", "unknown"), ("x.h5", b"\x89HDF\r\n", "HDF5")],
)
def test_detect(spark, path, magic, kind):
    rows = spark.createDataFrame([(path, bytearray(magic))], "path string, magic binary")
    assert rows.select(formats.detect("path", F.col("magic"))).first()[0] == kind


def test_project_and_tags(spark):
    tree = F.array(*map(F.lit, ["rnaseq", "lung_cancer", "projects"]))
    assert one(spark, paths.project_of(tree)) == "lung_cancer"
    assert one(spark, paths.project_of(F.array(F.lit("data"), F.lit("raw")))) is None
    assert one(spark, paths.paired_tag(F.lit("/a/S_R1.fq"))) == "paired-end"
    assert one(spark, paths.name_family(F.lit("SRR624_1.fastq"))) == "SRA_run"
    assert one(spark, paths.version_pattern(F.lit("cds_v1.0"))) == "cds_v1"


def test_fold_is_ascii_only(spark):
    assert one(spark, text.fold(F.lit("ÉA"))) == "Éa"
    assert one(spark, text.epoch_text(F.lit(0))) == "never"


def test_containment_sees_every_ancestor(spark):
    ds = spark.createDataFrame([(1, "/a"), (2, "/a/b"), (3, "/a/c")], "id long, path string")
    fs = spark.createDataFrame([(7, "/a/d/x"), (8, "/ab/x"), (9, "/a/b/y"), (10, "/a")], "id long, path string")
    got = {(r.dataset_id, r.file_id) for r in containment.containment(fs, ds).collect()}
    assert got == {(1, 7), (1, 9), (2, 9), (1, 10)}
    assert {tuple(r) for r in containment.most_specific(fs, ds).collect()} == {(7, 1), (9, 2), (10, 1)}


def test_best_dataset_boundaries(spark):
    ds = spark.createDataFrame([(1, "/data/rice/rna"), (2, "/data/riceXrna")], "id long, path string")
    assert containment.best_dataset(ds, "/data/rice/rna/sample").first().id == 1
    assert containment.best_dataset(ds, "/data/rice_rna/sample").count() == 0


def catalogue(spark):
    d = spark.createDataFrame([(1, "rice genome", "/p1", "genome", "Oryza sativa", "s", 1), (2, "soy", "/p2", "rna", "Glycine", None, 1), (3, "Oryza", "/p3", None, None, None, 1), (4, "Oryza_reads", "/p4", "reads", None, None, 1)], "id long, name string, path string, dataset_type string, species string, summary string, updated_at long")
    a = spark.createDataFrame([(10, 1, "a", "x")], "id long, dataset_id long, name string, asset_type string")
    li = spark.createDataFrame([(10, 100, "primary"), (10, 101, "annotation")], "asset_id long, file_id long, role string")
    return d, a, li


def test_relevance_order_and_cursor(spark):
    d, a, li = catalogue(spark)
    rows = relational.dataset_page(d, a, li, Page(query="oryza", sort="relevance")).orderBy("relevance_rank", "id").collect()
    assert [r.id for r in rows] == [3, 4, 1] and rows[2].file_count == 2
    rest = relational.dataset_page(d, a, li, Page(query="oryza", sort="relevance", cursor=(0, 3))).collect()
    assert sorted(r.id for r in rest) == [1, 4]
    assert sum(r["count"] for r in relational.type_counts(d, "Oryza", None).collect()) == 3


def test_wildcards_are_plain(spark):
    d, a, li = catalogue(spark)
    assert relational.dataset_page(d, a, li, Page(query="%")).count() == 0


@pytest.mark.parametrize("bad", [{"limit": 0}, {"limit": 10_000}, {"sort": "size"}, {"sort": "relevance"}, {"query": "x" * 201}, {"cursor": (-1, 0)}])
def test_page_validation(bad):
    with pytest.raises(BadRequest):
        Page(**bad)


def test_upsert_revives_and_keeps_ids(spark):
    cols = "id long, path string, size long, mtime long, source_server string, format string, deleted boolean, indexed_at long, updated_at long, bio_metadata string, species string, assay_type string"
    files = spark.createDataFrame([(5, "/a", 1, 1, "s", "BAM", True, 9, 9, "{}", None, None)], cols)
    delta = spark.createDataFrame([("/a", 2, 3, "s", None), ("/a", 7, 2, "s", None), ("/b", 1, 1, "s", "VCF")], "path string, size long, mtime long, source_server string, format string")
    got = {r.path: r for r in catalog.upsert(files, delta, 50).collect()}
    assert (got["/a"].id, got["/a"].size, got["/a"].deleted, got["/a"].indexed_at, got["/a"].format, got["/a"].updated_at) == (5, 2, False, 9, "BAM", 50)
    assert got["/b"].id == 6 and got["/b"].indexed_at == 50


def test_query_grammar(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "apple red"), (3, "green pear"), (4, None)], "id long, text string")
    found = lambda q: {r.doc_id for r in search.bm25(docs, q).collect()}
    assert found('"red apple"') == {1} and found("apple -pie") == {2} and found("apple pear") == {1, 2, 3} and found("red AND pie") == {1}
    assert found('"broken') == set() and found("") == set()


def test_listings(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "deep" / "b.tmp").write_text("y")
    (tmp_path / "deep" / "c.fq").write_text("z")
    got = {r.path for r in listing.scan_tree(spark, [str(tmp_path)], ["*.tmp"]).collect()}
    assert got == {str(tmp_path / "a.txt"), str(tmp_path / "deep" / "c.fq")}
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"path":"/x","size":3,"mtime_secs":5}\nno json\n{"path":"/y"}\n')
    assert sorted(tuple(r) for r in listing.read_jsonl(spark, str(lines)).collect()) == [("/x", 3, 5), ("/y", 0, 0)]
    tsv = tmp_path / "l.tsv"
    tsv.write_text("/x\t3\t5.9\nbroken\n")
    assert [tuple(r) for r in listing.read_tsv(spark, str(tsv)).collect()] == [("/x", 3, 5)]


def test_change_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    events = [("add", "/a", 1), ("mod", "/a", 2), ("add", "/b", 1), ("del", "/b", 3), ("rename", "/c", 4)]
    (src / "e.json").write_text("\n".join(json.dumps({"event": e, "path": p, "size": 1, "mtime_secs": t}) for e, p, t in events))
    seen = []
    q = changes.apply_batches(changes.read_changes(spark, str(src)), lambda up, gone, n: seen.append(({r.path for r in up.collect()}, {r.path for r in gone.collect()})), str(tmp_path / "cp"), seconds=None)
    q.awaitTermination(60)
    assert seen == [({"/a"}, {"/b"})]
