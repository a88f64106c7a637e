import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.functions import embed, plugins
from tarnwell.operators import inference, trees
from tarnwell.operators.relational import BadRequest, NotFound
from tarnwell.sources import settings, store


def test_siphash_is_the_interpreters():
    items = [b"", b"abc\xff", b"1234567", b"12345678", b"x" * 300]
    code = f"print([hash(x) % 2**64 for x in {[x for x in items if x]!r}])"
    told = subprocess.run([sys.executable, "-c", code], env={"PYTHONHASHSEED": "0"}, capture_output=True, text=True, check=True).stdout
    assert sys.hash_info.algorithm != "siphash13" or json.loads(told) == embed.siphash13(items[1:]).tolist()


def test_hash_embed():
    zero, one, again, two = embed.hash_embed(["", "Rice RNA", "rna  RICE\n", None], 64)
    assert not zero.any() and not two.any() and np.allclose(one, again) and abs(np.linalg.norm(one) - 1) < 1e-6
    h = [int(embed.siphash13([(f"rice{s}").encode() + b"\xff"])[0]) % 64 for s in ("", "_2", "_3")]
    want = np.zeros(64)
    for i, w in zip(h, (1.0, 0.7, 0.5)):
        want[i] += w
    assert np.allclose(embed.hash_embed(["rice"], 64)[0], want / np.linalg.norm(want))


def test_pool():
    hidden = np.array([[[2.0, 0.0], [0.0, 4.0], [9.0, 9.0]]])
    assert np.allclose(embed.pool(hidden, np.array([[1, 1, 0]])), [[1 / 5**0.5, 2 / 5**0.5]])
    assert not embed.pool(hidden, np.zeros((1, 3), int)).any()


def test_embed_with_a_model(spark):
    rows = spark.createDataFrame([(1, "long text"), (2, "x"), (3, None)], "id long, text string")

    def load():
        return lambda texts: (np.ones((len(texts), 2, 4)), np.ones((len(texts), 2), int))

    def broken():
        raise OSError("no model")

    sizes = {r.id: len(r.vector) for r in embed.embed(rows, "id", "text", load).collect()}
    assert sizes == {1: 4, 2: 384, 3: 384}
    assert {len(r.vector) for r in embed.embed(rows, "id", "text", broken, dim=8).collect()} == {8}


def test_batches(spark):
    sizes = [("a", "1", 60, False), ("a", "2", 60, False), ("a", "3", 60, True), ("a", "4", 500, False), ("a", "5", 10, False), ("b", "1", 1, None)]
    rows = spark.createDataFrame(sizes, "root string, path string, size long, kids boolean")
    found = {(r.root, r.path): r.batch for r in inference.batches(rows, "root", "path", "size", "kids", limit=100).collect()}
    assert found == {("a", "1"): 0, ("a", "2"): 1, ("a", "3"): 1, ("a", "4"): 2, ("a", "5"): 3, ("b", "1"): 0}
    assert inference.batches(rows.limit(0), "root", "path", "size", "kids").count() == 0


def test_ask_retries_and_reports(spark):
    prompts = spark.createDataFrame([(1, "good"), (2, "busy"), (3, "garbage"), (4, "down")], "key long, prompt string").coalesce(1)

    def connect():
        calls = {}

        def client(prompt):
            n = calls[prompt] = calls.get(prompt, 0) + 1
            if prompt == "busy" and n < 3 or prompt == "down":
                raise inference.Busy("try later")
            return "oops" if prompt == "garbage" and n == 1 else '{"datasets": []}'

        return client

    found = {r.key: (r.response, r.error) for r in inference.ask(prompts, connect, "datasets", wait=lambda s: None).collect()}
    good = ('{"datasets": []}', None)
    assert found == {1: good, 2: good, 3: good, 4: (None, "try later")}


def test_parse_projects(spark):
    new = {"projects": [{"name": "a", "dirs": ["/x"]}], "relations": [{"project_a": "a", "project_b": "b", "relation": "r", "score": 0.5}]}
    old = {"projects": [{"id": "c", "paths": []}], "relationships": [{"project1": "c", "project2": "d", "relationship": "s", "score": 1}]}
    bad = [{"projects": [{"name": "a"}]}, {"relations": []}, {"projects": [], "relations": [{"project_a": "a"}]}]
    texts = [json.dumps(x) for x in (new, old, *bad)] + ["{", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, response string")
    projects, relations = inference.parse_projects(rows)
    assert sorted((r.key, r.name, r.dirs) for r in projects.collect()) == [(0, "a", ["/x"]), (1, "c", [])]
    assert sorted((r.key, r.project_a, r.project_b, r.relation, r.score) for r in relations.collect()) == [(0, "a", "b", "r", 0.5), (1, "c", "d", "s", 1.0)]


def test_parse_datasets(spark):
    answer = {"datasets": [
        {"name": "rice", "type": "genome", "species": "null", "assets": [{"name": "g", "type": "assembly", "files": [{"path": "a.fa", "role": "primary"}, {"path": "none"}]}]},
        {"name": "nobody", "assets": []}, {"type": "other", "name": "soy"},
    ]}
    responses = spark.createDataFrame([(0, json.dumps(answer)), (1, "{")], "batch long, response string")
    members = spark.createDataFrame([(0, 0, "x_rice", "/d/x_rice"), (0, 1, "rice", "/d/rice"), (0, 2, "soy", "/d/soy")], "batch long, pos int, name string, path string")
    files = spark.createDataFrame([("/d/x_rice", 7, "/d/x_rice/ba.fa"), ("/d/x_rice", 9, "/d/x_rice/a.fa"), ("/d/rice", 1, "/d/rice/a.fa")], "path string, file_id long, file_path string")
    datasets, links, told = inference.parse_datasets(responses, members, files)
    assert sorted((r.path, r.name, r.dataset_type, r.species) for r in datasets.collect()) == [("/d/soy", "soy", "other", None), ("/d/x_rice", "rice", "genome", None)]
    assert [(r.path, r.asset, r.file_id, r.role) for r in links.collect()] == [("/d/x_rice", "g", 7, "primary")]
    assert [tuple(r) for r in told.collect()] == [(7, "genome", None)]


def test_parse_datasets_by_any_name_and_end(spark):
    """Names with separators, an empty one, and ends of different lengths, against the rule on all pairs."""
    members = [(b, i, n, p) for b in (0, 1) for i, (n, p) in enumerate([("a_b_c", "/x/a/b"), ("c", "/x/c/"), ("b_c", "/y/a/b"), (None, "/z/b_c"), ("d", None), ("_", "/q")])]
    files = [(p, 10 * k + i, f"{p}/{n}") for k, p in enumerate(["/x/a/b", "/x/c/", "/y/a/b", "/z/b_c"]) for i, n in enumerate(["s1", "s11", "t/s1", "é1"])]
    said = ["c", "b_c", "a/b", "b", "", "d", "x/a/b", "_c", "none", "a_b_c"]
    ends = ["1", "s1", "", "t/s1", "é1", "/s11", "zz"]
    answer = json.dumps({"datasets": [{"name": n, "assets": [{"name": "g", "files": [{"path": e} for e in ends]}]} for n in said]})
    _, links, _ = inference.parse_datasets(
        spark.createDataFrame([(0, answer), (1, answer)], "batch long, response string"), spark.createDataFrame(members, "batch long, pos int, name string, path string"),
        spark.createDataFrame(files, "path string, file_id long, file_path string"),
    )
    want = []
    for n in said * 2:
        hit = next((p for _, _, m, p in members if m == n or p is not None and p.endswith("/" + n) or m is not None and m.endswith("_" + n)), None)
        want += [(hit, i) for e in ends for i in [min((i for p, i, f in files if p == hit and f.endswith(e)), default=None)] if i is not None]
    assert sorted((r.path, r.file_id) for r in links.collect()) == sorted(want)


@pytest.mark.parametrize(("answer", "species"), [("- Oryza sativa", "Oryza sativa"), ("note\nZea mays L", "Zea mays L"), ("rice", None), ("水稻 Oryza", None), ("", None), ("a b c d", None)])
def test_clean_species(spark, answer, species):
    assert spark.range(1).select(inference.clean_species(F.lit(answer))).first()[0] == species


def test_candidates_and_prompt(spark):
    assert spark.range(1).select(inference.candidate_list(F.lit(" a, ,b,"))).first()[0] == ["a", "b"]
    assert inference.layered_prompt("s") == "s\n" and "# Rules\nr" in inference.layered_prompt("s", "r")


def test_merge_projects(spark):
    rows = spark.createDataFrame([(1, "rice_a", "rice"), (2, "rice_b", "rice"), (3, "rice_c", None), (4, "ric", "rice"), (5, "rice_d", "soy")], "id long, name string, species string")
    assert {r.id: r.base for r in inference.merge_projects(rows).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_annotated_tree(spark):
    files = spark.createDataFrame([(p, 1) for p in ("/r/a/x.fa", "/r/b/c/y.bam", "/r/b/c/z.bam", "/r/d/notes.txt", "/r/d/e/more.doc", "/r/f/g/h/i.doc")], "path string, size long")
    lines = [r.line for r in trees.annotated(files, "/r").orderBy(F.concat("path", F.lit("/"))).collect()]
    assert lines == [
        "BIO↑ r/ (f:0 none sub:4) | sub:4 bio:1",
        "  BIO a/ (auto:1 files [fa×1] sub:0/0)",
        "  BIO↑ b/ (auto:0 files sub:1/1)",
        "  ? d/ (f:1 txt×1 sub:1) | sub:1 bio:0",
        "    ? e/ (f:1 doc×1)",
        "  EMPTY f/ (f:0 none sub:1) | sub:1 bio:0",
    ]


def test_plugins(spark, tmp_path):
    (tmp_path / "good.py").write_text("from tarnwell.functions.plugins import path_interpreter\nplugin = path_interpreter()\n")
    (tmp_path / "bad.py").write_text("1 / 0\n")
    known = plugins.Registry()
    assert known.discover(str(tmp_path)) == 1 and known.discover(str(tmp_path / "absent")) == 0
    rows = spark.createDataFrame([("/human/rnaseq/s_R1.fastq",), ("/mouse/wgs/s.txt",)], "path string")
    builtin = F.lit(None).cast("struct<assay_type:string,species:string,tags:array<string>>")
    first, second = rows.select(known.interpret(F.col("path"), builtin).alias("c"), known.answers(F.col("path")).alias("all")).collect()
    assert tuple(first.c) == ("RNA-seq", "human", ["paired-end"]) and first["all"][0].score == 0.8 and second.c is None and second["all"] == []


def test_python_plugins(spark):
    def body(path):
        if path.endswith("x"):
            raise ValueError
        return {"file_type": path, "mime": "m"} if path.startswith("a") else None

    f = plugins.from_python(body, plugins.FORMAT)
    known = plugins.Registry()
    known.add(plugins.Detector("py", lambda path, magic: f(path)))
    rows = spark.createDataFrame([("a",), ("ax",), ("b",), ("a" * 5000,)], "path string")
    plain = F.struct(F.lit("plain").alias("file_type"), F.lit("").alias("mime"))
    assert [r[0] for r in rows.select(known.detect(F.col("path"), F.lit(None), plain)["file_type"]).collect()] == ["a", "plain", "plain", "plain"]


def test_settings(tmp_path):
    path = str(tmp_path / "conf" / "settings.toml")
    assert settings.load(path) == settings.Settings() == settings.load(path)
    (tmp_path / "old.toml").write_text('[scan]\ninclude = ["/a"]\n')
    assert [n for n, _ in settings.load(str(tmp_path / "old.toml")).enabled_servers()] == ["local"]
    (tmp_path / "two.toml").write_text('[servers.b]\nhost = "h"\nscan_root = "/x"\n[servers.a]\nenabled = false\n')
    two = settings.load(str(tmp_path / "two.toml"))
    assert two.enabled_servers() == [("b", settings.Server("h", ["/x"]))]
    settings.save(two, path)
    assert settings.load(path) == two
    assert two.sync_time() == (3, 0) and settings.Settings(full_sync="4:30").sync_time() == (4, 30) and settings.Settings(full_sync="x").sync_time() == (3, 0)


def test_corrections(tmp_path):
    path = str(tmp_path / "c.json")
    assert settings.load_records(path, []) == []
    settings.correct(path, "cds_v1")
    assert settings.correct(path, "cds_v1")["patterns"] == [{"pattern": "cds_v1", "count": 2}]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "catalogue"))
    assert s.version() == 0 and not s.ready()
    with pytest.raises(NotFound):
        s.read("files")
    tables = {t: spark.range(3) for t in store.NEEDED}
    assert s.commit(tables, {"files": 3}, layout=2) == 1 and s.ready()
    assert s.read("asset").columns == ["id", "snapshot_id"] and s.read("dataset").where("updated_at = 0").count() == 3
    with pytest.raises(store.Unavailable):
        s.commit({"files": spark.range(5)}, {"files": 6})
    assert s.version() == 1 and s.read("files").count() == 3
    assert s.commit({"files": spark.range(5)}, {"files": 5}) == 2 and s.read("files").count() == 5 and s.read("asset").count() == 3
    reader = store.Store(spark, str(tmp_path / "catalogue"), read_only=True)
    with pytest.raises(store.Unavailable):
        reader.commit({})
    assert [store.status_of(e) for e in (BadRequest(), NotFound(), store.Unavailable(), ValueError())] == [400, 404, 503, 500]
