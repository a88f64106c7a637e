"""Search over tables that change, and tables without what a query starts from."""

import os
import shutil

import pytest

from tarnwell.operators import fulltext
from tarnwell.plans import queries, writing  # noqa: F401 - registers queries
from tarnwell.plans.registry import QUERIES


@pytest.fixture
def tables(spark, sf, tmp_path):
    for name in ("documents", "embeddings"):
        shutil.copyfile(f"{sf}/{name}.parquet", f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_searches_follow_a_table_written_anew(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    n = QUERIES["index_num_docs"](spark, tables).first()[0]
    before = QUERIES["bm25_topk"](spark, tables).collect()
    more = docs.selectExpr("doc_id + 1000000 AS doc_id", "concat('apache thing ', text) AS text", "lang", "source", "n_chars")
    docs.union(more).coalesce(1).write.parquet(f"{tables}/next.parquet")
    shutil.move(f"{tables}/documents.parquet", f"{tables}/old")
    shutil.move(f"{tables}/next.parquet", f"{tables}/documents.parquet")
    assert QUERIES["index_num_docs"](spark, tables).first()[0] == 2 * n
    after = {r.doc_id for r in QUERIES["bm25_topk"](spark, tables).collect()}
    assert any(i >= 1000000 for i in after) and after != {r.doc_id for r in before}
    assert {tuple(r) for r in QUERIES["bm25_topk"](spark, tables).collect()} == {tuple(r) for r in QUERIES["bm25_scan"](spark, tables).collect()}


def test_vectors_without_a_first_id(spark, tables):
    vectors = spark.read.parquet(f"{tables}/embeddings.parquet")
    vectors.where("vec_id > 3").coalesce(1).write.parquet(f"{tables}/some.parquet")
    vectors.limit(0).coalesce(1).write.parquet(f"{tables}/none.parquet")
    shutil.move(f"{tables}/embeddings.parquet", f"{tables}/old")
    for name, n in (("some", 20), ("none", 0)):
        shutil.rmtree(f"{tables}/embeddings.parquet", ignore_errors=True)
        shutil.move(f"{tables}/{name}.parquet", f"{tables}/embeddings.parquet")
        assert len(QUERIES["cosine_topk"](spark, tables).collect()) == n
        assert len(QUERIES["hybrid_rerank"](spark, tables).collect()) > 0


def slow(docs, query, k):
    """BM25 over all fields by counting, for queries of plain words."""
    import math
    import re
    from collections import Counter

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    fields = {i: (words(m), words(p), words(" ".join(g or []))) for i, m, p, g in docs}
    n, total = len(fields), [sum(len(f[j]) for f in fields.values()) for j in range(3)]
    out = Counter()
    for t in words(query):
        for j in range(3):
            df = sum(t in f[j] for f in fields.values())
            for i, f in fields.items():
                tf = f[j].count(t)
                if tf:
                    out[i] += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(f[j]) / (total[j] / n)))
    return [(i, round(s, 6)) for i, s in sorted(((i, round(s, 6)) for i, s in out.items()), key=lambda x: (-x[1], x[0]))[:k]]


@pytest.fixture(scope="module")
def crowd():
    import random

    rng = random.Random(12)
    docs = []
    for i in range(3000):
        w = ["common"] * rng.choice([1, 1, 1, 2]) + [rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(3, 30))]
        w += ["rare"] * (i in (17, 1203, 2901)) + ["middling"] * (i % 400 == 5)
        rng.shuffle(w)
        docs.append((i * 3, " ".join(w), f"/data/{i % 7}/f{i}", ["tag"] if i % 50 == 0 else []))
    return docs


DOCUMENT = "id long, metadata string, path string, tags array<string>"


def test_only_blocks_that_can_reach_the_page_are_read(spark, crowd, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK_BITS", 4)
    monkeypatch.setattr(fulltext, "DIRECT", 0)
    index = fulltext.TextIndex(spark, str(tmp_path / "index"))
    index.rebuild(spark.createDataFrame(crowd, DOCUMENT))
    for query, k in (("rare common", 3), ("middling common alpha", 8), ("common", 20), ("tag common f5", 10), ("rare", 50)):
        got = [tuple(r) for r in index.search(query, k).orderBy("doc_id").collect()]
        want = sorted(slow(crowd, query, k))
        assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a[1] - b[1]) < 2e-6 for a, b in zip(got, want)), query
        told = index.read
        if query == "rare common":
            # The three documents with the rare word settle the page; blocks of the common one alone stay closed.
            assert told.all > 500 and told.opened < 0.05 * told.all
        assert told.opened <= told.all
    # Fewer hits than asked for: everything has to be read, and nothing is lost.
    assert index.search("middling common", 5000).count() == 3000 and index.read.opened == index.read.all


def test_many_segments_are_merged(spark, crowd, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "MOST", 3)
    monkeypatch.setattr(fulltext, "BLOCK_BITS", 6)
    monkeypatch.setattr(fulltext, "DIRECT", 2)
    some, folder = {d[0]: d for d in crowd[:200]}, tmp_path / "index"
    index = fulltext.TextIndex(spark, str(folder))
    index.rebuild(spark.createDataFrame(list(some.values()), DOCUMENT))
    for step in range(4):
        new = [(3 * (step * 20 + j), f"changed common rare{step}", "/x", []) for j in range(15)]
        gone = [3 * (150 + step)]
        index.put(spark.createDataFrame(new, DOCUMENT))
        index.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        index.commit(step)
        some |= {d[0]: d for d in new}
        for i in gone:
            some.pop(i)
        assert index.applied() == step and index.num_docs() == len(some)
        # Frequencies count hidden documents, so only which documents are found is exact.
        assert {r.doc_id for r in index.search("changed", 100).collect()} == {i for i, d in some.items() if "changed" in d[1]}
        assert {r.doc_id for r in index.search("alpha beta gamma delta", 500).collect()} == {i for i, d in some.items() if "changed" not in d[1]}
    segments = index._segments()
    assert len(segments) <= 3 and sorted(x for x in os.listdir(folder) if x.startswith("s-")) == sorted(segments)
    index.rebuild(spark.createDataFrame(list(some.values()), DOCUMENT))
    got = [tuple(r) for r in index.search("changed rare2", 30).orderBy("doc_id").collect()]
    assert [i for i, _ in got] == sorted(i for i, _ in slow(list(some.values()), "changed rare2", 30))
