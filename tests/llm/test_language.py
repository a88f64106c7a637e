"""Language identification: held-out accuracy, predictions against plain loops, and what must be unknown."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwell.llm import language, queries


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.fit(docs.where(~language.held_out(F.col("doc_id"))))


def test_held_out_accuracy(spark, docs):
    got = queries.op12_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 250
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.985
    assert all(0 <= r.score <= 1 for r in got)
    # Rejection keeps nearly all texts of the trained languages.
    assert sum(r.rejected for r in held) / len(held) < 0.03


def slow_grams(text):
    low = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode())
    raw = b" " + b" ".join(low.split(b" ")) + b" "
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    out = Counter()
    for size in (2, 3, 4):
        for i in range(len(raw) - size + 1):
            code = size
            for b in raw[i : i + size]:
                code = (code << 8 | b) & (2**64 - 1)
            out[(code * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> (64 - 13)] += 1
    return out


def test_predictions_against_loops(docs, model):
    for r in docs.limit(40).collect() + [type("R", (), {"text": t})() for t in ("É", "a1b2", "  The-End\n\n of it ", "x" * 3000)]:
        v = {d: (1 + math.log(n)) * model.idf[d] for d, n in slow_grams(r.text).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x * model.centers[d, j] for d, x in v.items()) / size for j in range(len(model.langs))]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        lang, score, _ = model.predict(r.text)
        assert lang == model.langs[best] and abs(score - min(1, max(0, cosine[best]))) < 1e-9


def test_blocks_do_not_change_grams(monkeypatch):
    text = "Grüße aus der Stadt, and back again. " * 50
    at, n = language.grams(text)
    monkeypatch.setattr(language, "_BLOCK", 7)
    again = language.grams(text)
    assert (at == again[0]).all() and (n == again[1]).all()
    assert dict(zip(at.tolist(), n.tolist())) == dict(slow_grams(text))


def test_rejection_by_distance(model):
    assert model.predict("qzx qwk vvzj xqqk jjqz wqkx zzvq xkqj " * 20)[2]
    assert not model.predict("The of and thing in the here that with ation there. " * 5)[2]


def test_cluster_finds_separate_groups():
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(0, 0.02, (60, 30)))
    for i in range(60):
        x[i, i % 3 * 10 : i % 3 * 10 + 10] += 1
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    centers = language.cluster(x.astype(np.float32), 3)
    of = np.argmax(x @ centers.T, 1)
    assert [len(set(of[k::3])) for k in range(3)] == [1, 1, 1] and len(set(of)) == 3
    assert len(language.cluster(np.ones((5, 4), np.float32) / 2, 3)) == 1


def test_edges(spark, model, docs):
    texts = [None, "", " \n", "123 ... 4-5", "é", "你好 世界", "the and " * 200_000, "z" * 1_200_000, "1" * 1_200_000, "same", "same"]
    frame = spark.createDataFrame([(i if i != 4 else None, t, 1, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, score int, lang_pred string, rejected boolean")
    got = language.identify(frame, model).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    assert all(tuple(by[i])[1:] == ("und", 0.0, True) for i in (0, 1, 2, 3, 8))
    assert by[None].lang_pred in model.langs and tuple(by[9])[1:] == tuple(by[10])[1:]
    assert language.identify(frame.limit(0), model).count() == 0


def test_nothing_to_learn(spark):
    rows = [(1, "some words", None), (2, None, "en"), (3, "...", "fr")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    empty = language.fit(frame)
    assert {tuple(r) for r in language.identify(frame, empty).collect()} == {(i, "und", 0.0, True) for i in (1, 2, 3)}
    one = language.fit(spark.createDataFrame([(1, "ein Wort", "de")] * 50, "doc_id long, text string, lang string"))
    assert set(one.langs) == {"de"} and one.predict("ein Wort")[1] > 0.999


def test_held_out_follows_the_id(spark):
    import zlib

    rows = [(i,) for i in (None, 0, 1, 2, 17, 10**12)]
    got = spark.createDataFrame(rows, "doc_id long").select("doc_id", language.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
