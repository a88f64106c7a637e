"""Importance resampling against a loop over all features."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tarnwell.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def totals(texts, n, buckets):
    out = Counter()
    for t in texts:
        out.update(zlib.crc32(f.encode()) % buckets for f in features(t, n)[1])
    return out


def brute(docs, target, n=1, buckets=10_000, percent=10, least=20):
    s, t = totals([x for _, x in docs], n, buckets), totals(target, n, buckets)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, text in docs:
        w, own = features(text, n)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(w)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted([tuple(r[:5]) for r in rows], key=repr)


def corpus(n=120):
    rng = random.Random(4)
    pool = ["Alpha", "beta", "GAMMA", "délta", "Éps", "ζeta", "x9", "1.2", "a-b", "under_score", "İ", "end\x00nul"]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*docs, (None, "alpha " * 30), (n, None), (n + 1, ""), (n + 2, "alpha " * 5000), (n + 3, "-" * 100_000), docs[3], docs[3], (7, docs[7][1])]


@pytest.mark.parametrize("n, limit", [(1, 1 << 19), (1, 3), (3, 1 << 19), (3, 5)])
def test_against_loop(spark, n, limit):
    docs, target = corpus(), ["alpha beta délta x9", None, "", "beta beta gamma", "nul end"]
    frame = spark.createDataFrame([(*d, 1, "w") for d in docs], "doc_id long, text string, score int, id string").repartition(5)
    got = resampling.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), n=n, buckets=500 if n == 3 else 10_000, limit=limit)
    assert sorted([tuple(r) for r in got.collect()], key=repr) == brute(docs, target, n, 500 if n == 3 else 10_000)


def test_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    assert resampling.resample(docs.limit(0), none).collect() == []
    assert sorted([tuple(r) for r in resampling.resample(docs, none).collect()], key=repr) == brute(corpus(), [])


def test_trie_states_are_those_of_the_whole_run():
    trie = resampling.Trie(lambda crc: crc)
    for run in [(b"a",), (b"a", b"b"), (b"a", b"b", "é".encode()), (b"c", b"a")]:
        assert trie.node(run)[1] == trie.node(run)[0] == zlib.crc32(b" ".join(run))
    assert len(trie.nodes) == 5


def test_query_has_every_row(spark, sf):
    got = queries.op11_resample(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = got.collect()
    able = [r for r in rows if r.rank is not None]
    assert len(rows) == n and sorted(r.rank for r in able) == list(range(1, len(able) + 1))
    assert {t for _, t in got.dtypes} == {"bigint"}
