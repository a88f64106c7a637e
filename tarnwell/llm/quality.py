"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or abstain on every document. Expectation-maximisation over the
counts of vote patterns (of all documents; at most 3**labellers patterns) estimates each labeller's
accuracies and the share of good documents. Documents are mostly bad in one way, so the labellers are not independent among the bad ones;
the model therefore has one good class and a bad one for each labeller, named by where it starts. All vote tables are free: every labeller starts from the same
accuracy, which also smooths the counts, and nothing bounds where it ends. The posteriors of a bounded sample train a linear scorer
on hashed trigrams of character classes, which then scores every document. No given labels are used.
"""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import mix64, rows_of

DIMS = 2048
SAMPLE = 8192
KEEP = 0.5

#: Accuracy from which every labeller starts; it counts as PRIOR documents of each class.
RIGHT, PRIOR = 0.7, 1.0

#: What a document is bad from and good to, after the rules published for web corpora (symbols and letters in words, word
#: length, closing punctuation, repeated pairs of words, capitals). No table's labels set them.
LIMITS = {
    "symbols": (0.1, 0.01),  # symbol characters per word
    "wordless": (0.2, 0.05),  # words without a letter
    "lengths": (3.5, 2.5),  # mean letters per word, as the distance from 6.5 (3 to 10) and from 5.75 (3.25 to 8.25)
    "endings": (0.88, 0.5),  # lines without closing punctuation
    "pairs": (0.2, 0.1),  # the most frequent pair of neighbouring words, if it repeats
    "stutter": (0.2, 0.05),  # words equal to the one before
    "capitals": (0.3, 0.1),  # of letters
    "exclaim": (0.1, 0.02),  # exclamation marks per word
    "columns": (0.1, 0.01),  # words that are one separator or bullet
    "letters": (0.3, 0.15),  # visible characters that are no letters
}
LABELLERS = tuple(LIMITS)

#: Bytes by class: lower a (and all of UTF-8's high bytes), upper A, digit 0, white space, others themselves.
_CLASSES = bytes(
    ord("a") if 97 <= i <= 122 or i >= 128 else ord("A") if 65 <= i <= 90 else ord("0") if 48 <= i <= 57 else 32 if i in (9, 11, 12, 13) else i for i in range(256)
)
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_HIGH = re.compile(rb"[\xc3][\x80-\x9e]")
#: The first letter of a word and all after it, so one match for each word with a letter.
_LETTERED = re.compile(rb"[aA][^ \n]*")


class Features(NamedTuple):
    votes: np.ndarray
    trigrams: np.ndarray


def vote(name: str, value: float, good: float | None = None) -> int:
    """-1 (bad) from the labeller's first limit on, 1 (good) up to its second, else 0 (abstain)."""
    bad_from, good_to = LIMITS[name]
    return -1 if value >= bad_from else 1 if (value if good is None else good) <= good_to else 0


def describe(text: str | None) -> Features:
    """Votes, and hashed trigrams of the text's classes with equal neighbours merged. Without words all abstain."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return Features(np.zeros(len(LABELLERS), np.int8), np.zeros(0, np.int64))
    plain = raw.translate(_CLASSES)
    classes = np.frombuffer(plain, np.uint8)
    size = np.bincount(classes, minlength=256)
    upper = int(size[65]) + len(_HIGH.findall(raw))
    letters = int(size[97] + size[65])
    visible = int(len(raw) - size[32] - size[10])
    pairs = Counter(zip(words, words[1:]))
    top = max(pairs.values(), default=0)
    lines = [x.rstrip() for x in raw.split(b"\n") if x.strip()]
    mean = letters / n
    votes = [
        vote("symbols", size[_SYMBOLS].sum() / n),
        vote("wordless", 1 - len(_LETTERED.findall(plain)) / n),
        vote("lengths", abs(mean - 6.5), abs(mean - 5.75)),
        vote("endings", 1 - sum(x.endswith((b".", b"!", b"?", b'"', b":")) for x in lines) / len(lines)),
        vote("pairs", (top if top > 1 else 0) / max(1, n - 1)),
        vote("stutter", sum(c for (x, y), c in pairs.items() if x == y) / max(1, n - 1)),
        vote("capitals", upper / max(1, letters)),
        vote("exclaim", size[33] / n),
        vote("columns", sum(map(words.count, (b"|", b"*", b"-", b"#"))) / n),
        vote("letters", 1 - letters / visible),
    ]
    short = classes[np.append(True, classes[1:] != classes[:-1])].astype(np.int64)
    short = np.concatenate([[10], short, [10, 10]])
    return Features(np.array(votes, np.int8), (mix64(short[:-2] << 16 | short[1:-1] << 8 | short[2:]) % np.uint64(DIMS)).astype(np.int64))


def _code(votes: np.ndarray) -> int:
    return int(((votes.astype(np.int64) + 1) * 3 ** np.arange(len(votes))).sum())


def _votes(code: int) -> np.ndarray:
    return code // 3 ** np.arange(len(LABELLERS)) % 3 - 1


class Labels(NamedTuple):
    posterior: dict[int, float]
    """Probability of good by pattern."""
    accuracy: np.ndarray
    """For each labeller: share of good among good documents' votes, of bad among bad documents' votes; abstentions left out."""
    share: float
    """Of good documents."""


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> Labels:
    """The label model by EM over patterns and their counts: class 0 is good, class j + 1 is what labeller j finds bad."""
    votes = np.array([_votes(int(c)) for c in codes], np.int64).reshape(-1, len(LABELLERS)) + 1
    k, rest = votes.shape[1], (1 - RIGHT) / 2
    start = np.full((k + 1, k, 3), rest)
    start[:, :, 2] = RIGHT
    start[np.arange(k) + 1, np.arange(k)] = (RIGHT, rest, rest)
    share = np.append(0.5, np.full(k, 0.5 / k))
    tables, post = start, np.zeros((k + 1, len(counts)))
    for _ in range(rounds):
        now = np.log(tables)[:, np.arange(k), votes].sum(2) + np.log(share)[:, None]
        now = np.exp(now - now.max(0, initial=-np.inf))
        now /= now.sum(0)
        done = np.abs(now - post).max(initial=0) < 1e-7
        post = now
        weight = post * counts
        tables = np.stack([weight @ (votes == v) for v in range(3)], axis=2) + PRIOR * start
        tables /= tables.sum(2, keepdims=True)
        share = (weight.sum(1) + PRIOR) / (counts.sum() + PRIOR * (k + 1))
        if done:
            break
    bad = np.einsum("z,zjv->jv", share[1:], tables[1:])
    right = np.stack([tables[0, :, 2] / (tables[0, :, 2] + tables[0, :, 0]), bad[:, 0] / (bad[:, 0] + bad[:, 2])], axis=1)
    return Labels(dict(zip(codes.tolist(), post[0].tolist())), right, float(share[0]))


def train(rows: list[np.ndarray], counts: list[np.ndarray], labels: np.ndarray, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias of logistic regression on square roots of trigram shares, by accelerated gradient steps."""
    x = np.zeros((len(rows), DIMS), np.float32)
    for i, (at, n) in enumerate(zip(rows, counts)):
        x[i, at] = np.sqrt(n / n.sum())
    y = labels.astype(np.float32)
    w, b = np.zeros(DIMS, np.float32), 0.0
    v, c = w, b
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30)))
        g = (p - y) / max(1, len(y))
        # The rows have norm 1, so 2 is a safe step for a curvature of at most 1/4 each in w and b.
        w2, b2 = v - 2 * (x.T @ g + 1e-5 * v), c - 2 * float(g.sum())
        m = t / (t + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def score(trigrams: np.ndarray, w: np.ndarray, b: float) -> float:
    at, n = np.unique(trigrams, return_counts=True)
    return float(1 / (1 + np.exp(-np.clip(float(np.sqrt(n / max(1, n.sum())) @ w[at].astype(np.float64)) + b, -30, 30))))


def _codes(batches):
    for batch in batches:
        for part in rows_of(batch):
            yield pa.RecordBatch.from_arrays([pa.array([_code(describe(t).votes) for t in part.column(0).to_pylist()], pa.int64())], ["code"])


def _sample(batches):
    for batch in batches:
        for part in rows_of(batch):
            out = []
            for t in part.column(0).to_pylist():
                f = describe(t)
                at, n = np.unique(f.trigrams, return_counts=True)
                out.append((_code(f.votes), at.astype(np.int32), n.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.list_(pa.int32()))], ["code", "dims", "counts"])


class Model(NamedTuple):
    labels: Labels
    weights: np.ndarray
    bias: float


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """The label model from votes over all documents, and the scorer from about ``sample`` of them.

    The sample is chosen by hash of id and text; it bounds the driver's memory. Only pattern counts and the
    sample reach the driver.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    seen = rows.select("text").mapInArrow(_codes, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()
    codes, counts = np.array([r.code for r in seen], np.int64), np.array([r.n for r in seen], np.float64)
    order = np.argsort(codes)
    labels = estimate(codes[order], counts[order])
    share = min(1.0, sample / max(1, counts.sum()))
    chosen = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    fitted = chosen.select("text").mapInArrow(_sample, "code long, dims array<int>, counts array<int>").collect()
    fitted.sort(key=lambda r: (r.code, r.dims, r.counts))
    w, b = train([np.array(r.dims, np.int64) for r in fitted], [np.array(r.counts, np.float64) for r in fitted], np.array([labels.posterior.get(r.code, 0.5) for r in fitted]))
    return Model(labels, w, b)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """(id, votes, posterior, score, keep) for every row.

    ``votes`` is one of "-", "0", "+" per labeller, ``posterior`` the label model's probability of good by
    the pattern, ``score`` the trained scorer's, and a row is kept from a score of ``keep`` on. Texts without
    words (null, empty) abstain and get the scorer's value for no trigrams; repeated rows are alike. An empty
    table gives an empty result; other columns are ignored, whatever their names. Two passes, no shuffle of texts.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, sample))
    signs = np.array(["-", "0", "+"])

    def run(batches):
        m = model.value
        for batch in batches:
            for part in rows_of(batch):
                found = [describe(t) for t in part.column(1).to_pylist()]
                s = [round(score(f.trigrams, m.weights, m.bias), 6) for f in found]
                votes = ["".join(signs[f.votes + 1]) for f in found]
                posterior = [round(m.labels.posterior.get(_code(f.votes), 0.5), 6) for f in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(votes, pa.string()), pa.array(posterior, pa.float64()), pa.array(s, pa.float64()), pa.array([x >= keep for x in s], pa.bool_())], ["_id", "votes", "posterior", "score", "keep"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return rows.mapInArrow(run, f"_id {kind}, votes string, posterior double, score double, keep boolean").withColumnRenamed("_id", id_col)


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier keeps; it filters as it reads, without a join.

    Null and blank texts abstain, as in ``classify``; repeated rows are alike; an empty table gives an empty one.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col, text_col, sample))
    at = docs.columns.index(text_col)

    def run(batches):
        m = model.value
        for batch in batches:
            for part in rows_of(batch):
                good = [score(describe(t).trigrams, m.weights, m.bias) >= keep - 5e-7 for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
