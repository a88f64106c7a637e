"""Secret scan: pattern matches, and sliding-window entropy over candidate strings.

Candidate strings are maximal runs of key-like characters. Each is put in one character class;
a window slides over it, its Shannon entropy is kept by adding the entering and removing the
leaving character's count, and windows at or above the class's threshold join into spans.
An allow list suppresses candidates that look random but are no secrets. Entropy spans are found
whether or not a pattern matches there too, and pattern matches always stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwell.llm.common import rows_of

KINDS = ("assign", "access", "hex", "ent_hex", "ent_base64", "ent_urlsafe", "ent_alnum")

# The contract's patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
_RUN = b"x" * 20
_RUNS = bytes(ord("x") if chr(i) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-" else ord(" ") for i in range(256))


class Window(NamedTuple):
    width: int
    bits: float


#: Window width and entropy threshold of each character class.
WINDOWS = {"ent_hex": Window(20, 3.0), "ent_base64": Window(20, 3.8), "ent_urlsafe": Window(20, 3.8), "ent_alnum": Window(20, 3.7)}

#: Candidates that any of these matches are suppressed.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUID
    r"^[^0-9]*$",  # words, paths and identifiers without digits
    r"^[0-9_+/=-]*$",  # numbers, dates
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|xxxx|0123456789|abcdefgh",
    r"^(?:[A-Za-z]+[-_/])*[A-Za-z]+[-_/]?[0-9]{1,4}$",  # slugs with a number
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def windows(run: str, width: int, bits: float) -> Iterator[tuple[int, int]]:
    """Unions of the windows whose entropy is at least ``bits``; counts change by one step each move."""
    n = len(run)
    if n < width:
        return
    weigh = [0.0] + [c * math.log2(c) for c in range(1, width + 1)]
    count: dict[str, int] = {}
    total = 0.0
    lo = hi = -1
    for i, ch in enumerate(run):
        if i >= width:
            old = run[i - width]
            c = count[old]
            total += weigh[c - 1] - weigh[c]
            count[old] = c - 1
        c = count.get(ch, 0)
        total += weigh[c + 1] - weigh[c]
        count[ch] = c + 1
        if i >= width - 1 and math.log2(width) - total / width >= bits - 1e-9:
            start = i - width + 1
            if lo >= 0 and start <= hi:
                hi = i + 1
            else:
                if lo >= 0:
                    yield lo, hi
                lo, hi = start, i + 1
    if lo >= 0:
        yield lo, hi


def class_of(run: str) -> str:
    body = run.rstrip("=")
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", body):
        return "ent_hex"
    if "+" in body or "/" in body or body != run:
        return "ent_base64"
    return "ent_urlsafe" if "_" in body or "-" in body else "ent_alnum"


def base_spans(text: str) -> list[Span]:
    low = text.lower()
    out = []
    if any(w in low for w in WORDS):
        out += [Span("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [Span("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_RUNS):
        out += [Span("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return out


def spans(text: str | None, allow: Iterable[re.Pattern] = tuple(map(re.compile, ALLOW)), limits: dict[str, Window] = WINDOWS) -> list[Span]:
    """All spans of a text by start, then kind in the order of KINDS. None and "" have none."""
    if not text:
        return []
    found = base_spans(text)
    if _RUN in text.encode("utf-8", "surrogatepass").translate(_RUNS):
        for m in CANDIDATE.finditer(text):
            run = m[0]
            if any(p.search(run) for p in allow):
                continue
            kind = class_of(run)
            for lo, hi in windows(run, *limits[kind]):
                found.append(Span(kind, m.start() + lo, m.start() + hi))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def digest(found: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: Iterable[str] = ALLOW) -> DataFrame:
    """One row per input row: the id and ``spans`` as an array of (kind, start, end, secret).

    Offsets are code points, the end is exclusive. A null or empty text has no spans; repeated rows
    are scanned alike; an empty table gives an empty result; other columns are ignored, so clashing names do no harm.
    One pass, no shuffle.
    """
    patterns = tuple(allow)

    def run(batches):
        compiled = tuple(map(re.compile, patterns))
        for batch in batches:
            for part in rows_of(batch):
                found = [
                    [{"kind": k, "start": a, "end": b, "secret": t[a:b]} for k, a, b in spans(t, compiled)]
                    for t in part.column(1).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, SPANS)], ["_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).mapInArrow(
        run, f"_id {kind}, spans array<struct<kind:string,start:int,end:int,secret:string>>"
    ).withColumnRenamed("_id", id_col)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("secret", pa.string())]))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
