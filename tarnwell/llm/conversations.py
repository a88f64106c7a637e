"""Repair of conversations' structure, each distinct signature solved once.

A row's fault is the first that holds of: blank, duplicate (its role and text came earlier in the conversation), truncated. Repair makes the rows a
system row at most, then user and assistant in turn, by the cheapest of: Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate rows
must go), Insert an empty user or assistant row (3); truncated rows that stay cost 3 more. The audit is the edits' initials.

Rows are numbered in range partitions, so one conversation may span many tasks. Its rows become signatures of up to SEGMENT
characters, one for each row: its role's initial (x for other roles), upper case if truncated, or "-" if it must go. A signature is solved
for every pair of the states before and after it: nothing yet, after system, after user, after assistant. Solutions of two parts combine to that of the
whole, which gives a memoised recursion over halves and, in the end, joins the segments of long conversations.

Least costs come first and then ASCII-least audits. Two audits of the same rows and cost are never one the other's beginning, since
the longer one has a further Insert and so a higher cost; what follows therefore never changes which is less.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import durable, rows_of

SEGMENT_BITS = 12
#: Rows of a conversation that one signature holds at most.
SEGMENT = 1 << SEGMENT_BITS
BROADCAST_BYTES = 16 << 20

SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. A conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4

Best = tuple[int, str] | None
Solution = tuple[Best, ...]
"""The best (cost, audit) from each state to each, row by row; None where there is no way."""


def product(a: Solution, b: Solution) -> Solution:
    """What ``a`` and then ``b`` cost at best."""
    out: list[Best] = []
    for i in range(STATES):
        row = a[i * STATES : (i + 1) * STATES]
        for j in range(STATES):
            ways = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(row, b[j::STATES]) if x and y]
            out.append(min(ways) if ways else None)
    return tuple(out)


def _grid(ways: dict[tuple[int, int], tuple[int, str]]) -> Solution:
    return tuple(ways.get((i, j)) for i in range(STATES) for j in range(STATES))


_HERE = {(i, i): (0, "") for i in range(STATES)}
_TO = {(START, USER): 1, (SYSTEM, USER): 1, (USER, ASSISTANT): 1, (ASSISTANT, USER): 1, (START, ASSISTANT): 2, (SYSTEM, ASSISTANT): 2}
#: Inserts between two rows; more of them would lead back at a cost.
INSERTS = _grid(_HERE | {ways: (n * INSERT, "I" * n) for ways, n in _TO.items()})


@functools.cache
def _row(code: str) -> Solution:
    """One row and the inserts after it."""
    ways = {(i, i): (DELETE, "D") for i in range(STATES)}
    if code != "-":
        more, role = TRUNCATED * code.isupper(), code.lower()
        into = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
        for state, before in into.items():
            for i in before:
                ways[i, state] = (more, "K") if role == "ua"[state - USER] else (REROLE + more, "R")
        if role == "s":
            ways[START, SYSTEM] = (more, "K")
    return product(_grid(ways), INSERTS)


def _halves(signature: str) -> Solution:
    if len(signature) == 1:
        return _row(signature)
    middle = len(signature) // 2
    return product(_solved(signature[:middle]), _solved(signature[middle:]))


#: Short parts recur in many signatures; long ones are not kept.
_short = functools.lru_cache(maxsize=1 << 14)(_halves)


def _solved(signature: str) -> Solution:
    return _short(signature) if len(signature) <= 8 else _halves(signature)


def solve(signature: str) -> Solution:
    """The solution of a signature by recursion over halves. Inserts before its first row are left to what comes before."""
    return _solved(signature) if signature else _grid(_HERE)


def best_end(reached: list[Best]) -> tuple[int, str]:
    """The better of ending with nothing and after an assistant's row."""
    return min(x for x in (reached[START], reached[ASSISTANT]) if x)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults planted by CRC-32 of "conv_id:turn" modulo 20.

    0 drops a row, 1 empties its text, 2 takes ``.!?`` from it, 3 repeats it, 4 makes its role user. A null role or text, and a null in the key,
    is one space; null ids and turns stay null in the result.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    op = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), op.alias("_op")).where("_op <> 0")
    text = F.when(F.col("_op") == 1, "").when(F.col("_op") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("_op") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("_op") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_n")).drop("_n")




def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _rows(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, at, initial, fault) of every row, without its text, numbered in order across conversations by ``at``.

    A duplicate is a row whose digest of role and text has its first place earlier in the conversation. First places come from one aggregation, and only
    digests that repeat are joined back.
    """
    visible = F.rtrim(F.col("text"), F.lit(SPACE))
    first = F.substring("role", 1, 1)
    light = (
        # Beginnings of texts order as texts do, and bound what the driver samples to set the ranges.
        rows.repartitionByRange(F.col("conv_id").asc_nulls_first(), *_order()[:2], F.substring("text", 1, 64))
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *_order())
        .select(
            "conv_id", "turn", F.monotonically_increasing_id().alias("at"), F.when(first.isin("s", "u", "a"), first).otherwise("x").alias("initial"),
            (visible == "").alias("blank"), (~F.substring(visible, -1, 1).isin(".", "!", "?")).alias("cut"),
            F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("digest"),
        )
    )
    light = durable(light)
    again = light.where("NOT blank").groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("same")).agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = light.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("same")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("at") > F.col("first_at"), "duplicate").when(F.col("cut"), "truncated")
    return joined.select("conv_id", "turn", "at", "initial", fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """(conv_id, segment, signature, initials, ...): signatures of up to SEGMENT rows in order, with counts of faults and turns."""
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    gone = F.col("fault").isin("blank", "duplicate")
    code = F.when(gone, "-").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    # Numbers hold a partition above 33 bits and a place below, so a segment lies in one partition.
    own = rows.withColumn("segment", F.shiftright("at", SEGMENT_BITS)).groupBy("conv_id", "segment").agg(
        F.sort_array(F.collect_list(F.struct("at", code.alias("code"), "initial", "turn"))).alias("r"), count("blank"), count("duplicate"), count("truncated"),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    turns = F.size(F.array_distinct(F.filter("r.turn", lambda t: t.isNotNull()))).cast("long")
    return own.select("conv_id", "segment", F.array_join("r.code", "").alias("signature"), F.array_join("r.initial", "").alias("initials"), "blank", "duplicate", "truncated", "low", "high", turns.alias("turns"))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in rows_of(batch, 64):
            found = [solve(s) for s in part.column(0).to_pylist()]
            costs = [[x and x[0] for x in s] for s in found]
            audits = [[x and x[1] for x in s] for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))], ["solved", "costs", "audits"])


AUDIT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order to one row for each conversation."""
    legal = {"su", "ua", "au"}
    done: list[tuple] = []
    kinds: list[pa.Schema] = []

    class Open:
        def __init__(self, conv) -> None:
            self.conv, self.reached, self.counts = conv, list(INSERTS[:STATES]), [0, 0, 0, 0]
            self.low = self.high = self.last = None
            self.turns = 0

        def add(self, s: dict) -> None:
            initials = (self.last or "") + s["initials"]
            illegal = sum(1 for i in range(len(initials) - 1) if initials[i : i + 2] not in legal)
            self.last = initials[-1:]
            for k, n in enumerate((s["blank"], s["duplicate"], s["truncated"], illegal)):
                self.counts[k] += n
            if s["low"] is not None:
                # Turns ascend, so only the last one before and the first one here can be the same.
                self.turns += s["turns"] - (self.high == s["low"])
                self.low, self.high = s["low"] if self.low is None else self.low, s["high"]
            ways = [c is not None and (c, a) or None for c, a in zip(s["costs"], s["audits"])]
            now: list[Best] = []
            for j in range(STATES):
                both = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(self.reached, ways[j::STATES]) if x and y]
                now.append(min(both) if both else None)
            self.reached = now

        def row(self) -> tuple:
            cost, audit = best_end(self.reached)
            gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
            return (self.conv, gaps, *self.counts, cost, audit)

    def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [schema.field("conv_id").type, *[pa.int64()] * 6, pa.string()])], ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    now: Open | None = None
    for batch in batches:
        kinds[:] = [batch.schema]
        for part in rows_of(batch, 64):
            for s in part.to_pylist():
                if now is None or now.conv != s["conv_id"]:
                    if now is not None:
                        done.append(now.row())
                    now = Open(s["conv_id"])
                now.add(s)
                if len(done) >= 1024:
                    yield batch_of(done, batch.schema)
                    done = []
    if now is not None:
        yield batch_of([*done, now.row()], kinds[0])


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of every conversation that has rows.

    ``rows`` has conv_id, turn, role and text, in any order, and further columns are ignored. A null role or text is an empty one; a null id is a conversation of its own; null
    turns come first and count for no gap. Rows of one turn go by role and text, so repeats of a row lie side by side. Texts are
    hashed whole. An empty table gives an empty result. A conversation may hold most of all rows: it is cut into segments, and
    one task only ever joins the segments' solutions, in order, as a stream.
    """
    parts = durable(segments(coded(_rows(rows))))
    signatures = parts.select("signature").distinct()
    size = signatures.agg(F.sum(F.length("signature") + 8)).first()[0] or 0
    solved = signatures.mapInArrow(_solve, "solved string, costs array<long>, audits array<string>")
    # A solution has 16 audits of about its signature's length, so this bounds what is sent.
    small = F.broadcast(solved) if size * STATES * STATES <= BROADCAST_BYTES else solved
    joined = parts.join(small, F.col("signature") == F.col("solved")).drop("signature", "solved")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return joined.repartition("conv_id").sortWithinPartitions("conv_id", "segment").mapInArrow(_fold, AUDIT.format(kind))


class Edit(NamedTuple):
    place: int
    letter: str
    turn: int | None
    role: str
    text: str


def _edits(audit: str) -> Iterator[Edit | None]:
    """Replay an audit: send each row as (turn, role, text), and get edits until None, which asks for the next row. End with None."""
    place, turns, at = 0, 0, 0
    row = None
    while True:
        while at < len(audit) and audit[at] == "I":
            yield Edit(place, "I", None, ("user", "assistant")[turns % 2], "")
            place, turns, at = place + 1, turns + 1, at + 1
        row = yield None
        if row is None:
            return
        letter, at = audit[at], at + 1
        turn, role, text = row
        if letter != "D":
            system = letter == "K" and role[:1] == "s"
            yield Edit(place, letter, turn, role if letter == "K" else ("user", "assistant")[turns % 2], text)
            place, turns = place + 1, turns + (not system)


def _replay(emit):
    """Rows of a conversation after its audit, as a stream; ``emit`` makes batches of what it is told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, current, steps = emit(), object(), None
        for batch in batches:
            for part in rows_of(batch):
                for conv, kind, turn, role, text, head in zip(*[c.to_pylist() for c in part.columns]):
                    if conv != current:
                        if steps is not None:
                            out.close()
                        current = conv
                        steps = _edits((head or {}).get("audit") or "")
                        out.open(conv, head)
                        while (edit := next(steps)) is not None:
                            out.edit(edit)
                    if kind == 2:
                        edit = steps.send((turn, role, text))
                        while edit is not None:
                            out.edit(edit)
                            edit = next(steps)
                yield from out.batches(part.schema, False)
        if steps is not None:
            out.close()
        yield from out.batches(None, True)

    return run


class _Repaired:
    """Emits the repaired rows."""

    def __init__(self) -> None:
        self.rows, self.kind = [], None

    def open(self, conv, head) -> None:
        self.conv = conv

    def edit(self, e: Edit) -> None:
        self.rows.append((self.conv, *e))

    def close(self) -> None:
        pass

    def batches(self, schema, last) -> Iterator[pa.RecordBatch]:
        self.kind = schema.field(0).type if schema else self.kind
        if self.rows:
            types = [self.kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), types)], ["conv_id", "place", "edit", "turn", "role", "text"])
            self.rows = []


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Digests:
    """Emits one row for each conversation, with the digest of its repaired rows, which are hashed as they come."""

    def __init__(self) -> None:
        self.rows, self.kind = [], None

    def open(self, conv, head) -> None:
        self.conv, self.head, self.hash = conv, head or {}, hashlib.sha256()

    def edit(self, e: Edit) -> None:
        self.hash.update(f"{'' if e.place == 0 else chr(10)}{e.role}:{e.text}".encode("utf-8", "surrogatepass"))

    def close(self) -> None:
        self.rows.append((self.conv, *[self.head.get(c) or 0 for c in _COUNTS], self.head.get("audit") or "", self.hash.hexdigest()))

    def batches(self, schema, last) -> Iterator[pa.RecordBatch]:
        self.kind = schema.field(0).type if schema else self.kind
        if self.rows and (last or len(self.rows) >= 1024):
            types = [self.kind, *[pa.int64()] * len(_COUNTS), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows), types)], ["conv_id", *_COUNTS, "audit", "repaired_sha256"])
            self.rows = []


def _streams(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Each conversation's audit and then its rows, in order, in one partition."""
    found = audits(rows)
    head = F.struct(*[F.col(c) for c in found.columns if c != "conv_id"])
    kind = f"struct<{', '.join(f'{c}: long' for c in _COUNTS)}, audit: string>"
    none = F.lit(None)
    text = [none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text")]
    heads = found.select("conv_id", F.lit(0).alias("kind"), *text, head.cast(kind).alias("head"))
    own = _rows(rows).select("conv_id", F.lit(2).alias("kind"), "turn", "role", "text", none.cast(kind).alias("head"))
    every = heads.union(own)
    if ids is not None:
        every = every.union(ids.select("conv_id").distinct().select("conv_id", F.lit(1).alias("kind"), *text, none.cast(kind).alias("head")))
    return every.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_order())


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired conversations, ``place`` counting each one's rows from 0.

    ``edit`` is K, R or I; an inserted row has no turn and an empty text. Deleted rows are not there, and a conversation that loses all its rows
    isn't either. Nulls, ties, repeats and empty tables are as in ``audits``.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streams(rows, None).mapInArrow(_replay(_Repaired), f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def digests(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The columns of ``audits`` and ``repaired_sha256``, of the repaired "role:text" joined by line feeds.

    A conversation of ``ids`` without a row gets zeros, an empty audit and the digest of nothing. A digest reads its conversation
    from first to last, so that is one task's stream, in constant memory.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _streams(rows, ids).mapInArrow(_replay(_Digests), AUDIT.format(kind) + ", repaired_sha256 string")
