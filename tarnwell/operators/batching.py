"""Greedy batches of ordered rows, in parallel.

Where a batch ends depends on where it began, so the batches of a long root seem to need one pass from its first row to its last. But all that crosses from one
range of rows to the next is how many rows the open batch holds and their size, and whatever comes in, the first batch that closes in a range
fixes the rest of it. So each range first tells the few states in which it can end, then where each state of the range before leads, a chain over ranges
picks the one that happens, and each range is cut into batches from there.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.sources.store import durable

State = tuple[int, int]
"""Rows and size of the open batch; no rows where a root begins."""


class Rule(NamedTuple):
    limit: int
    most: int | None
    base: int


class Run:
    """Rows of one root that follow each other: where a batch that starts at each of them closes, if it does."""

    def __init__(self, rule: Rule, size: np.ndarray, kids: np.ndarray) -> None:
        self.rule, self.n = rule, len(size)
        self.sums = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
        places = np.where(kids, self.n, np.arange(self.n))
        # From each place the next row that may close a batch.
        self.free = np.append(np.minimum.accumulate(places[::-1])[::-1], self.n)
        i = np.arange(self.n)
        self.close = self._close(i, self.sums[:-1] - rule.base, i, np.maximum)

    def _close(self, start, spent, first, larger):
        j = np.searchsorted(self.sums, self.rule.limit + spent, side="right") - 1
        if self.rule.most is not None:
            j = np.minimum(j, first + self.rule.most)
        return self.free[np.minimum(larger(j, start + 1), self.n)]

    def first_close(self, state: State) -> int:
        """The row that closes the batch that was open before; the first row opens one if there was none."""
        held, total = state
        return int(self._close(-1, -total, -held, max)) if held else 0

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """For a batch that starts at each row: the start of the last batch of the run, and how many close before it."""
        last, closed = np.arange(self.n), np.zeros(self.n, np.int64)
        to = self.close.tolist()
        for i in range(self.n - 1, -1, -1):
            if to[i] < self.n:
                last[i], closed[i] = last[to[i]], closed[to[i]] + 1
        return last, closed

    def state(self, start: int) -> State:
        return self.n - start, self.rule.base + int(self.sums[-1] - self.sums[start])

    def lead(self, state: State, ends: tuple[np.ndarray, np.ndarray]) -> tuple[State, int]:
        """The state after the run and how many batches closed in it."""
        c = self.first_close(state)
        if c >= self.n:
            return (state[0] + self.n, state[1] + int(self.sums[-1])), 0
        last, closed = ends
        return self.state(int(last[c])), int(closed[c]) + (state[0] > 0)


def _runs(rule: Rule, batches: Iterator[pa.RecordBatch]) -> tuple[int, list[tuple[str, Run]]]:
    """The partition's number, and its roots in order with their rows."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return -1, []
    table = pa.Table.from_batches(held)
    root = table.column("root").combine_chunks().dictionary_encode()
    code = root.indices.to_numpy(zero_copy_only=False) if root.null_count == 0 else np.nan_to_num(root.indices.to_numpy(zero_copy_only=False), nan=-1)
    size, kids = table.column("size").to_numpy(), table.column("kids").to_numpy()
    cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
    names = root.dictionary.to_pylist()
    out = [(None if code[lo] < 0 else names[int(code[lo])], Run(rule, size[lo:hi], kids[lo:hi])) for lo, hi in zip(cuts, cuts[1:])]
    return table.column("part")[0].as_py(), out


_LEADS = "part int, first string, last string, single boolean, held long, total long, to_held long, to_total long, closed long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), *[pa.int64()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split(" ")[0] for x in _LEADS.split(", ")])


def batches(candidates: DataFrame, root: str, order: str, size: str, has_children: str, limit: int, most: int | None = None, base: int = 0, tasks: int | None = None) -> DataFrame:
    """(root, order, batch): candidates of a scan root, in order, put into batches of at most ``limit``.

    A batch closes before a candidate that would pass the limit, or that would be number ``most`` + 1; a candidate with
    children never closes one. A single candidate over the limit is a batch of its own. Null sizes are 0. A root may span many of the ``tasks`` ranges
    (by default as many as a shuffle has). The driver gets, for each range, the states that it can end in: at most as many as its last batch can hold rows.
    """
    text = candidates.schema[order].dataType.simpleString()
    rule = Rule(limit, most, base)
    rows = candidates.select(F.col(root).cast("string").alias("root"), F.col(order).alias("at"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"), F.coalesce(F.col(has_children), F.lit(False)).alias("kids"))
    keys = [F.col("root").asc_nulls_first(), F.col("at").asc_nulls_first()]
    spread = rows.repartitionByRange(tasks, *keys) if tasks else rows.repartitionByRange(*keys)
    spread = durable(spread.sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id()))

    def can_end(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, runs = _runs(rule, parts)
        if runs:
            run = runs[-1][1]
            last, _ = run.ends()
            # A later root of the range begins in it; the range's only root may be open at any of its rows.
            starts = np.unique(last) if len(runs) == 1 else last[:1]
            yield _rows([(part, runs[0][0], runs[-1][0], len(runs) == 1, 0, 0, *run.state(int(i)), 0) for i in starts])

    told = spread.mapInArrow(can_end, _LEADS).collect()
    ranges = {r.part: r for r in told}
    before = dict(zip(sorted(ranges)[1:], sorted(ranges)))
    goes_on = {p: q for p, q in before.items() if ranges[p].first == ranges[q].last}
    known: dict[int, dict[State, tuple[State, int]]] = {p: {} for p in ranges}
    open_ = {p: {(0, 0)} if p not in goes_on else {(r.to_held, r.to_total) for r in told if r.part == goes_on[p]} for p in ranges}
    spark = candidates.sparkSession
    # A second round is only needed where a batch spans a whole range, as its state then is a new one to the range after.
    while any(open_.values()):
        asked = spark.sparkContext.broadcast({p: sorted(s) for p, s in open_.items() if s})

        def lead(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, runs = _runs(rule, parts)
            states = asked.value.get(part)
            if not runs or not states:
                return
            first, ends = runs[0][1], runs[0][1].ends()
            # Later roots begin in the range, so they end in one state; only the first takes up what was open.
            rest = runs[-1][1].lead((0, 0), runs[-1][1].ends()) if len(runs) > 1 else None
            out = [(part, runs[0][0], runs[-1][0], len(runs) == 1, *s, *to, closed) for s in states for to, closed in [rest or first.lead(s, ends)]]
            yield _rows(out)

        for r in spread.mapInArrow(lead, _LEADS).collect():
            known[r.part][r.held, r.total] = (r.to_held, r.to_total), r.closed
        open_ = {p: {to for to, _ in known[q].values()} - set(known[p]) for p, q in goes_on.items()}

    # The chain: the state and the number of the batch with which each range begins.
    begin: dict[int, tuple[str | None, int, int, int]] = {}
    state, batch, name = (0, 0), 0, None
    for p in sorted(ranges):
        if p not in goes_on:
            state, batch = (0, 0), 0
        begin[p] = (ranges[p].first, batch, *state)
        state, closed = known[p][state]
        batch = batch + closed if ranges[p].single else closed
    sent = spark.sparkContext.broadcast(begin)

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = sent
        batch = held = total = 0
        for part in parts:
            out = []
            for i, (r, n, kids) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist())):
                n = max(0, n)
                if now is sent:
                    now, batch, held, total = sent.value[part.column(4)[i].as_py()]
                if r != now or not held:
                    batch, held, total = (0 if r != now else batch), 0, base
                    now = r
                if held and not kids and (total + n > limit or most is not None and held >= most):
                    batch, held, total = batch + 1, 0, base
                held, total = held + 1, total + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.int64())], ["root", "at", "batch"])

    return spread.mapInArrow(fold, f"root string, at {text}, batch long").withColumnsRenamed({"root": root, "at": order})
