"""Line dedup by a deletion-neighbourhood join: lines within one edit of an earlier line go.

Two lines are within one edit if deleting at most one character from each leaves equal strings.
Emitting every such variant of every line would multiply the corpus by its line length, so the
variants are made coarse to fine. Deleting a whole half, then a sixteenth of the line gives few
keys, and lines that share none with another line cannot share a finer one either; only the
blocks that survive get all their single-character variants. Nothing is lost on the way: the
one edit lies in some block, and all else is equal.

Every line with something in it takes part. Short ones go only if they are equal to an earlier one, by
their class alone, as one character makes another word or number of them; the variants are for lines
of ``NEAR_CHARS`` characters or more.

Equal lines are first reduced to one class, so a variant group holds only different lines, at most
one per character of the alphabet and position. In a group each line is compared with the earliest
member only: lines with the same character deleted at the same place are all within one edit of
each other, and an undeleted line is within one edit of all that lose a character to become it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwell.llm.common import Rolling, durable, join_small, mix64, release

MIN_CHARS = 1
NEAR_CHARS = 10
BLOCKS = 16


def normal(line: Column) -> Column:
    """What is compared: the line in lower case, without spaces at its ends."""
    return F.lower(F.trim(line))


def lines_of(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, uid, no, line) of the lines that take part: not blank, and ``min_chars`` characters or more once normalised."""
    lines = docs.select("id", "uid", F.posexplode(F.split("text", "\n")).alias("no", "raw"))
    return lines.select("id", "uid", "no", normal(F.col("raw")).alias("line")).where((F.length("line") >= min_chars) & F.col("line").rlike(r"\S"))


def digest(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("d1"), F.xxhash64(F.lit(7), line).alias("d2")]


def half_keys(line: Column) -> Column:
    """Keys of the line without its first or second half, for its own length and as the longer of a pair."""
    n = F.length(line)
    keys = []
    for half in (F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")):
        keys += [F.xxhash64(F.lit("head"), F.substr(line, F.lit(1), half)), F.xxhash64(F.lit("tail"), F.substr(line, n - half + 1, half))]
    return F.array_distinct(F.array(*keys))


def block_bounds(n: int, blocks: int) -> np.ndarray:
    return (np.arange(blocks + 1) * n) // blocks


def _units(line: str) -> np.ndarray:
    return mix64(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32))


def block_keys(line: str, blocks: int = BLOCKS) -> list[tuple[int, int, int]]:
    """(key, base length, block) of the line without each block, for its length and the length below."""
    roll, n = Rolling(_units(line)), len(line)
    out = []
    for base in (n, n - 1):
        cuts = block_bounds(base, blocks)
        zero = np.zeros(blocks, np.int64)
        head = roll.slices(zero, cuts[:-1])
        tail = roll.slices(n - (base - cuts[1:]), zero + n)
        keys = mix64(mix64(head, 1) ^ tail, 2) ^ mix64(np.arange(blocks) + np.int64(base) * 64, 3)
        out += [(int(k), base, j) for j, k in enumerate(keys.view(np.int64))]
    return out


def variants(line: str, base: int, block: int, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the line with one character of the block deleted; place -1: nothing deleted.

    A line of the base length can be changed or be the shorter of a pair; one that is longer by 1
    has lost a character to its partner, at any place, so its variants have place -2.
    """
    roll, n = Rolling(_units(line)), len(line)
    cuts = block_bounds(base, blocks)
    at = np.arange(cuts[block], cuts[block + 1] + (n > base), dtype=np.int64)
    at = at[at < n]
    after = (roll.sums[n] - roll.sums[at + 1]) * np.uint64(Rolling.INVERSE)
    hashes = mix64(roll.sums[at] + after, 4)
    if n > base:
        return hashes, np.full(len(at), -2, np.int64)
    return np.append(hashes, mix64(roll.sums[n : n + 1], 4)), np.append(at, -1)


def _emit_blocks(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            cls, key = [], []
            for c, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                for k, base, j in block_keys(line):
                    cls.append((c, k, base, j))
            cols = list(zip(*cls)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["cls", "key", "base", "block"])


def _emit_variants(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            cls, hashes, places = [], [], []
            for c, line, base, block in zip(*(part.column(i).to_pylist() for i in range(4))):
                h, p = variants(line, base, block)
                cls.append(np.full(len(h), c, np.int64))
                hashes.append(h.view(np.int64))
                places.append(p)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cat(cls)), pa.array(cat(hashes)), pa.array(cat(places).astype(np.int32))], ["cls", "hash", "place"])


def shared(keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key another row has too."""
    often = keys.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(on)
    return keys.join(often, on, "left_semi")


def near_lines(classes: DataFrame, lines: DataFrame) -> DataFrame:
    """(cls, d1, d2, near): classes with an earlier line within one edit; near is the class of that line.

    ``classes`` has cls (ordered as the first occurrences), d1, d2, halves; ``lines`` d1, d2, line.
    """
    maybe = durable(shared(classes.select("cls", F.explode("halves").alias("half")), "half").select("cls").distinct())
    few = classes.join(maybe, "cls", "left_semi").select("cls", "d1", "d2", "uid", "no")
    few = durable(few)
    text = join_small(lines.select("uid", "no", "d1", "d2", "line"), few.select("cls", "d1", "d2", "uid", "no"), ["d1", "d2", "uid", "no"]).select("cls", "line").dropDuplicates(["cls"])
    text = durable(text)
    blocks = text.mapInArrow(_emit_blocks, "cls long, key long, base int, block int")
    blocks = shared(blocks, "key").select("cls", "base", "block").distinct()
    small = blocks.join(text, "cls").select("cls", "line", "base", "block")
    v = small.mapInArrow(_emit_variants, "cls long, hash long, place int").distinct()
    # Earliest member by place, and earliest undeleted and shortened member of each variant.
    place = v.groupBy("hash", "place").agg(F.min("cls").alias("first"))
    whole = place.groupBy("hash").agg(F.min(F.when(F.col("place") == -1, F.col("first"))).alias("self_first"), F.min(F.when(F.col("place") == -2, F.col("first"))).alias("cut_first"))
    hits = v.join(place, ["hash", "place"]).join(whole, "hash")
    near = (
        F.when(F.col("place") >= 0, F.col("first"))
        .when(F.col("place") == -1, F.col("cut_first"))
        .otherwise(F.col("self_first"))
    )
    pairs = hits.select("cls", near.alias("near")).where("near < cls").distinct()
    # Verify the edit distance on the lines themselves.
    a, b = text.select(F.col("cls"), F.col("line").alias("a")), text.select(F.col("cls").alias("near"), F.col("line").alias("b"))
    checked = pairs.join(a, "cls").join(b, "near").where(F.levenshtein("a", "b", 1) >= 0)
    return checked.groupBy("cls").agg(F.min("near").alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, counts: bool = True, near_chars: int = NEAR_CHARS, edits: int = 1, keep_emptied: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` with repeated lines gone from the text, and with ``counts`` ``n_lines``, ``n_dropped`` (long).

    A line (between "\\n") goes if an earlier line is equal to it or, where both have ``near_chars`` characters
    or more, within one edit (one character changed, added or missing), both normalised: lower case, no spaces
    at the ends. Earlier means a smaller id (null first), then a smaller line number. Blank lines, and lines
    under ``min_chars`` characters, stay. A null text stays null with 0 lines, an empty one has 1 line. Rows that repeat an id and
    a text count as one row and stay equal. Extra columns pass through; internal names are kept apart. With ``counts`` the two new columns replace any
    of their names; without, all columns stay as they are. Without ``keep_emptied``, rows that lose all lines but blank ones
    go; blank texts stay. An empty table gives an empty result. ``edits`` must be 1: the keys are made for one edit, and other bounds are refused.
    """
    if edits != 1:
        raise ValueError("lines are compared within one edit")
    own = docs.select(F.struct(*[docs[c].alias(c) for c in docs.columns if c != text_col]).alias("row"), docs[id_col].alias("id"), docs[text_col].alias("text"))
    own = own.withColumn("uid", F.xxhash64("id", "text"))
    lines = lines_of(own.where("text IS NOT NULL"), min_chars).select("id", "uid", "no", "line", *digest(F.col("line")))
    halves = F.when(F.length("line") >= near_chars, half_keys(F.col("line")))
    # The length and halves depend on the line alone, so any row of the class gives them; short lines have none.
    found = lines.withColumn("halves", halves).groupBy("d1", "d2").agg(F.min(F.struct("id", "uid", "no")).alias("at"), F.count(F.lit(1)).alias("n"), *[F.max(F.get("halves", F.lit(i))).alias(f"h{i}") for i in range(4)])
    classes = found.select("d1", "d2", "at.id", "at.uid", "at.no", "n", F.array_compact(F.array("h0", "h1", "h2", "h3")).alias("halves"))
    classes = durable(number(classes))
    near = near_lines(classes, lines)
    near = durable(classes.select("cls", "d1", "d2").join(near, "cls").select("d1", "d2", F.lit(True).alias("near")))
    release(docs.sparkSession)
    # Only classes with several lines, or near an earlier one, drop anything.
    acting = classes.where("n > 1").select("d1", "d2", F.col("uid").alias("u0"), F.col("no").alias("n0")).join(near, ["d1", "d2"], "full")
    drops = lines.select("d1", "d2", "id", "uid", "no").join(acting, ["d1", "d2"])
    drops = drops.where(F.coalesce("near", F.lit(False)) | (F.col("uid") != F.col("u0")) | (F.col("no") != F.col("n0")))
    per_doc = drops.groupBy("uid", "id").agg(F.collect_set("no").alias("gone"))
    both = own.join(per_doc.withColumnRenamed("id", "i").withColumnRenamed("uid", "u"), (F.col("uid") == F.col("u")) & F.col("id").eqNullSafe(F.col("i")), "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept)
    if not keep_emptied:
        both = both.where(F.col("gone").isNull() | kept.rlike(r"\S"))
    fields = [F.col("row")[c].alias(c) if c != text_col else text.alias(c) for c in docs.columns if not counts or c not in ("n_lines", "n_dropped")]
    if not counts:
        return both.select(*fields)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    return both.select(*fields, n_lines.alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def number(classes: DataFrame) -> DataFrame:
    """Add ``cls``: numbers in the order of the first occurrences, from range partitions and their counts."""
    order = [F.col("id").asc_nulls_first(), F.col("uid"), F.col("no")]
    spread = durable(classes.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order))))
    sizes = spread.groupBy("part").agg(F.max("rank").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return spread.join(F.broadcast(sizes.select("part", "before")), "part").select("d1", "d2", "id", "uid", "no", "n", "halves", (F.col("before") + F.col("rank")).cast("long").alias("cls"))
