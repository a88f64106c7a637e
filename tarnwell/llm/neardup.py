"""MinHash near-dedup with an LSH forest.

A signature has 128 values of 16 bits. An order sorts all documents by a sequence of these values; in it,
documents lie beside those with which they share the longest prefix. The first round has 16 orders of
8 values. Each order is sorted once, by range partitions, and one scan finds the length of the common
prefix of neighbours and from it, for each document, its region: the longest run of neighbours with at least
DEPTH_MIN common values, or one value more for as long as the run has more than REGION documents. So crowded
parts of an order are searched at a greater depth, and runs that cross partitions are joined by their counts.
Within a region signatures are compared over all values, and those that agree in at least LOOSE of
them are joined to candidate groups, which are confirmed on the full shingle sets.

Copies with equal shingle sets are one class from the start. A pair at the threshold of 0.8 misses
all 16 orders at three values with a probability of (1 - 0.8**3)**16 = 1e-5, and falls below LOOSE by chance with
one of 1e-7. A greater depth finds such a pair less often. So documents whose regions were cut so
deep that a pair may be missed with more than MISS go through further rounds of 32 other orders of up to 16 values,
until the product of their chances is below MISS. A cut costs nothing where all documents of the
region are in one candidate group already, as large families of near copies are.

The full check covers every pair within a candidate group. Groups of more than GROUP different documents are dealt by size
classes, as a pair at the threshold has nearly equal sizes, and checked in pairs of blocks of the same or adjoining classes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import Rolling, durable, groups, join_small, mix64, phase, release, rows_of
from tarnwell.llm.components import components, hot_from, with_value

VALUES = 128
#: Orders and values of the first round, least depth of a region.
ORDERS, DEPTH, DEPTH_MIN = 16, 8, 3
#: Orders and values of each further round for crowded documents, and the chance that ends them. At full depth a round takes at least
#: a factor of (1 - 0.8**16)**32 = 0.4 from the chance, so there are at most eleven.
MORE, DEEP, MISS = 32, 16, 1e-4
SIMILAR = 0.8
REGION = 1024
LOOSE = 0.60
GROUP = 1024

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 31, VALUES, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, VALUES, dtype=np.uint32)


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word ``width``-grams; of all words if there are fewer; empty without words.

    Words are runs of characters other than space and U+0009 to U+000D, A-Z lower-cased.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = np.frombuffer(b" ".join(words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - (sizes - 1)
    k = min(width, len(words))
    return np.unique(mix64(Rolling(joined).slices(starts[: len(words) - k + 1], ends[k - 1 :])))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(low), 1024):
        np.minimum(out, (low[lo : lo + 1024, None] * _A + _B).min(axis=0), out=out)
    # Minima are small, so their low half is mixed in before 16 bits are kept.
    out = (out ^ (out >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return (out >> np.uint32(16)).astype(">u2")


def _sketch(width):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                n, d1, d2, sig = [], [], [], []
                for text in part.column(1).to_pylist():
                    h = shingles(text, width)
                    n.append(len(h))
                    d1.append(int(mix64(h, 11).sum(dtype=np.uint64).astype(np.int64)))
                    d2.append(int(np.bitwise_xor.reduce(mix64(h, 12)).astype(np.int64)) if len(h) else 0)
                    sig.append(signature(h).tobytes() if len(h) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary()), part.column(2)], ["id", "n", "d1", "d2", "sig", "text_hash"])

    return run


def _forest(batches):
    """Edges (a, b) that span the groups of a region whose signatures agree in at least LOOSE of all values."""
    for _, region in groups(batches, "region"):
        ids = region.column("rep").to_numpy()
        if len(ids) < 2:
            continue
        sigs = np.frombuffer(b"".join(region.column("sig").to_pylist()), np.uint16).reshape(len(ids), -1)
        open_, out = np.arange(len(ids)), []
        need = LOOSE * sigs.shape[1]
        while len(open_) > 1:
            root, open_, edge = open_[0], open_[1:], [open_[0]]
            while edge and len(open_):
                x = edge.pop()
                hit = (sigs[open_] == sigs[x]).sum(axis=1) >= need
                edge += list(open_[hit])
                out += [(ids[root], ids[y]) for y in open_[hit]]
                open_ = open_[~hit]
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _exact(width, num, den):
    """Edges (a, b) that span the exactly linked groups of a block of full texts."""

    def run(batches):
        for _, block in groups(batches, "block"):
            ids = block.column("rep").to_numpy()
            order = np.argsort(ids)
            ids = ids[order]
            keep = np.append(True, ids[1:] != ids[:-1])
            ids, order = ids[keep], order[keep]
            texts = block.column("text")
            sets = [shingles(texts[int(i)].as_py(), width) for i in order]
            size = np.array([len(s) for s in sets], np.int64)
            _, flat = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)
            cuts = np.append(0, np.cumsum(size))
            of = [flat[cuts[i] : cuts[i + 1]] for i in range(len(sets))]
            open_, out = np.arange(len(ids)), []
            elems, at = flat, cuts[:-1]
            while len(open_) > 1:
                root, edge = open_[0], [open_[0]]
                open_ = open_[1:]
                elems, at = _pack(of, open_)
                while edge and len(open_):
                    x = edge.pop()
                    mark[of[x]] = True
                    common = np.add.reduceat(mark[elems], at, dtype=np.int64)
                    mark[of[x]] = False
                    hit = den * common >= num * (size[open_] + size[x] - common)
                    if hit.any():
                        edge += list(open_[hit])
                        out += [(ids[root], ids[y]) for y in open_[hit]]
                        open_ = open_[~hit]
                        if len(open_):
                            elems, at = _pack(of, open_)
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _pack(of: list[np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(which):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts = [of[i] for i in which]
    return np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts[:-1]])).astype(np.int64)


def orders(number: int) -> np.ndarray:
    """The places of the signature by which each order of a round sorts: all dealt out first, then other choices by seed."""
    if number == 0:
        return np.arange(VALUES).reshape(ORDERS, DEPTH)
    rng = np.random.default_rng([20240301, number])
    return np.stack([rng.permutation(VALUES)[:DEEP] for _ in range(MORE)])


def _keys(places: np.ndarray):
    """(key, rep): in each order, the order's number and the values in turn, as bytes that sort alike."""

    def run(batches):
        for batch in batches:
            for part in rows_of(batch, 2000):
                rep = part.column(0).to_numpy()
                sigs = np.frombuffer(b"".join(part.column(1).to_pylist()), ">u2").reshape(len(rep), VALUES)
                keys = np.empty((len(rep), len(places), 1 + places.shape[1]), ">u2")
                keys[:, :, 0] = np.arange(len(places))
                keys[:, :, 1:] = sigs[:, places]
                flat = pa.Array.from_buffers(pa.binary(2 * keys.shape[2]), len(rep) * len(places), [None, pa.py_buffer(keys.tobytes())])
                yield pa.RecordBatch.from_arrays([flat.cast(pa.binary()), pa.array(np.repeat(rep, len(places)))], ["key", "rep"])

    return run


def _fixed(column: pa.BinaryArray) -> np.ndarray:
    """Binary values of equal length as rows of 16-bit numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(">u2").reshape(len(column), -1)


class Run:
    """A partition of an order, sorted: reps, common prefixes of neighbours, and an id for each prefix of each key."""

    def __init__(self, batches, seed: int) -> None:
        parts = [b for b in batches if b.num_rows]
        self.reps = np.concatenate([b.column(1).to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
        keys = np.concatenate([_fixed(b.column(0)) for b in parts]) if parts else np.zeros((0, 1), ">u2")
        self.lcp = np.logical_and.accumulate(keys[1:] == keys[:-1], axis=1).sum(axis=1) - 1
        self.ids = np.empty(keys.shape, np.int64)
        at = mix64(keys[:, 0], seed)
        for d in range(1, keys.shape[1]):
            at = mix64(at ^ keys[:, d].astype(np.uint64), d)
            self.ids[:, d] = at.view(np.int64)

    def bounds(self, depth: int) -> np.ndarray:
        """Where runs with ``depth`` common values begin, and the end."""
        return np.concatenate([[0], np.flatnonzero(self.lcp < depth) + 1, [len(self.reps)]])


def _borders(seed: int, depths: range):
    """(region, n): members of the first and last run of each partition at each depth, as these may go on in others."""

    def run(batches):
        order = Run(batches, seed)
        if not len(order.reps):
            return
        found = []
        for d in depths:
            at = order.bounds(d)
            found += [(order.ids[at[i], d], at[i + 1] - at[i]) for i in {0, len(at) - 2}]
        region, n = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(region, pa.int64()), pa.array(n, pa.int64())], ["region", "n"])

    return run


def _place(seed: int, depths: range, most: int, crossing: dict[int, int]):
    """(rep, region, members, depth, top): each document's region, its size and depth, and the region at the least depth.

    Documents alone at the least depth are left out.
    """

    def run(batches):
        order = Run(batches, seed)
        n = len(order.reps)
        if not n:
            return
        region, members, depth, left = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int32), np.ones(n, bool)
        for d in depths:
            at = order.bounds(d)
            size = np.diff(at)
            total = size.copy()
            for i in (0, len(size) - 1):
                total[i] = crossing.get(int(order.ids[at[i], d]), size[i])
            total = np.repeat(total, size)
            fits = left & ((total <= most) | (d == depths[-1]))
            region[fits], members[fits], depth[fits] = order.ids[fits, d], total[fits], d
            left &= ~fits
        show = (members > 1) | (depth > depths[0])
        yield pa.RecordBatch.from_arrays([pa.array(x[show]) for x in (order.reps, region, members, depth, order.ids[:, depths[0]])], ["rep", "region", "members", "depth", "top"])

    return run


def place(classes: DataFrame, number: int) -> DataFrame:
    """(rep, region, members, depth, top) of all orders of a round; see ``_place``."""
    places = orders(number)
    keyed = classes.select("rep", "sig").mapInArrow(_keys(places), "key binary, rep long")
    in_order = durable(keyed.repartitionByRange("key", "rep").sortWithinPartitions("key", "rep"))
    depths, seed = range(DEPTH_MIN, places.shape[1] + 1), 100 + number
    borders = in_order.mapInArrow(_borders(seed, depths), "region long, n long")
    # At most two rows a depth and partition.
    crossing = borders.groupBy("region").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts > 1").collect()
    return durable(in_order.mapInArrow(_place(seed, depths, REGION, {r.region: r.n for r in crossing}), "rep long, region long, members long, depth int, top long"))


def regions(placed: DataFrame) -> DataFrame:
    """(rep, region): regions of two documents or more; those too large at full depth are dealt out, with the first document in each part."""
    fits = placed.where((F.col("members") > 1) & (F.col("members") <= REGION)).select("rep", "region")
    large = placed.where(F.col("members") > REGION)
    parts = F.ceil(F.col("members") / REGION).cast("int")
    own = large.select("rep", F.xxhash64("region", F.pmod(F.xxhash64("rep"), parts).cast("int")).alias("region"))
    first = large.groupBy("region", "members").agg(F.min("rep").alias("rep")).select("rep", "region", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return fits.union(own).union(first.select("rep", F.xxhash64("region", "part").alias("region"))).distinct()


def mixed(rows: DataFrame, by: str, loose: DataFrame) -> DataFrame:
    """The rows, with a rep, whose region holds documents of different candidate groups; there is nothing to find in others."""
    rooted = rows.select("rep", by).join(loose.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    several = rooted.groupBy(by).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select(by)
    return rows.join(several, by, "left_semi")


def crowded(placed: DataFrame, before: DataFrame | None, loose: DataFrame, number: int) -> DataFrame:
    """(rep, miss): documents for which the rounds so far may miss a pair with more than MISS; miss is the logarithm of the chance."""
    chance = lambda d: F.log(1 - F.pow(F.lit(SIMILAR), d))
    lost = mixed(placed.where(F.col("depth") > DEPTH_MIN), "top", loose).groupBy("rep").agg(F.sum(chance(F.col("depth")) - chance(F.lit(DEPTH_MIN))).alias("lost"))
    if before is not None:
        lost = before.join(lost, "rep", "left")
    else:
        lost = lost.withColumn("miss", F.lit(0.0))
    miss = F.col("miss") + len(orders(number)) * chance(F.lit(DEPTH_MIN)) + F.coalesce("lost", F.lit(0.0))
    return lost.select("rep", miss.alias("miss")).where(F.col("miss") > float(np.log(MISS)))


def candidates(classes: DataFrame) -> DataFrame:
    """(node, root): candidate groups of classes, which have rep and sig; classes alone have no row, and roots none for themselves."""
    with phase(classes.sparkSession):
        return durable(_candidates(classes), stay=True)


def _candidates(classes: DataFrame) -> DataFrame:
    now, before, edges, loose = classes, None, None, None
    number = 0
    while True:
        placed = place(now, number)
        inside = regions(placed)
        if loose is not None:
            inside = mixed(inside, "region", loose)
        inside = inside.join(now.select("rep", "sig"), "rep")
        new = inside.repartition("region").sortWithinPartitions("region").mapInArrow(_forest, "a long, b long").distinct()
        if edges is None:
            edges = durable(new)
            loose = components(edges)
        else:
            new = durable(new.join(edges, ["a", "b"], "left_anti"))
            if not new.isEmpty():
                edges = edges.union(new)
                loose = components(edges)
        inside = new = None  # they hold what their jobs shuffled
        release(edges.sparkSession)
        if placed.where(F.col("depth") > DEPTH_MIN).isEmpty():
            return loose
        before = durable(crowded(placed, before, loose, number))
        if before.isEmpty():
            return loose
        now = durable(classes.join(before.select("rep"), "rep", "left_semi"))
        number += 1


def dealt(classes: DataFrame, loose: DataFrame, num: int, den: int) -> DataFrame:
    """(rep, blocks): the blocks in which a class of a candidate group is compared with others; every possible pair meets in one.

    Sizes of a linked pair differ by a factor of den / num at most, so by one size class.
    """
    member = loose.select(F.col("node").alias("rep"), "root").union(loose.select(F.col("root").alias("rep"), "root").distinct())
    step = float(np.log(den / num) + 1e-6) if den > num else 1e-6
    member = durable(member.join(classes.select("rep", "n"), "rep").withColumn("class", F.floor(F.log("n") / step).cast("int")))
    large = member.groupBy("root").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > GROUP).select("root")
    k = large.count()
    small = join_small(member, large, "root", "left_anti", k).select("rep", F.array(F.xxhash64("root")).alias("blocks"))
    if not k:
        return small
    large = join_small(member, large, "root", rows=k)
    half = max(1, GROUP // 2)
    count = large.groupBy("root", "class").agg(F.ceil(F.count(F.lit(1)) / half).cast("int").alias("k"))
    near = large.join(count, ["root", "class"])
    for name, off in (("below", 1), ("above", -1)):
        near = near.join(count.select("root", (F.col("class") + off).alias("class"), F.col("k").alias(name)), ["root", "class"], "left")
    mine = F.pmod(F.xxhash64("rep"), F.col("k")).cast("int")
    key = lambda c, i, j, step: F.xxhash64("root", c, i, j, F.lit(step))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    own = F.transform(upto("k"), lambda j: key(F.col("class"), F.least(mine, j), F.greatest(mine, j), 0))
    up = F.transform(upto("above"), lambda j: key(F.col("class"), mine, j, 1))
    down = F.transform(upto("below"), lambda j: key(F.col("class") - 1, j, mine, 1))
    return small.union(near.select("rep", F.concat(own, up, down).alias("blocks")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, num: int = 80, den: int = 100, text_hash: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Documents are linked if den * |A & B| >= num * |A | B| on the distinct word ``width``-grams. The
    component is the smallest id reachable; one row of each, with that id, is kept. Texts without words
    (null, empty, white space) are linked with nothing and kept. A null id has no component and is kept.
    Rows that repeat an id and a text are one document; rows of one id with different texts are different documents, each
    in the component of its own text. An empty table gives an empty result. Other columns are ignored, whatever their names.
    With ``text_hash`` the hash of each row's text follows, which tells rows of one id apart. With ``only``, a table of ids,
    all other rows are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("text_hash"))
    sketches = rows.mapInArrow(_sketch(width), "id long, n long, d1 long, d2 long, sig binary, text_hash long")
    if only is not None:
        sketches = sketches.join(only.select(only.columns[0]).toDF("id"), "id", "left_semi")
    sketches = durable(sketches)
    linked = sketches.where("n > 0 AND id IS NOT NULL")
    # A class is its digest; its number stands for it everywhere, and one of its rows gives the text.
    classes = linked.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "text_hash")).alias("at"), F.first("sig").alias("sig"))
    classes = durable(classes.select("d1", "d2", "n", "at.id", "at.text_hash", "sig", F.monotonically_increasing_id().alias("rep")))
    release(docs.sparkSession)
    loose = candidates(classes)
    blocks = durable(dealt(classes, loose, num, den).join(classes.select("rep", "id", "text_hash"), "rep"))
    texts = join_small(rows.where("text IS NOT NULL"), blocks, ["id", "text_hash"]).select("rep", "text", F.explode("blocks").alias("block"))
    exact = texts.repartition("block").sortWithinPartitions("block").mapInArrow(_exact(width, num, den), "a long, b long")
    exact = components(exact)
    texts = None
    release(docs.sparkSession)
    # The smallest id of each component, for its classes.
    found = exact.select("root", F.col("node").alias("rep")).union(exact.select("root", F.col("root").alias("rep")).distinct())
    found = durable(found.join(classes.select("rep", "id"), "rep"))
    least = found.groupBy(F.col("root").alias("node")).agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    labels = with_value(found.select(F.col("root").alias("a"), F.col("rep").alias("b")), least, hot_from(found.count()))
    labels = labels.select(F.col("b").alias("rep"), F.col("m").alias("component")).join(classes.select("rep", "d1", "d2", "n"), "rep").drop("rep")
    # A class outside of any component has the smallest id of its rows.
    labels = classes.select("d1", "d2", "n", "id").join(labels, ["d1", "d2", "n"], "left").select("d1", "d2", "n", F.coalesce("component", "id").alias("component"))
    more = ["text_hash"] if text_hash else []
    both = sketches.select("id", "n", "d1", "d2", *more).join(labels, ["d1", "d2", "n"], "left")
    component = F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id"))
    return both.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), component.cast(kind).alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"), *more)
