"""MinHash near-dedup (operator 2): an LSH forest of sorted signature orders.

A document's set is its distinct 5-word shingles. Documents with equal sets are one class (two hashes of the whole set,
128 bits, have to be equal), and only classes are compared. Each of TREES orders sorts the classes by DEPTH of their MinHash values; neighbours in an order that share
the first LEAST values or more (their longest common prefix) are candidates. Candidates are linked if the full sets
overlap enough. Links give components, whose smallest doc_id stays.

In an order, everything between two classes shares at least their common prefix. So neighbours join up groups of
copies without all their pairs; what they leave apart in one region of an order (the first LEAST values) is looked at
again on full sets, every pair of classes that isn't of one component: a region of few classes in one block, a larger
one cut into cells, with a block for any two of its cells that hold sets of sizes near enough to be linked.

Nulls and odd rows: a text without words has an empty set and is linked with nothing (its component is its own
doc_id); a text of fewer words has one shingle, all its words; a null doc_id never names a component (component_id
is null if a whole component has none) and counts as kept only there; repeated rows are copies of each other; an
empty table gives no rows; extra columns are ignored. Whole texts are read, and shingles are compared as 64-bit
hashes of their words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, words
from .components import components

SHINGLE = 5
HASHES = 64
TREES, DEPTH, LEAST = 16, 8, 4
#: Link if PERCENT * union <= 100 * intersection: op2's contract, and the pipeline's threshold.
PERCENT, PIPELINE_PERCENT = 85, 80
#: A block holds about so many classes; larger regions are cut into cells of half as many, compared two by two.
REGION = 512
_RNG = np.random.default_rng(2)
_MULTIPLY = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)
REGION_BYTES, KEY_BYTES = 1 + 4 * LEAST, 1 + 4 * DEPTH


def sets(data: np.ndarray, off: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each document, ascending, one document after another."""
    low = words.LOWER[data]
    starts, ends, first = words.spans(low, off)
    h = words.hashes(low, starts, ends)
    w = words.windows(h, shingle)
    parts, size = [], np.zeros(len(off), np.int64)
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= shingle:
            own = np.sort(w[a : b - shingle + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = words.mix(words.windows(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            own = w[:0]
        parts.append(own)
        size[d + 1] = len(own)
    return (np.concatenate(parts) if parts else w[:0]), np.cumsum(size)


SIGNED = "doc_id long, row long, text_hash long, n_shingles long, node long, check long, signature binary"


def signed(docs: DataFrame, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """SIGNED for every row: node and check are order-free hashes of the set, signature its MinHash values."""
    common.ship(docs.sparkSession)
    schema = common.fields(SIGNED)

    def run(batches):
        for b in common.slices(batches, "text"):
            h, first = sets(*common.arrow_bytes(b.column("text")), shingle)
            n = np.diff(first)
            some = np.flatnonzero(n)
            at = first[:-1][some]
            node, check = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            least = np.zeros((len(some), HASHES), ">u4")
            if len(some):
                node[some] = words.mix(np.add.reduceat(words.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + n[some].astype(np.uint64))
                check[some] = np.add.reduceat(words.mix(h ^ np.uint64(0x14057B7EF767814F)), at)
                for k in range(HASHES):
                    least[:, k] = np.minimum.reduceat((h ^ _FLIP[k]) * _MULTIPLY[k], at) >> np.uint64(32)
            values = np.full(len(n), None, object)
            for i, row in zip(some.tolist(), least, strict=True):
                values[i] = row.tobytes()
            yield common.batch(schema, doc_id=b.column("doc_id"), row=b.column("row"), text_hash=b.column("text_hash"), n_shingles=n, node=node.view(np.int64), check=check.view(np.int64), signature=pa.array(values, pa.binary()))

    number = F.col(f"`{row}`").cast("long") if row else F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("row"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, SIGNED)


ORDERED = "edge int, part int, key binary, node long, other long"


def forest(classes: DataFrame) -> DataFrame:
    """ORDERED: the rows of all orders whose region (tree and first LEAST values) holds another row; other is the neighbour before, if in the region.

    Rows are dealt by range over the whole order, so that a large region is spread over tasks; the first and last
    row of each part (edge 1, 2) come out too, for neighbours across parts.
    """
    spark = classes.sparkSession
    doubled = F.concat(F.col("signature"), F.expr(f"substring(signature, 1, {4 * DEPTH})"))
    rows = classes.select("node", doubled.alias("s")).select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "s")
    keyed = rows.select(F.expr(f"concat(unhex(lpad(hex(t), 2, '0')), substring(s, 1 + t * {4 * HASHES // TREES}, {4 * DEPTH}))").alias("key"), "node")
    dealt = keyed.repartitionByRange(common.buckets(spark), "key", "node").sortWithinPartitions("key", "node")
    schema = common.fields(ORDERED)

    def run(batches):
        part = TaskContext.get().partitionId()
        last: tuple[np.ndarray, np.ndarray] | None = None  # the row before, not yet given out
        open_ = False  # that row has a neighbour before it
        before = 0

        def out(key, node, other, has, edge):
            return common.batch(schema, edge=edge, part=np.full(len(node), part), key=[k.tobytes() for k in key], node=node, other=pa.array(other, mask=~has))

        for b in batches:
            if not b.num_rows:
                continue
            key = np.frombuffer(b.column("key").cast(pa.large_binary()).buffers()[2], np.uint8)
            col = b.column("key")
            begin = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)[0]
            key = key[begin : begin + len(col) * KEY_BYTES].reshape(-1, KEY_BYTES)
            node = b.column("node").to_numpy()
            start = last is None
            if last is not None:
                key, node = np.concatenate([last[0], key]), np.concatenate([last[1], node])
            same = (key[1:, :REGION_BYTES] == key[:-1, :REGION_BYTES]).all(axis=1)
            has = np.append(False if start else open_, same)
            other = np.append(before, node[:-1])
            mate = has[:-1] | same
            edge = np.zeros(len(node), np.int64)
            if start:
                edge[0] = 1
                mate = np.append(True, mate[1:]) if len(mate) else mate
            give = np.flatnonzero(mate)
            if len(give):
                yield out(key[give], node[give], other[give], has[give], edge[give])
            last, open_, before = (key[-1:].copy(), node[-1:].copy()), bool(has[-1]), int(other[-1])
            first_alone = start and len(node) == 1
        if last is not None:
            yield out(last[0], last[1], np.array([before]), np.array([open_]), np.array([3 if first_alone else 2]))

    return dealt.mapInArrow(run, ORDERED)


def across(rows: DataFrame) -> list[tuple[int, int]]:
    """Neighbours on either side of a cut between parts: two rows for each part come to the driver."""
    ends = sorted(((r["part"], r["edge"] == 2, r["edge"], bytes(r["key"]), r["node"]) for r in rows.where("edge > 0").collect()))
    out, last = [], None
    for _, _, edge, key, node in ends:
        if edge in (1, 3) and last and last[0][:REGION_BYTES] == key[:REGION_BYTES]:
            out.append((last[1], node))
        if edge in (2, 3):
            last = (key, node)
    return out


def ordered_pair(a, b):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def overlapping(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """Of pairs (u, v), those whose full sets have percent * union <= 100 * intersection. texts: (node, text)."""
    schema = common.fields("u long, v long")

    def run(batches):
        known: tuple | None = None
        for b in common.slices(batches, "b"):
            ids = list(zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True))
            fresh = [i for i, (u, _) in enumerate(ids) if i == 0 or u != ids[i - 1][0]]
            if known and known[0] == ids[0][0]:
                fresh = fresh[1:]
            ha, fa = sets(*common.arrow_bytes(b.column("a").take(pa.array(fresh, pa.int64()))), shingle)
            hb, fb = sets(*common.arrow_bytes(b.column("b")), shingle)
            us, vs, k = [], [], -1
            for i, (u, v) in enumerate(ids):
                if k + 1 < len(fresh) and fresh[k + 1] == i:
                    k += 1
                    known = (u, ha[fa[k] : fa[k + 1]])
                x, y = known[1], hb[fb[i] : fb[i + 1]]
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    continue
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[at] == y).sum())
                if 100 * both >= percent * (len(x) + len(y) - both):
                    us.append(u)
                    vs.append(v)
            known = (known[0], known[1].copy())
            yield common.batch(schema, u=us, v=vs)

    b = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")
    rows = b.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").select("u", "a", "v", "b")
    return rows.mapInArrow(run, "u long, v long")


def unsettled(orders: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(region, node, root, n) of the regions of up to REGION classes, and of the larger ones, that are not all one component yet.

    Regions of two were settled as neighbours. Sizes come from aggregates and meet the rows in joins, so that no
    region has to fit in one task. The first table is written.
    """
    rows = orders.select(F.substring("key", 1, REGION_BYTES).alias("region"), "node").distinct().join(roots, "node", "left").select("region", "node", F.coalesce("root", "node").alias("root"))
    rows = common.written(rows, "members")
    sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("n > 2 and low <> high")
    open_ = common.written(common.hot_join(rows, sizes.select("region", "n"), "region", "n", rows.count()), "regions")
    common.drop(rows)
    return open_, open_.where(F.col("n") > REGION)


def crossed(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(block, side, node, root): blocks that hold, between them, every pair of classes of a region that can still be linked.

    Classes outside the region's largest component meet each other and that component's. Sets a link can join have
    sizes in one level or in levels side by side (a level is a little wider than the ratio percent allows). Cells are
    parts of a level by hash; each two cells that have to meet are a block, with the classes of one on side 0 and
    of the other on side 1; a cell's own pairs are a block with no side 1.
    """
    spans = F.floor(F.log(F.col("n_shingles").cast("double")) / math.log(100 / percent) / 1.0001) if percent < 100 else F.col("n_shingles")
    tally = rows.groupBy("region", "root").count()
    main = tally.groupBy("region").agg(F.max(F.struct("count", "root")).alias("m"), F.sum("count").alias("members")).select("region", "members", F.col("m.root").alias("main"))
    told = common.hot_join(rows, main, "region", "members", rows.count())
    sized = common.written(told.join(classes.select("node", spans.cast("long").alias("level")), "node").select("region", "node", "root", "level", (F.col("root") == F.col("main")).cast("int").alias("major")), "cells")
    parts = sized.groupBy("region", "level", "major").agg(F.ceil(F.count(F.lit(1)) / (REGION // 2)).alias("parts"))
    cells = parts.select("region", "level", "major", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    one = cells.where("major = 0").select("region", *[F.col(c).alias(f"{c}_0") for c in ("level", "major", "part")])
    two = cells.select("region", *[F.col(c).alias(f"{c}_1") for c in ("level", "major", "part")])
    meet = one.join(two, "region").where("abs(level_0 - level_1) <= 1 and (major_1 = 1 or level_0 < level_1 or level_0 = level_1 and part_0 <= part_1)")
    meet = meet.withColumn("block", F.concat("region", *[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("level_0", "part_0", "level_1", "part_1", "major_1")]))
    own = (F.col("major_1") == 0) & (F.col("level_0") == F.col("level_1")) & (F.col("part_0") == F.col("part_1"))
    ends = meet.select("region", "block", F.lit(0).alias("side"), F.col("level_0").alias("level"), F.col("major_0").alias("major"), F.col("part_0").alias("part"))
    ends = ends.unionByName(meet.where(~own).select("region", "block", F.lit(1).alias("side"), F.col("level_1").alias("level"), F.col("major_1").alias("major"), F.col("part_1").alias("part")))
    placed = sized.join(parts, ["region", "level", "major"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    out = ends.join(placed, ["region", "level", "major", "part"]).select("block", "side", "node", "root")
    out.place = sized.place
    return out


def cross_links(node: np.ndarray, root: np.ndarray, side: np.ndarray, h: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between components that the full sets of one block show, side 0 against side 1, or side 0 in itself.

    Overlaps are counted exactly: shingles that many hold by matrix products of 0 and 1, the others by their holders.
    """
    names, comp = np.unique(root, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.diff(first)
    a = np.flatnonzero(side == 0)
    b = np.flatnonzero(side == 1) if (side == 1).any() else a
    place = np.zeros(len(node), np.int64)
    place[a], place[b] = np.arange(len(a)), np.arange(len(b))
    _, at = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(len(node)), size)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]

    def held(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        member = np.zeros(len(node), bool)
        member[rows] = True
        keep = member[owner]
        return at[keep], place[owner[keep]], np.bincount(at[keep], minlength=int(at[-1]) + 1 if len(at) else 0)

    (ida, pa_, na), (idb, pb, nb) = held(a), held(b)
    both = np.zeros((len(a), len(b)), np.int64)
    many = np.flatnonzero(na * nb > 64)
    for k in range(0, len(many), 2048):
        some = many[k : k + 2048]
        mats = []
        for ids, places, n in ((ida, pa_, len(a)), (idb, pb, len(b))):
            x = np.searchsorted(some, ids)
            hit = some[np.minimum(x, len(some) - 1)] == ids
            m = np.zeros((n, len(some)), np.float32)
            m[places[hit], x[hit]] = 1
            mats.append(m)
        both += np.rint(mats[0] @ mats[1].T).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(nb)])
    few = (na[ida] * nb[ida] <= 64) & (nb[ida] > 0)
    ids, left = ida[few], pa_[few]
    if len(ids):
        n = nb[ids]
        right = pb[np.repeat(begin[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        both += np.bincount(np.repeat(left, n) * len(b) + right, minlength=len(a) * len(b)).reshape(len(a), len(b))
    linked = (100 * both >= percent * (size[a][:, None] + size[b][None, :] - both)) & (comp[a][:, None] != comp[b][None, :])
    out = []
    for i, j in np.argwhere(linked).tolist():
        x, y = find(int(comp[a[i]])), find(int(comp[b[j]]))
        if x != y:
            parent[x] = y
            out.append((int(node[a[i]]), int(node[b[j]])))
    return out


def block_links(node: np.ndarray, root: np.ndarray, h: np.ndarray, first: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the components of one block that its full sets show: one for each pair of components joined."""
    names, comp = np.unique(root, return_inverse=True)
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.diff(first)
    shingle, at = np.unique(h, return_inverse=True)
    owner = np.repeat(np.arange(len(node)), size)
    order = np.argsort(at, kind="stable")
    holders, begin = owner[order], np.searchsorted(at[order], np.arange(len(shingle) + 1))
    out = []
    largest = np.bincount(comp).argmax()
    for i in np.flatnonzero(comp != largest).tolist():
        mine = at[first[i] : first[i + 1]]
        count = begin[mine + 1] - begin[mine]
        keep = count > 1
        if not keep.any():
            continue
        a, n = begin[mine[keep]], count[keep]
        place = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        both = np.bincount(holders[place], minlength=len(node))
        for j in np.flatnonzero(100 * both >= percent * (size[i] + size - both)).tolist():
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                parent[x] = y
                out.append((int(node[i]), int(node[j])))
    return out


def settled(blocks: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(u, v): links between components within blocks, from full sets. A block has at most about REGION texts.

    side: null for a block that is compared as a whole (block_links), else as cross_links has it.
    """
    schema = common.fields("u long, v long")
    rows = blocks.join(texts, "node").select("block", "side", "node", "root", "text")
    dealt = rows.repartition(common.buckets(blocks.sparkSession), "block").sortWithinPartitions("block")

    def run(batches):
        now, held = None, []

        def out():
            parts = [sets(*common.arrow_bytes(b.column("text")), shingle) for b in held]
            h = np.concatenate([x for x, _ in parts])
            first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
            node, root = (np.concatenate([b.column(k).to_numpy() for b in held]) for k in ("node", "root"))
            side = np.concatenate([b.column("side").fill_null(-1).to_numpy() for b in held])
            links = block_links(node, root, h, first, percent) if side[0] < 0 else cross_links(node, root, side, h, first, percent)
            return common.batch(schema, u=[u for u, _ in links], v=[v for _, v in links])

        for b in common.slices(batches, "text"):
            names = b.column("block").to_pylist()
            at = 0
            while at < len(names):
                to = at
                while to < len(names) and names[to] == names[at]:
                    to += 1
                if names[at] != now and held:
                    yield out()
                    held = []
                now = names[at]
                held.append(b.slice(at, to - at))
                at = to
        if held:
            yield out()

    return dealt.mapInArrow(run, "u long, v long")


def apart(rows: DataFrame) -> DataFrame:
    """SIGNED rows whose sets differ never share a node: nodes that two values of check share are told apart by both."""
    while True:
        clash = rows.where("n_shingles > 0").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high").select("node", F.lit(True).alias("clash"))
        clash = common.written(clash, "clashes")
        if clash.isEmpty():
            common.drop(clash)
            return rows
        node = F.when(F.col("clash") & (F.col("n_shingles") > 0), F.xxhash64("node", "check")).otherwise(F.col("node"))
        rows = common.written(rows.join(clash, "node", "left").withColumn("node", node).drop("clash"), "signed")


def near_dup(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, row: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    row: a column that numbers the rows; it comes back with the row that stands for the component, as `winner`.
    """
    spark = docs.sparkSession
    rows = apart(common.written(signed(docs, shingle, row), "signed"))
    # the smallest doc_id, its first row; nulls come last
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "text_hash")
    classes = common.written(rows.where("n_shingles > 0").groupBy("node").agg(F.min(who).alias("label"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")).select("node", "label", "n_shingles", F.col("label.doc_id").alias("doc_id"), F.col("label.text_hash").alias("text_hash"), "signature"), "classes")
    orders = common.written(forest(classes), "orders")
    extra = spark.createDataFrame(across(orders), "u long, v long")
    pairs = orders.where("other is not null").select(*ordered_pair(F.col("node"), F.col("other"))).unionByName(extra.select(*ordered_pair(F.col("u"), F.col("v")))).where("u <> v").distinct()
    pairs = common.written(pairs, "pairs")
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    asked = classes.join(nodes, "node").select("node", "doc_id", "text_hash")
    whole = common.picked(docs, doc_id="long", text="string").withColumn("text_hash", F.xxhash64("text"))
    texts = common.written(asked.join(whole, asked["doc_id"].eqNullSafe(whole["doc_id"]) & (asked["text_hash"] == whole["text_hash"])).select("node", "text").dropDuplicates(["node"]), "texts")
    roots = common.written(components(overlapping(pairs, texts, percent, shingle)), "roots")
    regions, large = unsettled(orders, roots)
    cross = crossed(large, classes, percent)
    blocks = regions.where(F.col("n") <= REGION).select(F.col("region").alias("block"), F.lit(None).cast("int").alias("side"), "node", "root").unionByName(cross)
    more = common.written(settled(blocks, texts, percent, shingle), "links")
    # the new links join components: whole components take the place of their classes
    up = roots.select(F.col("node").alias("u"), F.col("root").alias("a"))
    joined = more.join(up, "u", "left").withColumn("a", F.coalesce("a", "u")).join(up.select(F.col("u").alias("v"), F.col("a").alias("b")), "v", "left").withColumn("b", F.coalesce("b", "v"))
    over = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    named = classes.select("node", "label").join(roots, "node", "left").select("node", "label", F.coalesce("root", "node").alias("root")).join(over, "root", "left")
    named = common.written(named.select("node", "label", F.coalesce("top", "root").alias("root")), "named")
    for t in (classes, orders, pairs, texts, roots, more, regions, cross):
        common.drop(t)
    least = named.groupBy("root").agg(F.min("label").alias("least"))
    final = named.join(least, "root").select("node", "least")
    some = F.col("n_shingles") > 0
    out = rows.join(final, "node", "left").select("doc_id", "n_shingles", F.when(some, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", F.when(some, F.col("least.row")).otherwise(F.col("row")).alias("winner"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", *(["row", "winner"] if row else []))


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_dup(common.table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str, percent: int = PERCENT) -> DataFrame:
    """One row of each group, that of the smallest doc_id, with all its columns.

    Rows are known by their place on file, so that every reading knows the same ones.
    """
    docs = common.on_file(docs)
    file, row, name = (common.unused(docs, k) for k in ("file_key", "file_row", "row_number"))
    numbered = common.located(docs, file, row).withColumn(name, F.xxhash64(file, row)).drop(file, row)
    judged = near_dup(numbered, percent, row=name)
    gone = judged.where("row <> winner").select(F.col("row").alias(name), F.col("doc_id").alias(f"{name}_of"))
    return numbered.join(gone, (numbered[name] == gone[name]) & F.col("doc_id").cast("long").eqNullSafe(gone[f"{name}_of"]), "left_anti").drop(name)


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stage at the pipeline's own threshold."""
    return stage(spark, docs, sf_dir, PIPELINE_PERCENT)


QUERIES = {"op2_near_dup": op2_near_dup}
