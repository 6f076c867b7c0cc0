"""N-gram Jaccard join by count-vector R-trees.

A document's set holds its distinct word shingles (64-bit hashes); equal sets form
one node (named by a 64-bit digest), so exact copies cost one row each.  Two nodes
link when ``100 * |A & B| >= percent * |A | B|``.

*Blocks.*  All shingles have one order over the whole corpus: by how often their hash's
bucket occurs (counted over all documents), then by hash.  A set
of n needs an overlap of ``percent * n / 100`` at least, so of a linked pair's sets
each has the first k common shingles among its first ``n - needed + k``: nodes that
share such a leading shingle meet in a block.  ``k`` grows with n (``shared``), and a node that
shares fewer of its leading shingles than a linked one must is linked with nothing and
leaves.  No pair is missed, and a passage that many documents share comes last in their
order and brings no two together.

*Points.*  A node's counts over ``GROUPS`` groups of its hashes are a point.  In each
block the points are packed in an R-tree; the overlap of two sets is at most the sum of
their coordinates' minima, and that of a set and a box at most the sum with the
box's upper corner, so whole boxes are skipped.  Pairs it leaves are bounded again by
saturating counts over one to two cells a shingle (two bits each).

*Verification.*  Surviving pairs are compared on the whole sets.  First only those
blocks are used that are some node's largest or smallest, and each row goes with the one
row before it that its bound is best with, so a family of thousands of near copies costs
rows, not pairs.  After components are known, in every block the rows outside its
largest component meet the rows of others, in parts of bounded size.  A pair is
tried in one block only, that of the least of its nodes' common first keys, so no
link between components is lost and none is tried over and over.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from citemill.llm.common import arrow_map, arrow_schema, bounded_batches, dropped, fresh, give_back, record_batch, stored

GROUPS, LEAF = 32, 16
#: Buckets of hashes that corpus counts are kept for (a number each on the driver), and keys that tell where a pair is tried.
BUCKETS, FIRST_KEYS = 1 << 18, 8
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; of the whole sequence if it is shorter."""
    import xxhash

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and the six ASCII white spaces only
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ (h >> np.uint64(32))) * _M1 + w[i : len(w) - k + 1 + i]
    return np.unique(_mix(h))


def overlap_needed(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: ceil(percent * (a + b) / (100 + percent))."""
    return -(-(a + b) * percent // (100 + percent))


def bucket_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def shared(n):
    """Leading shingles that linked sets of n or more share at least."""
    return 1 + n // 40


def least_size(n, percent: int):
    return -(-n * percent // 100)


def leading(h: np.ndarray, percent: int, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the corpus's order: linked sets share ``shared`` of
    the smaller one's size among them."""
    n = len(h)
    return h[np.argsort(rank[bucket_of(h)], kind="stable")[: n - least_size(n, percent) + shared(n)]].view(np.int64)


def bucket_counts(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """How many documents' shingles fall in each bucket: one vector a task, summed by bucket."""
    schema = arrow_schema("bucket int, c bigint")

    def count(batches):
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for t in batch.column(0):
                np.add.at(total, bucket_of(shingles(t.as_py(), width)), 1)
        some = np.flatnonzero(total)
        yield record_batch(schema, [some, total[some]])
        give_back()

    found = docs.select(F.col(text).cast("string")).mapInArrow(count, "bucket int, c bigint").groupBy("bucket").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[found.column("bucket").to_numpy()] = found.column("c").to_numpy()
    return out.astype(np.uint32 if out.max(initial=0) < 1 << 32 else np.int64)


def node_of(h: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes(), 7)).view(np.int64))


class RTree:
    """Points packed by size, boxes of LEAF entries up to one root."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        self.levels = []  # (upper corners, least sizes), leaves first
        hi, lo = points, sizes
        while len(hi) > 1:
            cuts = np.arange(0, len(hi), LEAF)
            hi, lo = np.maximum.reduceat(hi, cuts, axis=0), np.minimum.reduceat(lo, cuts)
            self.levels.append((hi, lo))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Indices whose bound on the overlap reaches what a link needs."""
        at = np.array([0])
        for hi, lo in reversed(self.levels):
            at = at[at < len(hi)]
            ok = np.minimum(hi[at], point).sum(axis=1) >= overlap_needed(lo[at], size, percent)
            at = (at[ok][:, None] * LEAF + np.arange(LEAF)).reshape(-1)
        at = at[at < len(self.points)]
        return at[np.minimum(self.points[at], point).sum(axis=1) >= overlap_needed(self.sizes[at], size, percent)]


def _runs(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _blocks(batches, out, most: int = 200_000):
    """Sorted (key, node) rows -> (block, node, key, null) of each key with several nodes, where keys with the same
    nodes give one block under the least of them, and (block, null, null, keys) with the number of its keys."""
    seen: dict[int, int] = {}
    tail_k, tail_v = np.empty(0, np.int64), np.empty(0, np.int64)

    def counted():
        if seen:
            n = len(seen)
            yield record_batch(out, [list(seen), [None] * n, [None] * n, list(seen.values())])
            seen.clear()

    def closed(k, v):
        starts = _runs(k)
        ends = np.append(starts[1:], len(k))
        blocks, nodes, keys = [], [], []
        for i in np.flatnonzero(ends - starts > 1):
            run = v[starts[i] : ends[i]]
            if run[0] != run[-1]:  # sorted: else copies of one node
                run = run[_runs(run)]
                block = int(np.add.reduce(_mix(run.view(np.uint64))).view(np.int64))
                if block not in seen:
                    blocks.append(np.full(len(run), block))
                    nodes.append(run)
                    keys.append(np.full(len(run), k[starts[i]]))
                seen[block] = seen.get(block, 0) + 1
        if blocks:
            rows = [np.concatenate(x) for x in (blocks, nodes, keys)]
            yield record_batch(out, [*rows, [None] * len(rows[0])])

    for batch in batches:
        k = np.concatenate([tail_k, batch.column(0).to_numpy()])
        v = np.concatenate([tail_v, batch.column(1).to_numpy()])
        if not len(k):
            continue
        cut = int(np.searchsorted(k, k[-1]))
        tail_k, tail_v = k[cut:], v[cut:]
        if len(tail_v) > 1:  # an open run: copies of a node need not wait
            keep = _runs(tail_v)
            tail_k, tail_v = tail_k[keep], tail_v[keep]
        if cut:
            yield from closed(k[:cut], v[:cut])
        if len(seen) > most:
            yield from counted()
    if len(tail_k):
        yield from closed(tail_k, tail_v)
    yield from counted()
    give_back()


def _held_together(found: DataFrame, sizes: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """(block, node, key) without the nodes that share too few leading shingles to be linked, and without blocks
    that are left with one node.  More rounds would drop more, never a linked node."""
    made = [found]
    members = found.where("node is not null").groupBy("block", "node").agg(F.min("key").alias("key"))
    keys = found.where("node is null").groupBy("block").agg(F.sum("keys").alias("keys"))
    least = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / 40)
    for _ in range(rounds):
        enough = members.join(keys, "block").groupBy("node").agg(F.sum("keys").alias("s")).join(sizes, "node").where(F.col("s") >= least)
        members = members.join(enough.select("node"), "node", "left_semi")
        several = members.groupBy("block").agg(F.count("*").alias("k")).where("k > 1").select("block")
        members = stored(members.join(several, "block", "left_semi"), found.count())
        made.append(members)
    dropped(*made[:-1])
    return members


def cells_of(h: np.ndarray) -> bytes:
    """Counts up to three over one to two cells a shingle, four cells to a byte."""
    m = 1 << max(5, len(h).bit_length())
    c = np.minimum(np.bincount(((h >> np.uint64(8)) & np.uint64(m - 1)).astype(np.int64), minlength=m), 3).astype(np.uint8)
    return (c[0::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def _cells(packed: np.ndarray) -> np.ndarray:
    return np.stack([packed >> k & 3 for k in (0, 2, 4, 6)], axis=-1).reshape(*packed.shape[:-1], -1)


def _fold(cells: np.ndarray, m: int) -> np.ndarray:
    """Cells over m groups from more of them (groups are low bits)."""
    return np.minimum(cells.reshape(*cells.shape[:-1], -1, m).sum(axis=-2, dtype=np.int32), 3)


#: For two bytes of cells, by how much the first one's exceed the second's.
_EXCESS = np.maximum(_cells(np.arange(256, dtype=np.uint8)[:, None])[:, None, :].astype(np.int8) - _cells(np.arange(256, dtype=np.uint8)[:, None]).astype(np.int8), 0).sum(axis=2).astype(np.uint8)


def cells_bound(n: int, a: bytes, sizes: np.ndarray, others: list[bytes]) -> np.ndarray:
    """Bounds on the overlap of a set of n with others: where one has more in a cell, so many
    of its shingles the other lacks, however saturated the cells."""
    out, mine = np.empty(len(others), dtype=np.int64), np.frombuffer(a, np.uint8)
    by_size: dict[int, list[int]] = {}
    for i, b in enumerate(others):
        by_size.setdefault(len(b), []).append(i)
    for size, at in by_size.items():
        theirs = np.frombuffer(b"".join([others[i] for i in at]), np.uint8).reshape(len(at), size)
        if size == len(mine):
            lacks, more = _EXCESS[mine, theirs].sum(axis=1, dtype=np.int64), _EXCESS[theirs, mine].sum(axis=1, dtype=np.int64)
        else:
            m = 4 * min(size, len(mine))
            x, y = _fold(_cells(mine), m), _fold(_cells(theirs), m)
            lacks, more = np.maximum(x - y, 0).sum(axis=1), np.maximum(y - x, 0).sum(axis=1)
        out[at] = np.minimum(n - lacks, sizes[at] - more)
    return out


def _segments(batches, columns: int, most: int):
    """Lists of columns, each of one group (equal first column) or, if it is larger, of ``most`` of
    its rows; with them whether the group starts and ends there."""
    held, starts, last = None, True, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_pylist() for i in range(columns)]
        if held is None:
            starts = cols[0][0] != last
        held = cols if held is None else [x + y for x, y in zip(held, cols)]
        at, last = 0, held[0][-1]
        keys = np.array(held[0], dtype=np.int64)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for cut in cuts.tolist():
            yield [c[at:cut] for c in held], starts, True
            at, starts = cut, True
        if len(keys) - at >= most:
            yield [c[at:] for c in held], starts, False
            at, starts = len(keys), False
        held = [c[at:] for c in held] if at < len(keys) else None
    if held is not None and held[0]:
        yield held, starts, True


def point_of(h: np.ndarray) -> bytes:
    """Counts over GROUPS groups, of a byte each where they fit, else of four."""
    counts = np.bincount((h & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else "<i4").tobytes()


def _points(point: list[bytes]) -> np.ndarray:
    if all(len(p) == GROUPS for p in point):
        return np.frombuffer(b"".join(point), np.uint8).reshape(len(point), GROUPS).astype(np.int32)
    return np.stack([np.frombuffer(p, np.uint8 if len(p) == GROUPS else "<i4").astype(np.int32) for p in point])


class _Block:
    """Rows of one block (or part): their R-tree, and what both bounds leave for a row."""

    def __init__(self, n: list, node: list, point: list, cells: list, percent: int):
        self.n, self.node, self.points, self.cells, self.percent = np.array(n, dtype=np.int64), np.array(node, dtype=np.int64), _points(point), cells, percent

    def tree(self, stop: int) -> RTree:
        return RTree(self.points[:stop], self.n[:stop])

    def left(self, i: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows ``near`` those that may link with row i, and their bounds."""
        if not len(near):
            return near, near
        bound = cells_bound(int(self.n[i]), self.cells[i], self.n[near], [self.cells[j] for j in near.tolist()])
        ok = bound >= overlap_needed(self.n[near], int(self.n[i]), self.percent)
        return near[ok], bound[ok]


def _pairs(schema, a: list, b: list):
    x, y = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
    return record_batch(schema, [np.minimum(x, y), np.maximum(x, y)])


def _first_pairs(percent: int, schema, most: int = 1_024):
    """Rows (block, n, node, point, cells) sorted by block, n, node -> for each row the pair with the one before it,
    among up to ``most``, whose overlap may be the largest part of what a link needs."""

    def run(batches):
        a, b, last = [], [], None
        for (_, *cols), starts, _ in _segments(batches, 5, most):
            # a segment that goes on with a block begins with the row the last one was most tied to
            if not starts and last is not None:
                cols = [[x, *c] for x, c in zip(last, cols)]
            block = _Block(*cols, percent)
            tree, tied = block.tree(len(block.n)), np.zeros(len(block.n), dtype=np.int64)
            for i in range(1, len(block.n)):
                near = tree.near(block.points[i], int(block.n[i]), percent)
                near, bound = block.left(i, near[near < i])
                if len(near):
                    j = int(near[np.argmax(bound / overlap_needed(block.n[near], int(block.n[i]), percent))])
                    tied[j] += 1
                    a.append(block.node[i])
                    b.append(block.node[j])
            c = int(tied.argmax())
            last = [x[c] for x in cols]
            if len(a) > 20_000:
                yield _pairs(schema, a, b)
                a, b = [], []
        yield _pairs(schema, a, b)
        give_back()

    return run


def _between_pairs(percent: int, schema):
    """Rows (part, kind, n, node, point, cells, comp, key, keys) sorted by part, kind, n, node -> pairs of a stray
    (kind 2) and a row of another component (kind 0, or 1 where it is a stray as well) that both
    bounds leave and whose least common key among their first is the block's, or that have none."""

    def run(batches):
        a, b = [], []
        for (_, kind, n, node, point, cells, comp, key, keys), _, _ in _segments(batches, 9, 1 << 30):
            rows = len(kind) - kind.count(2)
            if not rows or rows == len(kind):
                continue
            block, comps, stray = _Block(n, node, point, cells, percent), np.array(comp, dtype=np.int64), np.array(kind) == 1
            tree = block.tree(rows)
            firsts = [np.frombuffer(k, np.int64) for k in keys]
            for i in range(rows, len(kind)):
                near = tree.near(block.points[i], int(block.n[i]), percent)
                near = near[(comps[near] != comps[i]) & (~stray[near] | (block.node[near] > block.node[i]))]
                for j in block.left(i, near)[0].tolist():
                    common = np.intersect1d(firsts[i], firsts[j], assume_unique=True)
                    if not len(common) or common[0] == key[i]:
                        a.append(block.node[i])
                        b.append(block.node[j])
            if len(a) > 20_000:
                yield _pairs(schema, a, b)
                a, b = [], []
        yield _pairs(schema, a, b)
        give_back()

    return run


def _by_bytes(rows, column, most: int = 1 << 22):
    """The column's values at ``rows`` in lists of about ``most`` characters at most (or one value)."""
    held, size = [], 0
    for i in rows:
        t = column[int(i)].as_py()
        if held and size + len(t or "") > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def _id_bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap in which each id's hash is set (bits / 32 integers at most reach the driver)."""
    pos = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(pos.alias("p")).groupBy((F.col("p") / 32).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int, width: int, key: str, text: str, most_bits: int = 1 << 28) -> DataFrame:
    """Pairs (a, b) whose whole sets reach the similarity.  Only documents that stand
    for a node of some pair are read again: a bitmap of their ids, or a join beyond ``most_bits``, tells most others
    apart, and the join by node the rest."""
    spark = docs.sparkSession
    most = 2 * pairs.count()
    nodes = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct(), most)
    ids = stored(sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")).select("id").distinct(), most)
    schema, wanted = arrow_schema("node bigint, h binary"), ids.count()
    bits = 1 << max(16, (16 * wanted).bit_length())
    sent = spark.sparkContext.broadcast(_id_bitmap(ids, bits)) if bits <= most_bits else None

    def read(batches):
        bitmap = None if sent is None else sent.value
        for batch in batches:
            pos = batch.column(0).to_numpy()
            hit = range(len(pos)) if bitmap is None else np.flatnonzero(bitmap[pos >> 5] >> (pos & 31).astype(np.uint32) & np.uint32(1))
            for part in _by_bytes(hit, batch.column(1)):
                found = [h for t in part if len(h := shingles(t, width))]
                yield record_batch(schema, [[node_of(h) for h in found], [h.tobytes() for h in found]])

    rows = docs.where(F.col(key).isNotNull())
    if sent is None:  # too many for a bitmap that all tasks hold: texts meet their ids in a shuffle
        rows = rows.join(ids.withColumnRenamed("id", key), key, "left_semi")
    rows = rows.select(F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).alias("p"), F.col(text).cast("string").alias("t"))
    # a file holds some hundred sets
    full = stored(rows.mapInArrow(read, "node bigint, h binary").join(nodes, "node", "left_semi").repartition(max(1, -(-wanted // 400))))
    full = full.dropDuplicates(["node"])
    both = pairs.join(full.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(full.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    out = arrow_schema("a bigint, b bigint")

    def compare(batches):
        for batch in batches:
            a, b = [], []
            for x, y, hx, hy in zip(*(batch.column(i) for i in range(4))):
                p, q = np.frombuffer(hx.as_buffer(), np.uint64), np.frombuffer(hy.as_buffer(), np.uint64)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * common >= percent * (len(p) + len(q) - common):
                    a.append(x.as_py())
                    b.append(y.as_py())
            yield record_batch(out, [a, b])
        give_back()

    return both.select("a", "b", "ha", "hb").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of all linked nodes, root the component's least node: alternating
    large-star and small-star steps, each stored in the shared folder.  Raises if
    ``rounds`` of them don't settle the edges."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), links.count())
    last = None
    for _ in range(rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not mark[0] or mark == last:
            break
        last = mark
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges whose larger end is the centre come back by the step from their smaller end
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, stored(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), 2 * mark[0])
        dropped(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def join_classes(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85, most_rows: int = 8_192) -> DataFrame:
    """One row per document: key, n_shingles, component_id, the least key reachable by links.

    Null or wordless text has an empty set and is linked with nothing.  Rows that
    repeat a key and text belong together like any equal texts; rows without a
    key get the component of an equal text that has one, else null.  Very long texts are compared
    whole; an empty table gives an empty result; other columns are ignored.
    """
    placed = _placed(docs, key=key, text=text, width=width, percent=percent, most_rows=most_rows)
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _placed(docs: DataFrame, *, key: str, text: str, width: int = 4, percent: int = 85, most_rows: int = 8_192) -> DataFrame:
    """``join_classes`` as (id, digest, n, component_id, kept): digest is of the text, and
    kept that of the text which stands for the component, null where there is none."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(bucket_counts(docs, text, width))

    def describe(cols):
        out = {"id": cols["id"], "digest": cols["digest"], "n": [], "node": [], "point": [], "cells": [], "keys": [], "firsts": []}
        for t in cols["t"]:
            h = shingles(t, width)
            keys = leading(h, percent, ranks.value) if len(h) else None
            out["n"].append(len(h))
            out["node"].append(node_of(h) if len(h) else None)
            out["point"].append(point_of(h) if len(h) else None)
            out["cells"].append(cells_of(h) if len(h) else None)
            out["keys"].append(keys)
            out["firsts"].append(np.sort(keys)[:FIRST_KEYS].tobytes() if len(h) else None)
        return out

    base = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"), _digest(text).alias("digest"))
    sets = stored(arrow_map(base, describe, f"id {kind}, digest bigint, n bigint, node bigint, point binary, cells binary, keys array<bigint>, firsts binary"))

    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8)
    keyed = sets.where("node is not null and id is not null").select(F.explode("keys").alias("key"), "node")
    block_ddl = "block bigint, node bigint, key bigint, keys bigint"
    block_schema = arrow_schema(block_ddl)
    found = stored(keyed.repartition(spread, "key").sortWithinPartitions("key", "node").mapInArrow(lambda batches: _blocks(batches, block_schema), block_ddl))
    blocks = _held_together(found, sets.where("id is not null").select("node", "n").distinct(), percent)
    pair_schema = arrow_schema("a bigint, b bigint")

    # first the blocks that are some node's largest or smallest, which join up most components
    sized = blocks.join(blocks.groupBy("block").agg(F.count("*").alias("k")), "block")
    chosen = sized.groupBy("node").agg(F.array(F.max_by("block", F.struct("k", "block")), F.min_by("block", F.struct("k", "block"))).alias("bs")).select(F.explode("bs").alias("block")).distinct()
    near = stored(blocks.join(chosen, "block", "left_semi").select("block", "node"), blocks.count())
    described = sets.where("id is not null").select("node", "n", "point", "cells", "firsts")
    info = described.drop("firsts").join(near.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    rows = near.join(info, "node").select("block", "n", "node", "point", "cells")
    first = stored(rows.repartition(spread, "block").sortWithinPartitions("block", "n", "node").mapInArrow(_first_pairs(percent, pair_schema), "a bigint, b bigint").distinct())
    links = stored(verified(docs, sets, first, percent, width, key, text), first.count())
    roots = stored(components(links), 2 * links.count())
    # then, in every block, rows outside its largest component meet all others of it
    rest = blocks.join(roots, "node", "left").select("block", "node", "key", F.coalesce("root", "node").alias("comp"))
    parts = stored(rest.groupBy("block", "comp").agg(F.count("*").alias("k")), blocks.count())
    main = parts.groupBy("block").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("k"), F.max("k").alias("m")).where("k > m")
    if not main.isEmpty():
        deal = main.select("block", "main", F.ceil(F.col("k") / most_rows).cast("int").alias("rb"), F.ceil((F.col("k") - F.col("m")) / most_rows).cast("int").alias("sb"))
        met = rest.join(deal, "block")
        met = met.join(described.join(met.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "node")
        each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        hashed = lambda c, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(c)).cast("int")
        cols = ["n", "node", "point", "cells", "comp", "key", "firsts"]
        whole = met.select("block", hashed("rb", 1).alias("r"), each("sb").alias("s"), (F.col("comp") != F.col("main")).cast("int").alias("kind"), *cols)
        strays = met.where("comp <> main").select("block", hashed("sb", 2).alias("s"), each("rb").alias("r"), F.lit(2).alias("kind"), *cols)
        both = whole.unionByName(strays).select(F.xxhash64("block", "r", "s").alias("part"), "kind", *cols)
        more = stored(both.repartition(spread, "part").sortWithinPartitions("part", "kind", "n", "node").mapInArrow(_between_pairs(percent, pair_schema), "a bigint, b bigint").distinct())
        if not more.isEmpty():
            links = stored(links.union(verified(docs, sets, more, percent, width, key, text)), links.count() + more.count())
            roots = components(links)
    placed = sets.select("id", "digest", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.where("root is not null and id is not null").groupBy("root").agg(F.min(F.struct("id", "digest")).alias("least"))
    return placed.join(least, "root", "left").select("id", "digest", "n", F.coalesce("least.id", "id").alias("component_id"), F.col("least.digest").alias("kept"))


def _digest(text: str):
    return F.xxhash64(F.col(text).cast("string"))


def keep_representatives(docs: DataFrame, *, key: str = "doc_id", text: str = "text", most_broadcast: int = 1_000_000, **how) -> DataFrame:
    """One row of ``docs`` a component: of the least key, and there of the least digest of
    a text.  Rows that repeat a key and text become one, any of them; other texts of
    one key are judged on their own; rows without a key stay.  Null and wordless texts are linked with nothing, so
    a row of each key stays; an empty table stays empty; very long texts are compared whole; columns may have any names.
    """
    (d,) = fresh(docs, "__digest")
    rows = _placed(docs, key=key, text=text, **how).where("id is not null")
    gone = (F.col("id") != F.col("component_id")) | F.coalesce(F.col("digest") != F.col("kept"), F.lit(False))
    rows = stored(rows.select(F.col("id").alias(key), F.col("digest").alias(d), gone.alias("gone")))
    gone = stored(rows.where("gone").drop("gone").distinct())
    again = stored(rows.where("not gone").groupBy(key, d).count().where("count > 1").drop("count"))
    near = lambda f: F.broadcast(f) if f.count() <= most_broadcast else f
    out = docs.withColumn(d, _digest(text)).join(near(gone), [key, d], "left_anti")
    if not again.isEmpty():
        again = near(again)
        once = out.join(again, [key, d], "left_semi").dropDuplicates([key, d])
        out = out.join(again, [key, d], "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
