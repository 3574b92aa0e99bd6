"""Documents whose word shingles overlap, by signature trees (operator 6).

Two documents link when their sets of SHINGLE-word shingles have a Jaccard similarity of at
least PERCENT / 100. Exact at every size:

1. Shingles are counted over all documents in hashed counters; rare ones come first in one
   order that holds for all. Linked sets share a shingle among the first
   n - ceil(PERCENT n / 100) + 1 of each, so those are the blocks; blocks with the same
   members count once. Equal sets are one member.
2. In a block, members are leaves of a signature tree: nodes hold the OR of their members'
   shingle bitmaps and the range of their sizes. Pairs of nodes are walked from the top and
   dropped when their sizes or the largest overlap that the bitmaps allow rule out a link.
   What is left joins into groups of possible links (a forest, never all pairs).
3. Groups connect across blocks. The sets of their members are read again and walked by the
   same trees, now with the true overlap of each pair that is left; members that are already
   connected are not compared again.

Blocks and groups of more than MEMBERS members are dealt out as pairs of chunks, so a task
holds a bounded number of sets. Sets travel only for members of possible groups.

Words are runs of bytes other than ASCII white space, A-Z as a-z.

Defined results: null or empty text has an empty set and is its own component; fewer than
SHINGLE words make one shingle of all of them; rows that repeat a doc_id are one document; a
null doc_id is linked with nothing; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import Texts, as_texts, may_hold, membership_filter, mix, prepare, slices, stored, texts_of, windows_of, words_of
from scholia.llm.components import components

SHINGLE, PERCENT = 5, 80
#: Counters of shingles (each task sends them once, packed), and how many are sent together.
COUNTERS, TOGETHER = 1 << 20, 1 << 14
#: Members of a block or group that one task holds twice at most; nodes under a node.
MEMBERS, FAN = 2_000, 8
CHUNK_PAIRS = 4_096


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(codes, first): the sorted distinct shingles of text k are codes[first[k]:first[k + 1]]."""
    words = words_of(texts, lower=True)
    n = len(texts.offsets) - 1
    count = np.diff(words.first)
    starts = np.flatnonzero(words.of[: max(0, len(words.of) - SHINGLE + 1)] == words.of[SHINGLE - 1 :]) if len(words.of) >= SHINGLE else np.zeros(0, int)
    codes = windows_of(words.codes, SHINGLE)[starts]
    of = words.of[starts]
    few = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(few):
        whole = np.array([windows_of(words.codes[words.first[k] : words.first[k + 1]], SHINGLE)[0] for k in few], np.uint64)
        codes, of = np.append(codes, mix(whole + count[few].astype(np.uint64))), np.append(of, few)
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    codes, of = codes[fresh], of[fresh]
    return codes, np.searchsorted(of, np.arange(n + 1))


def count_shingles(documents: DataFrame) -> np.ndarray:
    """How many documents' shingles fall on each counter, as quarter powers of two (one byte each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint32)
        for batch in slices(batches):
            codes, _ = shingle_sets(as_texts(batch.column("text")))
            held += np.bincount((codes % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS).astype(np.uint32)
        parts = list(range(0, COUNTERS, TOGETHER))
        packed = [zlib.compress(held[a : a + TOGETHER].astype("<u4").tobytes(), 1) for a in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(TOGETHER)
        for x in table.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), "<u4")
        levels = np.minimum(np.log2(total + 1) * 4, 255).astype(np.uint8)
        return pa.table({"part": [key[0].as_py()], "counts": [levels.tobytes()]})

    out = np.zeros(COUNTERS, np.uint8)
    rows = texts_of(documents).mapInArrow(run, "part long, counts binary").groupBy("part").applyInArrow(add, "part long, counts binary")
    for r in rows.collect():  # COUNTERS bytes
        out[r["part"] : r["part"] + TOGETHER] = np.frombuffer(r["counts"], np.uint8)
    return out


def _width(n: np.ndarray) -> np.ndarray:
    """Power of two of a bitmap's bits: at least two bits a shingle, 64 at least."""
    return np.maximum(np.ceil(np.log2(np.maximum(2 * n, 2))), 6).astype(int)


def bitmap(codes: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << int(_width(np.array([len(codes)]))[0]), np.uint8)
    bits[(mix(codes) & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def describe(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, its set's key (k1, k2) and size n, the shingles whose blocks it is in, and its bitmap."""
    levels = documents.sparkSession.sparkContext.broadcast(count_shingles(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in slices(batches):
            codes, first = shingle_sets(as_texts(batch.column("text")))
            rank = level[(codes % np.uint64(COUNTERS)).astype(np.int64)]
            keys, sizes, heads, maps = [], np.diff(first), [], []
            for a, n in zip(first.tolist(), sizes.tolist()):
                own = codes[a : a + n]
                keys.append((int(mix(own).sum(dtype=np.uint64).view(np.int64)), int(mix(own ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64))) if n else (0, 0))
                need = n - -(-PERCENT * n // 100) + 1 if n else 0
                order = np.lexsort((own, rank[a : a + n]))[:need]
                heads.append(own[order].view(np.int64))
                maps.append(bitmap(own).tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(heads, pa.list_(pa.int64())), pa.array(maps, pa.binary()),
                ],
                names=["doc_id", "k1", "k2", "n", "heads", "bits"],
            )

    return texts_of(documents).mapInArrow(run, "doc_id long, k1 long, k2 long, n long, heads array<long>, bits binary")


class Members(NamedTuple):
    """Members of one width: ids, sizes, bitmaps as 64-bit words, and shingles beyond one a bit."""

    ids: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    extra: np.ndarray

    def take(self, at: np.ndarray) -> Members:
        return Members(*[x[at] for x in self])


class Forest:
    """Which members are connected, and the links that connected them."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.label, self.links = ids, np.arange(len(ids)), []

    def join(self, a: int, b: int) -> None:
        x, y = self.label[a], self.label[b]
        if x != y:
            self.label[self.label == max(x, y)] = min(x, y)
            self.links.append((int(self.ids[a]), int(self.ids[b])))


def _levels(m: Members) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, least size, most size, most extra) of the tree's levels, leaves first; members are in order of size."""
    levels = [(m.bits, m.n, m.n, m.extra)]
    while len(levels[-1][1]) > FAN:
        bits, low, high, extra = levels[-1]
        at = np.arange(0, len(low), FAN)
        levels.append((np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))
    return levels


def _possible(x: tuple, y: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold a link: sizes within reach, and the largest overlap enough."""
    keep = (100 * x[2][i] >= PERCENT * y[1][j]) & (100 * y[2][j] >= PERCENT * x[1][i])
    at = np.flatnonzero(keep)
    shared = np.bitwise_count(x[0][i[at]] & y[0][j[at]]).sum(axis=1, dtype=np.int64)
    overlap = shared + np.minimum(x[3][i[at]], y[3][j[at]])
    keep[at] = (100 + PERCENT) * overlap >= PERCENT * (x[1][i[at]] + y[1][j[at]])
    return keep


def walk(x: Members, y: Members | None, at_x: np.ndarray, at_y: np.ndarray, forest: Forest, linked: Callable[[int, int], bool] | None) -> None:
    """Connect in forest what may link (or, with linked, does): members of x with each other, or with those of y.

    at_x and at_y are the members' places in forest.
    """
    order = np.argsort(x.n, kind="stable")
    x, at_x = x.take(order), at_x[order]
    same = y is None
    if same:
        y, at_y = x, at_x
    else:
        order = np.argsort(y.n, kind="stable")
        y, at_y = y.take(order), at_y[order]
    left, right = _levels(x), _levels(y)
    depth = max(len(left), len(right))
    left, right = left + [left[-1]] * (depth - len(left)), right + [right[-1]] * (depth - len(right))

    def children(side: list, k: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes one level down, and which pair each came from."""
        if side[k] is side[k - 1]:
            return nodes, np.arange(len(nodes))
        below = nodes[:, None] * FAN + np.arange(FAN)
        there = below < len(side[k - 1][1])
        return below[there], np.repeat(np.arange(len(nodes)), there.sum(axis=1))

    def down(k: int, i: np.ndarray, j: np.ndarray) -> None:
        for a in range(0, len(i), CHUNK_PAIRS):
            p, q = i[a : a + CHUNK_PAIRS], j[a : a + CHUNK_PAIRS]
            if k <= 2:  # few members under each: leave out what is connected already
                size = FAN**k
                ends = [(at_x[n * size : (n + 1) * size], at_y[m * size : (m + 1) * size]) for n, m in zip(p.tolist(), q.tolist())] if k else []
                if k:
                    open_ = np.array([len(np.unique(forest.label[np.concatenate(e)])) > 1 for e in ends], bool)
                    p, q = p[open_], q[open_]
                else:
                    open_ = forest.label[at_x[p]] != forest.label[at_y[q]]
                    p, q = p[open_], q[open_]
            good = _possible(left[k], right[k], p, q)
            p, q = p[good], q[good]
            if k == 0:
                for n, m in zip(p.tolist(), q.tolist()):
                    u, v = int(at_x[n]), int(at_y[m])
                    if forest.label[u] != forest.label[v] and (linked is None or linked(u, v)):
                        forest.join(u, v)
                continue
            if not len(p):
                continue
            if k == 1:  # one left node at a time, so that what it connects is left out next
                for n in np.unique(p):
                    step(k, np.full((p == n).sum(), n), q[p == n])
            else:
                step(k, p, q)

    def step(k: int, p: np.ndarray, q: np.ndarray) -> None:
        one, of = children(left, k, p)
        two, back = children(right, k, q[of])
        one = one[back]
        if same:
            ahead = one <= two if k > 1 else one < two
            one, two = one[ahead], two[ahead]
        down(k - 1, one, two)

    top = depth - 1
    i, j = np.meshgrid(np.arange(len(left[top][1])), np.arange(len(right[top][1])), indexing="ij")
    i, j = i.ravel(), j.ravel()
    if same:
        ahead = i <= j if top else i < j
        i, j = i[ahead], j[ahead]
    down(top, i, j)


def join_members(ids: np.ndarray, n: np.ndarray, maps: list[bytes], side: np.ndarray, linked: Callable[[int, int], bool] | None) -> list[tuple[int, int]]:
    """Links of a forest over the members of one block or group; side 0 and 1 are compared with each other only."""
    forest = Forest(ids)
    wide = _width(n)
    within = len(np.unique(side)) < 2
    for w in np.unique(wide):
        here, above = np.flatnonzero(wide == w), np.flatnonzero(wide == w + 1)

        def members(at: np.ndarray, w: int = int(w)) -> Members:
            bits = np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(len(at), -1)
            if bits.shape[1] > 1 << max(w - 6, 0):  # the next width folds onto this one
                bits = bits[:, : bits.shape[1] // 2] | bits[:, bits.shape[1] // 2 :]
            return Members(ids[at], n[at], bits, n[at] - np.bitwise_count(bits).sum(axis=1, dtype=np.int64))

        if within:
            walk(members(here), None, here, here, forest, linked)
            if len(above):
                walk(members(here), members(above), here, above, forest, linked)
        else:
            for one, two in ((here[side[here] == 0], here[side[here] == 1]), (here[side[here] == 0], above[side[above] == 1]), (here[side[here] == 1], above[side[above] == 0])):
                if len(one) and len(two):
                    walk(members(one), members(two), one, two, forest, linked)
    return forest.links


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one key after the other, from rows that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        columns = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        start = 0
        for cut in cuts.tolist():
            yield table.slice(start, cut - start)
            start = cut
        held = [table.slice(start)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _chunked(rows: DataFrame, key: str, size: str) -> DataFrame:
    """Each row in the chunk pairs of its group: one for groups of up to MEMBERS, else one for every chunk.

    Adds one, two (the pair) and side; a pair of equal chunks is compared within itself.
    """
    chunks = F.ceil(F.col(size) / MEMBERS).cast("int")
    return (
        rows.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "e"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})
        .withColumn("side", F.when(F.col("one") == F.col("two"), 0).otherwise((F.col("chunk") == F.col("two")).cast("int")))
        .drop("chunk", "other", size)
        .repartition(key, "one", "two").sortWithinPartitions(key, "one", "two", "side", "n", "e")
    )


def _links(batches: Iterator[pa.RecordBatch], key: str, sets: bool) -> Iterator[pa.RecordBatch]:
    pairs: list[tuple[int, int]] = []
    for group in _groups(batches, [key, "one", "two"]):
        if group.num_rows < 2:
            continue
        ids, n = group.column("e").to_numpy(), group.column("n").to_numpy()
        side = group.column("side").to_numpy()
        if sets:
            own = [np.frombuffer(x, np.uint64) for x in group.column("bits").to_pylist()]
            maps = [bitmap(x).tobytes() for x in own]

            def linked(a: int, b: int, own: list = own) -> bool:
                x, y = (own[a], own[b]) if len(own[a]) <= len(own[b]) else (own[b], own[a])
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                shared = int((y[at] == x).sum())
                return 100 * shared >= PERCENT * (len(x) + len(y) - shared)

            pairs += join_members(ids, n, maps, side, linked)
        else:
            pairs += join_members(ids, n, group.column("bits").to_pylist(), side, None)
        if len(pairs) > 50_000:
            yield _pairs(pairs)
            pairs = []
    yield _pairs(pairs)


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    table = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(table[:, 0]), pa.array(table[:, 1])], names=["a", "b"])


def _members_of(documents: DataFrame, groups: DataFrame) -> DataFrame:
    """The sets of the documents in groups (e, g, size), read again from the texts; only a filter of their ids is sent to the tasks."""
    wanted = documents.sparkSession.sparkContext.broadcast(membership_filter(groups.select("e")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(may_hold(bits, ids))
            part = batch.take(pa.array(at))
            codes, first = shingle_sets(as_texts(part.column("text")))
            sets = [codes[a:b].tobytes() for a, b in zip(first.tolist(), first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(sets, pa.binary())], names=["e", "n", "bits"])

    rows = texts_of(documents).where("doc_id is not null").mapInArrow(run, "e long, n long, bits binary")
    return rows.join(groups, "e").where("n > 0")


def link(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    prepare(documents.sparkSession)
    described = stored(describe(documents), "shingle-sets")
    classes = described.where("n > 0 and doc_id is not null").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("e"))
    classes = stored(classes, "classes")

    # blocks: the members of each head shingle; those of equal members once
    first = described.join(classes.select("e"), described["doc_id"] == classes["e"], "left_semi")
    heads = first.select(F.explode("heads").alias("t"), F.col("doc_id").alias("e"))
    block = Window.partitionBy("t")
    shared = heads.withColumns({"size": F.count("*").over(block), "print": F.sum(F.xxhash64("e").bitwiseXOR(F.lit(77)).cast("decimal(38,0)")).over(block)})
    shared = stored(shared.where("size > 1"), "blocks")
    once = shared.groupBy("print", "size").agg(F.min("t").alias("t"))
    kept = shared.join(once, ["print", "size", "t"], "left_semi").drop("print")
    rows = kept.join(first.select(F.col("doc_id").alias("e"), "n", "bits"), "e")
    possible = _chunked(rows, "t", "size").mapInArrow(lambda b: _links(b, "t", False), "a long, b long")

    # groups of possible links, and the true links within them
    groups = components(possible).withColumnsRenamed({"node": "e", "component": "g"})
    size = Window.partitionBy("g")
    groups = stored(groups.withColumn("size", F.count("*").over(size)), "groups")
    rows = _chunked(_members_of(documents, groups), "g", "size")
    links = rows.mapInArrow(lambda b: _links(b, "g", True), "a long, b long")
    found = components(links).withColumnRenamed("node", "e")

    labels = classes.join(found, "e", "left").select("k1", "k2", "n", F.coalesce("component", "e").alias("component_id"))
    return described.join(labels, ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
