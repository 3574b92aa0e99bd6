"""Repeated passages by prefix-partitioned suffix trees (operator 4).

A word is removed when a window of WINDOW words that covers it also starts in a document
with a smaller doc_id. Windows are judged on the input.

1. A window's anchor is the place of its least PREFIX-word hash (leftmost on ties): equal
   windows have it at the same distance. Suffixes are grouped by the PREFIX words at their
   anchor; only prefixes that occur in more than one document go on, known to the tasks by a
   filter of fixed size. This drops nearly all suffixes before any words are shuffled.
2. Prefixes with more than GROUP suffix groups are extended by a hash of document and place, so
   that every group fits a task's memory.
3. Each group's subtree is built over its suffixes' words: nodes at depth 1, 2, 4 and 8 are
   named by sorting pairs of names, and from these the nodes at depth WINDOW. Deep nodes with
   more than one document are the repeats; all but the smallest document's windows go. For
   extended prefixes the smallest of each part meet once more by node.
4. Removed ranges come back to their documents by one join.

Defined results: null or empty text has no words; a text of fewer than WINDOW words keeps
all; a null doc_id neither loses words nor makes others lose them; rows that repeat a doc_id
are copies of one document and lose the same places; an empty table gives an empty result;
other columns are ignored unless named in keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import Words, as_texts, may_hold, membership_filter, mix, prepare, slices, spread_ranges, stored, texts_of, windows_of, words_of

WINDOW, PREFIX = 13, 6
#: Suffix groups of a prefix before it is extended; and the share of all suffixes below which none is,
#: so that the list of extended prefixes has at most MOST entries.
GROUP, MOST = 20_000, 100_000
#: Suffix words that a task names at once.
TOGETHER = 400_000


class Anchored(NamedTuple):
    """Runs of windows with one anchor: text, first and last window start, anchor (word numbers), prefix code."""

    of: np.ndarray
    first: np.ndarray
    last: np.ndarray
    prefix: np.ndarray


def anchored(words: Words) -> Anchored:
    codes, n = words.codes, len(words.codes)
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return Anchored(none, none, none, none.astype(np.uint64))
    starts = np.flatnonzero(words.of[: n - WINDOW + 1] == words.of[WINDOW - 1 :])
    grams = windows_of(codes, PREFIX)
    nearest = np.lib.stride_tricks.sliding_window_view(grams[: n - PREFIX + 1], WINDOW - PREFIX + 1)
    anchor = starts + nearest[starts].argmin(axis=1)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (words.of[starts[1:]] != words.of[starts[:-1]])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    return Anchored(words.of[starts[head]], starts[head], starts[tail], grams[anchor[head]])


def shared_prefixes(documents: DataFrame) -> DataFrame:
    """Prefixes at anchors in more than one document: prefix, n (suffix groups, also those within one document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = anchored(words_of(as_texts(batch.column("text"))))
            order = np.lexsort((found.prefix, found.of))
            prefix, of = found.prefix[order], found.of[order]
            fresh = np.ones(len(of), bool)
            fresh[1:] = (prefix[1:] != prefix[:-1]) | (of[1:] != of[:-1])
            first = np.flatnonzero(fresh)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix[first].view(np.int64)), pa.array(ids[of[first]]), pa.array(np.diff(np.append(first, len(of))))],
                names=["prefix", "doc_id", "n"],
            )

    rows = texts_of(documents).where("doc_id is not null").mapInArrow(run, "prefix long, doc_id long, n long")
    return (
        rows.groupBy("prefix").agg(F.sum("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        .where("low < high").select("prefix", "n")
    )


def suffixes(documents: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Suffix groups: prefix, part (of extended prefixes, else -1), doc_id, at (first window's word), words (codes up to the last window's end)."""
    total = prefixes.agg(F.sum("n")).first()[0] or 0
    least = max(GROUP, total // MOST)
    parts = {r["prefix"]: -(-r["n"] // least) for r in prefixes.where(F.col("n") > least).collect()}  # at most MOST
    shared = documents.sparkSession.sparkContext.broadcast((membership_filter(prefixes.select("prefix")), parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, extended = shared.value
        large = np.array(sorted(extended), np.int64)
        for batch in slices(batches):
            words = words_of(as_texts(batch.column("text")))
            found = anchored(words)
            prefix = found.prefix.view(np.int64)
            keep = may_hold(bits, prefix)
            of, first, last, prefix = found.of[keep], found.first[keep], found.last[keep], prefix[keep]
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[of].astype(np.int64)
            part = np.full(len(prefix), -1)
            hot = np.flatnonzero(np.isin(prefix, large))
            if len(hot):
                place = mix(mix(ids[hot].view(np.uint64)) + first[hot].astype(np.uint64))
                part[hot] = (place % np.array([extended[p] for p in prefix[hot].tolist()], np.uint64)).astype(np.int64)
            sizes = last - first + WINDOW
            data = words.codes[spread_ranges(first, sizes)] if len(first) else words.codes[:0]
            ends = np.concatenate([[0], np.cumsum(sizes * 8)]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(prefix), pa.array(part, pa.int32()), pa.array(ids), pa.array(first - words.first[of]), column],
                names=["prefix", "part", "doc_id", "at", "words"],
            )

    rows = texts_of(documents).where("doc_id is not null")
    return rows.mapInArrow(run, "prefix long, part int, doc_id long, at long, words binary")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by group, in tables of whole groups of about TOGETHER words."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column("words").nbytes // 8
        if size >= TOGETHER:
            table = pa.Table.from_batches(held).combine_chunks()
            prefix, part = table.column("prefix").to_numpy(), table.column("part").to_numpy()
            cuts = np.flatnonzero((prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1]))
            if len(cuts):
                yield table.slice(0, int(cuts[-1]) + 1)
                rest = table.slice(int(cuts[-1]) + 1)
                held = rest.to_batches()
                size = rest.column("words").nbytes // 8
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of the pairs of two names."""
    return np.unique(a * (np.int64(b.max()) + 1) + b, return_inverse=True)[1]


def _ahead(names: np.ndarray, by: int) -> np.ndarray:
    return np.append(names[by:], np.zeros(min(by, len(names)), np.int64))


def deep_nodes(codes: np.ndarray) -> np.ndarray:
    """The node at depth WINDOW of the suffix at each place; meaningless where fewer words follow."""
    one = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    two = _paired(one, _ahead(one, 1))
    four = _paired(two, _ahead(two, 2))
    eight = _paired(four, _ahead(four, 4))
    return _paired(_paired(eight, _ahead(four, 8)), _ahead(one, 12))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed ranges of words (node null), and of extended prefixes the windows of each part's smallest document (node set)."""
    for table in _whole_groups(batches):
        sizes = np.array([len(x) // 8 for x in table.column("words").to_pylist()])
        codes = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint64)
        begin = np.cumsum(sizes) - sizes
        windows = sizes - WINDOW + 1
        place = spread_ranges(begin, windows)
        row = np.repeat(np.arange(len(sizes)), windows)
        node = deep_nodes(codes)[place]
        ids, part, at = table.column("doc_id").to_numpy(), table.column("part").to_numpy(), table.column("at").to_numpy()
        # extended prefixes: parts are trees of their own
        key = _paired(node, (part[row] + 1).astype(np.int64))
        least = np.full(key.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, key, ids[row])
        gone = ids[row] > least[key]
        start = at[row] + place - begin[row]
        # neighbouring windows of one suffix group make one range
        w = np.flatnonzero(gone)
        fresh = np.ones(len(w), bool)
        fresh[1:] = (row[w[1:]] != row[w[:-1]]) | (w[1:] != w[:-1] + 1)
        head = np.flatnonzero(fresh)
        tail = np.append(head[1:], len(w)) - 1 if len(head) else head
        first, last = w[head], w[tail]
        open_ = np.flatnonzero(~gone & (part[row] >= 0))
        marks = windows_of(codes, WINDOW)[place[open_]], windows_of(codes ^ np.uint64(0x5555), WINDOW)[place[open_]]
        none = pa.nulls(len(first), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.array(ids[row[first]]), pa.array(start[first]), pa.array(start[last] + WINDOW)], names=_RANGE)
        if len(open_):
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(m.view(np.int64)) for m in marks], pa.array(ids[row[open_]]), pa.array(start[open_]), pa.array(start[open_] + WINDOW)], names=_RANGE
            )


_RANGE = ["node", "node2", "doc_id", "a", "b"]


def repeats(documents: DataFrame) -> DataFrame:
    """Ranges of words to remove: doc_id, a, b (end exclusive; ranges may overlap)."""
    prefixes = stored(shared_prefixes(documents), "prefixes")
    rows = suffixes(documents, prefixes).repartition("prefix", "part").sortWithinPartitions("prefix", "part")
    found = stored(rows.mapInArrow(_trees, "node long, node2 long, doc_id long, a long, b long"), "ranges")
    least = F.min("doc_id").over(Window.partitionBy("node", "node2"))
    across = found.where("node is not null").withColumn("least", least).where("doc_id > least")
    return found.where("node is null").select("doc_id", "a", "b").unionByName(across.select("doc_id", "a", "b"))


def remove_repeats(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, the columns of keep, n_words, n_removed, text (the words left, joined by one space)."""
    prepare(documents.sparkSession)
    kept = [f for f in documents.schema if f.name in keep and f.name not in ("doc_id", "text", "n_words", "n_removed", "ranges")]
    ranges = repeats(documents).groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    joined = texts_of(documents, *[f.name for f in kept]).join(ranges.hint("shuffle_hash"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = as_texts(batch.column("text"))
            words = words_of(texts)
            column = batch.column("ranges")
            held = np.where(column.is_valid().to_numpy(zero_copy_only=False), column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            flat = column.flatten()
            of = np.repeat(np.arange(batch.num_rows), held)
            count = np.diff(words.first)
            a = np.minimum(flat.field("a").to_numpy(zero_copy_only=False), count[of]) + words.first[of]
            b = np.minimum(flat.field("b").to_numpy(zero_copy_only=False), count[of]) + words.first[of]
            change = np.zeros(len(words.codes) + 1, np.int64)
            np.add.at(change, a, 1)
            np.add.at(change, b, -1)
            gone = np.cumsum(change[:-1]) > 0
            left = np.flatnonzero(~gone)
            sizes = words.ends[left] - words.starts[left] + 1
            data = np.append(texts.data, np.uint8(32))[spread_ranges(words.starts[left], sizes)] if len(left) else texts.data[:0]
            data[np.cumsum(sizes) - 1] = 32
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(left, words.first)]
            raw = data.tobytes()
            out = [raw[x : max(x, y - 1)].decode("utf-8") for x, y in zip(ends.tolist(), ends[1:].tolist())]
            removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(batch.column(f.name) for f in kept), pa.array(count), pa.array(np.diff(removed)), pa.array(out, pa.string())],
                names=["doc_id", *(f.name for f in kept), "n_words", "n_removed", "text"],
            )

    schema = "doc_id long, " + "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + "n_words long, n_removed long, text string"
    return joined.mapInArrow(run, schema)


ORACLE = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
hits AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS least FROM starts) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hits, range(0, 13) r(j)),
marked AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
sha256(coalesce(array_to_string(list_filter(ws, lambda x, p: ps IS NULL OR NOT list_contains(ps, p)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN marked USING (doc_id)"""
