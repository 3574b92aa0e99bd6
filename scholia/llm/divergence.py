"""Source divergence audit by hash-consed segment trees over term ids (operator 12).

Per language the kept terms (in at least LEAST documents) get ids 0 to V - 1, frequent ones first.
The counts of one group (language and source) over the ids are the leaves of a segment tree. Nodes
are hash-consed: equal subtrees of counts, in one group or in several, are one node. Two groups
are compared by walking both trees at once, level by level; a pair of nodes that comes up again
is priced once, as its price depends only on the two nodes and the two groups' totals.

At scale: terms are counted a slice of text at a time, then by Spark (map-side sums, so that a hot
source or term costs nothing). A tree is cut at blocks of LEAVES ids, and the groups of a
language into tiles of TILE; a task gets one block of two tiles and returns one price for each pair of
groups, which Spark adds up. The language's own counts are one more tree in each block, against which
each group's leaves give its most divergent terms. All arithmetic is on integers.

Defined results: null text, lang and source count as ''; every row is a document, repeated ones
too; a group without terms, and a language without kept terms, are groups like others (all
values 0 in the latter); a language with one source has no pairs; ties are ranked by UTF-8 item;
an empty table gives no rows; other columns are ignored. A long text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import _LOWER, as_texts, prepare, slices, stored
from scholia.operators.ordering import positions

LEAST, TOP, PSEUDO, SCALE = 30, 50, 5, 1_000_000_000
LEAVES, TILE, PAIRS = 1024, 64, 256
COUNT_BYTES = 4 << 20

#: Characters of terms: ASCII letters and everything beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms one after the other, A-Z as a-z, and the text that each is in."""
    data, offsets = as_texts(texts)
    inside = _INSIDE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]  # a term ends with its text
    starts = np.flatnonzero(begins)
    ends = np.append((np.cumsum(inside, dtype=np.int64) - 1)[starts], inside.sum()).astype(np.int32)
    held = _LOWER[data[inside]]
    terms = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(held)])
    return terms, np.searchsorted(offsets, starts, "right") - 1


def count_terms(documents: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    prepare(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, COUNT_BYTES):
            terms, of = terms_of(batch.column("text"))
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            size = len(coded.dictionary)
            cells, times = np.unique(of * size + coded.indices.to_numpy(), return_counts=True)  # document and term
            groups: dict[tuple[str, str], int] = {}
            names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()))
            group = np.array([groups.setdefault(g, len(groups)) for g in names])
            keys, at, docs = np.unique(group[cells // size] * size + cells % size, return_inverse=True, return_counts=True)
            n = np.bincount(at, times).astype(np.int64)  # exact: below 2 ** 53
            langs, sources = (pa.array([g[i] for g in groups], pa.string()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(keys // size)), sources.take(pa.array(keys // size)), coded.dictionary.take(pa.array(keys % size)), pa.array(n), pa.array(docs)],
                names=["lang", "source", "term", "n", "docs"],
            )

    plain = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    parts = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, divisor: int) -> np.ndarray:
    """1 + floor(SCALE * (count + PSEUDO) / divisor), exact at any size; counts + PSEUDO are at most the divisor."""
    if divisor >= 2**63 // 1000:
        return np.array([1 + SCALE * (int(c) + PSEUDO) // divisor for c in counts], np.int64)
    left, out = counts.astype(np.int64) + PSEUDO, np.zeros(len(counts), np.int64)
    out, left = left // divisor, left % divisor
    for _ in range(3):  # SCALE is 1000 ** 3
        left = left * 1000
        out, left = out * 1000 + left // divisor, left % divisor
    return out + 1


class Forest:
    """Hash-consed trees of the rows of counts (groups x ids; a power of two of ids, -1 where there is no id)."""

    def __init__(self, counts: np.ndarray):
        self.values, nodes = np.unique(counts, return_inverse=True)
        self.leaves = nodes = nodes.reshape(counts.shape)
        self.children: list[np.ndarray] = []  # from the leaves up: left and right child of each node
        known = len(self.values)
        while nodes.shape[1] > 1:
            keys, nodes_above = np.unique(nodes[:, ::2] * known + nodes[:, 1::2], return_inverse=True)
            self.children.append(np.stack([keys // known, keys % known], axis=1))
            nodes = nodes_above.reshape(len(counts), -1)
            known = len(keys)
        self.roots = nodes[:, 0]

    def distances(self, prices: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """For each pair of trees the sum over the leaves of |prices[tree, leaf]| differences.

        prices: trees x leaf values. Each level holds every pair of nodes once for a pair of trees.
        """
        pair, a, b, back = np.arange(len(one)), self.roots[one], self.roots[two], []
        for children in reversed(self.children):
            below = [np.concatenate([pair, pair]), np.concatenate([children[a, 0], children[a, 1]]), np.concatenate([children[b, 0], children[b, 1]])]
            size = int(max(below[1].max(), below[2].max())) + 1
            keys, at = np.unique((below[0] * size + below[1]) * size + below[2], return_inverse=True)
            back.append(at)
            pair, a, b = keys // (size * size), keys // size % size, keys % size
        price = np.abs(prices[one[pair], a] - prices[two[pair], b])
        for at in reversed(back):
            half = len(at) // 2
            price = price[at[:half]] + price[at[half:]]
        return price


def pricing(leaves: int, tile: int):
    """The work on one block of two tiles: a price for each pair of groups, or each group's most divergent terms."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, block, one, two = (k.as_py() for k in key)
        group, term, n, v = (table.column(c).to_numpy(zero_copy_only=False) for c in ("group", "term", "n", "terms"))
        head = term < 0
        order = np.argsort(group[head])
        groups, divisors = group[head][order], n[head][order]
        size = min(leaves, int(v[head][0]) - block * leaves)
        width = 1 << max(size - 1, 0).bit_length()
        counts = np.zeros((len(groups), width), np.int64)
        counts[:, size:] = -1
        counts[np.searchsorted(groups, group[~head]), term[~head] - block * leaves] = n[~head]
        forest = Forest(counts)
        prices = np.zeros((len(groups), len(forest.values)), np.int64)
        real = forest.values >= 0
        for i, d in enumerate(divisors):
            if size > 0:
                prices[i, real] = shares(forest.values[real], int(d))

        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if one < 0:  # the language's own tree is the first
            for i in range(1, len(groups)):
                over = prices[i, forest.leaves[i]] - prices[0, forest.leaves[0]]
                at = np.flatnonzero((over > 0) & (counts[i] > 0))
                if len(at) > TOP:  # ties of the last place stay
                    at = at[over[at] >= np.partition(over[at], len(at) - TOP)[len(at) - TOP]]
                rows.append((np.full(len(at), groups[i]), at + block * leaves, over[at]))
        else:
            tiles = groups // tile
            a, b = np.nonzero((tiles[:, None] == one) & (tiles[None, :] == two) & (groups[:, None] < groups[None, :]))
            for k in range(0, len(a), PAIRS):
                x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                rows.append((groups[x], groups[y], forest.distances(prices, x, y)))
        a, b, value = (np.concatenate([r[i] for r in rows] or [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))
        return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "is_pair": pa.array(np.full(len(a), one >= 0)), "a": a, "b": b, "value": value})

    return run


def audit(documents: DataFrame, least: int = LEAST, block: int = LEAVES, tile: int = TILE) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item (another source or a term), value, rank."""
    counted = stored(count_terms(documents), "audit-counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least)
    vocabulary = stored(positions(kept.drop("docs"), ["lang"], [F.col("n").desc(), F.col("term")], "id"), "audit-terms")
    counts = stored(
        counted.join(vocabulary.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", F.col("id").alias("term"), "n"), "audit-kept"
    )
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("all"))
    named = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    placed = positions(named, ["lang"], [F.col("source")], "group").join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(placed.na.fill(0, ["total", "terms", "all"]), "audit-groups")
    tiles = groups.groupBy("lang").agg((F.max("group") / tile).cast("long").alias("last_tile"), F.max("terms").alias("terms"), F.max("all").alias("all"))

    # leaves: one row for each count and tree; heads: one row for each tree and block, with the divisor
    own = F.lit(-1).cast("long")
    leaves = counts.join(groups.select("lang", "source", "group"), ["lang", "source"]).select("lang", "group", "term", "n")
    leaves = leaves.unionByName(vocabulary.select("lang", own.alias("group"), F.col("id").alias("term"), "n"))
    leaves = leaves.select("*", F.lit(0).cast("long").alias("terms"), F.expr(f"term div {block}").alias("block"))
    heads = groups.select("lang", "group", "total", "terms").unionByName(tiles.select("lang", own.alias("group"), F.col("all").alias("total"), "terms"))
    heads = heads.select(
        "lang", "group", own.alias("term"), (F.col("total") + PSEUDO * F.col("terms")).alias("n"), "terms",
        F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(terms - 1) div {block}"), F.lit(0).cast("long")))).alias("block"),
    )
    in_tile = F.when(F.col("group") < 0, own).otherwise(F.expr(f"`group` div {tile}"))
    every = F.sequence(F.lit(0).cast("long"), F.col("last_tile"))
    others: Column = F.when(F.col("group") < 0, every).otherwise(F.concat(F.array(own), every))
    dealt = leaves.unionByName(heads).join(tiles.select("lang", "last_tile"), "lang").select(
        "lang", "block", in_tile.alias("tile"), F.explode(others).alias("other"), "group", "term", "n", "terms"
    )
    keyed = dealt.select("lang", "block", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"), "group", "term", "n", "terms")
    priced = keyed.groupBy("lang", "block", "one", "two").applyInArrow(pricing(block, tile), "lang string, is_pair boolean, a long, b long, value long")
    priced = stored(priced, "audit-priced")

    names = groups.select("lang", F.col("group").alias("a"), "source")
    pairs = priced.where("is_pair").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.unionByName(pairs.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = pairs.join(groups.select("lang", F.col("group").alias("b"), F.col("source").alias("item")), ["lang", "b"]).select("lang", "a", "item", "value")
    terms = priced.where("not is_pair").select("lang", "a", F.col("b").alias("id"), "value")
    terms = terms.join(vocabulary.select("lang", "id", F.col("term").alias("item")), ["lang", "id"]).select("lang", "a", "item", "value")

    order = Window.partitionBy("lang", "a").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    ranked = ranked.unionByName(terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP).withColumn("part", F.lit("term")))
    return ranked.join(names, ["lang", "a"]).select("lang", "source", "part", "item", "value", "rank")


_P = "CAST(1 + 1000000000 * CAST({n} + 5 AS HUGEINT) // ({total} + 5 * v) AS BIGINT)"
ORACLE = f"""WITH t AS MATERIALIZED (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(x, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM t),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS d FROM w GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS m FROM c GROUP BY ALL HAVING sum(d) >= 30),
langs AS (SELECT lang, count(*) AS v, CAST(sum(m) AS BIGINT) AS lang_total FROM vocabulary GROUP BY lang),
groups AS MATERIALIZED (SELECT DISTINCT lang, source FROM t),
totals AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS total FROM c JOIN vocabulary USING (lang, term) GROUP BY ALL),
dense AS MATERIALIZED (SELECT lang, source, term, coalesce(n, 0) AS n, {_P.format(n="coalesce(n, 0)", total="coalesce(total, 0)")} AS p,
  {_P.format(n="m", total="lang_total")} AS q FROM groups JOIN vocabulary USING (lang) JOIN langs USING (lang)
  LEFT JOIN totals USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
