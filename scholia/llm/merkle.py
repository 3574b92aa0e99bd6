"""Merkle manifest of a dataset: roots, membership proofs and their verification (operator 13).

Every row is a leaf, the digest of its named columns. Per group (source) the leaves, in order of
doc_id, are joined into runs of ARITY; each run's digest is a node of the next level, until one
node is left, the subroot. The subroots, in order of their group, form a tree of their own; its
last node is the root.

Each level is one step of sibling-shift self-joins: a node computes the indices of its siblings
(XOR 1 in a binary tree, else the other slots of its run by offset) and is equijoined with the
nodes that have them. Rows of slot zero then emit the parents. Join keys are (group, index), at
most one row each, so that no group is ever gathered, however large; places within a group come
from range partitions and offsets. Levels are stored, and shrink by ARITY; proofs are handed down
from the root with one equijoin a level.

Defined results: a null column counts as '-'; a null group is first, and a null doc_id is first in
its group; leaves of equal doc_id are ordered by digest, and rows equal in all columns are leaves
of their own, next to each other; a group with one leaf has it as subroot, and a dataset with one
group has its subroot as root; a leaf without any sibling has the digest of the empty text as
proof; empty and very long texts are hashed like any other; an empty table gives no rows; columns that
are neither named nor kept are ignored, whatever they are called.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import stored
from scholia.operators.ordering import positions

ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    """Lowercase hex sha256 of a text, or of bytes."""
    return F.sha2(text, 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def field(value: Column) -> Column:
    """One column in a leaf: '-' if null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(columns: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row; columns stand in for those of the same name."""
    return digest(F.concat(*[field((columns or {}).get(f, F.col(f))) for f in fields]))


class Tree(NamedTuple):
    """levels[k]: _tree, _at, digest, before, after (digests of the siblings left and right of it, as bytes), lone.

    tops: _tree, height, digest of the last node of each tree.
    """

    levels: list[DataFrame]
    tops: DataFrame


def siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Every node with the digests of its siblings: one equijoin on a computed index for each other slot."""
    slot, rows, found = F.col("_at") % arity, nodes, []
    for d in range(1, arity):
        index = F.col("_at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("_at") - slot + (slot + d) % arity
        other = nodes.select(F.col("_tree").alias("_of"), F.col("_at").alias("_index"), F.col("digest").alias(f"_sibling{d}"))
        rows = rows.join(other, (F.col("_tree") == F.col("_of")) & (index == F.col("_index")), "left").drop("_of", "_index")
        found.append((d, F.coalesce(F.col(f"_sibling{d}"), F.lit(b""))))
    none = F.lit(b"")
    before = F.concat(none, *[F.when(slot + d >= arity, h).otherwise(none) for d, h in found])
    after = F.concat(none, *[F.when(slot + d < arity, h).otherwise(none) for d, h in found])
    rows = rows.withColumns({"before": before, "after": after}).drop(*[f"_sibling{d}" for d in range(1, arity)])
    # index 1 would be in the same run as index 0, so a first node without siblings is the only one
    return rows.withColumn("lone", (F.col("_at") == 0) & (F.octet_length("before") + F.octet_length("after") == 0))


def climb(leaves: DataFrame, arity: int = ARITY) -> Tree:
    """All trees of leaves (_tree, _at from 0 without gaps, digest, and columns that only the first level keeps)."""
    most = leaves.agg(F.max("_at")).first()[0]
    nodes, levels, tops = leaves, [], []
    left = 0 if most is None else most + 1
    while left > 1:
        level = stored(siblings(nodes, arity), "merkle-level")
        levels.append(level)
        tops.append(level.where("lone").select("_tree", F.lit(len(levels) - 1).alias("height"), "digest"))
        nodes = level.where((F.col("_at") % arity == 0) & ~F.col("lone")).select(
            "_tree", F.expr(f"_at div {arity}").alias("_at"), F.unhex(digest(_hex(F.concat("digest", "after")))).alias("digest")
        )
        left = -(-left // arity)
    top = nodes.select("_tree", F.lit(len(levels)).alias("height"), "digest")
    for t in tops:
        top = top.unionByName(t)
    return Tree(levels, top)


def descend(tree: Tree, tops: DataFrame, arity: int = ARITY) -> DataFrame | None:
    """The nodes of the first level with path, their siblings level by level to the root; None if there is no level.

    tops: _tree, height, path (what lies above each tree), and columns that are handed down.
    """
    handed = [c for c in tops.columns if c not in ("_tree", "height")]
    lower = None
    for height in reversed(range(len(tree.levels))):
        above = tops.where(F.col("height") == height + 1).select("_tree", F.lit(0).cast("long").alias("_at"), *handed)
        if lower is not None:
            above = above.unionByName(lower.select("_tree", "_at", *handed))
        above = above.select(F.col("_tree").alias("_of"), F.col("_at").alias("_index"), *[F.col(c).alias(f"_{c}") for c in handed])
        level = tree.levels[height].where("not lone")
        own = F.array(F.struct("before", "after"))
        lower = level.join(above, (F.col("_tree") == F.col("_of")) & (F.expr(f"_at div {arity}") == F.col("_index"))).select(
            *[c for c in level.columns if c not in ("before", "after", "lone")],
            *[F.concat(own, "_path").alias("path") if c == "path" else F.col(f"_{c}").alias(c) for c in handed],
        )
    return lower


_PATH = "array<struct<before:binary,after:binary>>"


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf (hex) and its siblings lead to."""
    return F.aggregate(path, leaf, lambda s, x: digest(F.concat(_hex(x["before"]), s, _hex(x["after"]))))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, from the leaf's level to the root's, left to right."""
    return digest(F.array_join(F.transform(path, lambda x: F.concat(_hex(x["before"]), _hex(x["after"]))), ""))


def manifest(documents: DataFrame, claims: dict[str, Column] | None = None, group: str = "source",
             order: str = "doc_id", fields: tuple[str, ...] = FIELDS, arity: int = ARITY) -> DataFrame:
    """Per row: order, group, leaf, subroot, root (hex), path (siblings to the root) and each of claims.

    claims: further columns of a row, kept beside it (such as the leaf digest of what somebody else holds).
    """
    claims = claims or {}
    rows = documents.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("_tree"),
        F.col(order).alias("_key"), F.unhex(leaf_digest(fields=fields)).alias("digest"),
        *[c.alias(f"_claim_{n}") for n, c in claims.items()], F.monotonically_increasing_id().alias("_row"),
    )
    rows = stored(rows, "merkle-leaves")
    placed = positions(rows, ["_tree"], [F.col("_key").asc_nulls_first(), F.col("digest"), F.col("_row")], "_at").drop("_row")
    leaves = stored(placed, "merkle-placed")
    tree = climb(leaves, arity)

    subroots = stored(tree.tops, "merkle-subroots")  # one row a group
    ordered = positions(subroots.withColumn("_top", F.lit("")), ["_top"], [F.col("_tree")], "_at")
    named = ordered.select(F.col("_top").alias("_tree"), "_at", "digest", F.col("_tree").alias("_group"), "height")
    upper = climb(stored(named, "merkle-groups"), arity)
    last = upper.tops.select("digest").first()  # one row, none for an empty table
    root = F.lit(bytes(last[0]).hex() if last else None).cast("string")

    above = upper.tops.select("_tree", "height", F.array().cast(_PATH).alias("path"))
    paths = descend(upper, above, arity)
    if paths is None:  # no group, or only one
        paths = named.select("_group", "height", "digest", F.array().cast(_PATH).alias("path"))
    tops = stored(paths.select(F.col("_group").alias("_tree"), "height", "path", F.col("digest").alias("subroot")), "merkle-tops")

    kept = ["_tree", "_key", "digest", *[f"_claim_{n}" for n in claims], "path", "subroot"]
    alone = (leaves if not tree.levels else tree.levels[0].where("lone")).join(tops.where("height = 0").drop("height"), "_tree").select(*kept)
    below = descend(tree, tops, arity)
    full = alone if below is None else below.select(*kept).unionByName(alone)
    return full.select(
        F.col("_key").alias(order), F.expr("CASE WHEN _tree <> '' THEN substr(_tree, 2) END").alias(group), _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"), root.alias("root"), "path", *[F.col(f"_claim_{n}").alias(n) for n in claims],
    )


def audit(documents: DataFrame, tampered: Column, arity: int = ARITY) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    tampered: the text that is checked against the manifest in place of the column text; folded_root is
    where its leaf leads with the siblings of the manifest, verified whether that is the root.
    """
    claim = F.unhex(leaf_digest({"text": tampered}))
    proven = manifest(documents, {"claim": claim}, arity=arity)
    folded = proven.withColumn("folded_root", fold(_hex(F.col("claim")), F.col("path")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def without_line_breaks() -> Column:
    """The text without its line breaks where the checksum of doc_id is even, else as it is."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return F.when(even, F.replace(F.col("text").cast("string"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


#: DuckDB's crc32 of a text, beside the one row of crc_steps: the table by its rule, then one step a byte.
SQL_CRC = """crc_steps AS MATERIALIZED (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END,
  CAST(i AS BIGINT)) ORDER BY i) AS steps FROM range(0, 256) r(i))"""


def _crc(text: str) -> str:
    bytes_of = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return (
        f"xor(list_reduce({bytes_of}, lambda c, b: xor(c // 256, steps[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"
    )


def _sql_levels(prefix: str, start: str, n: int, arity: int = ARITY) -> str:
    """n levels of a forest: <prefix>k(g, i, h, m, b, a), m nodes in tree g, siblings before and after."""
    parts, source = [], start
    for k in range(n):
        run = f"PARTITION BY g, i // {arity} ORDER BY i"
        parts.append(
            f"""{prefix}{k} AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS m,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
  coalesce(string_agg(h, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {source})"""
        )
        source = (
            f"(SELECT g, i // {arity} AS i, CASE WHEN any_value(m) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h"
            f" FROM {prefix}{k} GROUP BY g, i // {arity})"
        )
    return ",\n".join(parts)


def _sql_fold(prefix: str, rows: str, group: str, place: str, n: int, arity: int = ARITY) -> str:
    """The rows with their proof and folded digest carried up n levels."""
    for k in range(n):
        rows = f"""(SELECT r.* REPLACE (CASE WHEN x.m = 1 THEN proof ELSE proof || x.b || x.a END AS proof,
  CASE WHEN x.m = 1 THEN folded ELSE sha256(x.b || folded || x.a) END AS folded)
  FROM {rows} r JOIN {prefix}{k} x ON x.g = r.{group} AND x.i = r.{place} // {arity**k})"""
    return rows


#: Levels of the checking SQL: 3 ** 13 rows a source, 3 ** 6 sources.
_DEEP, _FLAT = 13, 6


def _sql_field(value: str, text: bool = True) -> str:
    plain = value if text else f"CAST({value} AS VARCHAR)"
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({plain}) || ':' || {plain} END"


def _sql_leaf(text: str) -> str:
    fields = [_sql_field("doc_id", False), _sql_field("source"), _sql_field("lang"), _sql_field("n_chars", False), _sql_field(text)]
    return f"sha256({' || '.join(fields)})"


_ANY = "CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
ORACLE = f"""WITH {SQL_CRC},
summed AS MATERIALIZED (SELECT *, {_crc("CAST(doc_id AS VARCHAR)")} AS crc FROM documents, crc_steps),
hashed AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {_sql_leaf("text")} AS h, {_sql_leaf(f"({_ANY})")} AS claim FROM summed),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i FROM hashed),
{_sql_levels("n", "leaves", _DEEP)},
subs AS MATERIALIZED (SELECT '' AS g, g AS s, h, row_number() OVER (ORDER BY g) - 1 AS i FROM n{_DEEP - 1} WHERE i = 0),
{_sql_levels("t", "subs", _FLAT)},
top AS (SELECT h AS root FROM t{_FLAT - 1} WHERE i = 0),
inner_folded AS MATERIALIZED {_sql_fold("n", "(SELECT *, '' AS proof, claim AS folded FROM leaves)", "g", "i", _DEEP)},
placed AS MATERIALIZED (SELECT f.* EXCLUDE (i), s.h AS subroot, s.i AS si, '' AS e FROM inner_folded f JOIN subs s ON s.s = f.g),
done AS {_sql_fold("t", "placed", "e", "si", _FLAT)}
SELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified FROM done, top"""
