"""Mixing sources to target weights by hash-threshold histograms (operator 11).

A document's size is its number of words. Targets are dealt to the sources by weight, up to
REPEATS times their size, the excess going to the others. A source that is to be taken c whole
times and a rest gives every document c times, and once more those whose hash lies below a
threshold: the budgets of the copies are nested, and so are the documents taken.

The threshold is found without sorting: sizes are summed by source and hash bucket (BITS bits),
the bucket in which the rest runs out is the boundary, and only its documents are summed again by
the next bits, until each boundary holds one document. That one is taken if it brings the source nearer
to its target, so a source misses its target by at most half a document. The last step is a filter.
Hot sources cost nothing: sums combine before the shuffle, and the limits of sources are broadcast
where they are few and short, else joined with salts.

Defined results: null text has no words; documents without words are never taken; a null source is a source of its own and
the last; rows of equal doc_id and text have one hash, of those at a boundary as many are taken as fit
(such rows are interchangeable); a null doc_id is hashed like any other; with no words at all every target is 0; an
empty table gives no rows; other columns are ignored unless named in keep. Equal input gives
equal output, whatever the partitions are. Long texts are counted like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import stored
from scholia.operators.ordering import positions

WEIGHTS, SHARE, REPEATS = (5, 2, 1), (3, 2), 2
#: Bits of a document's hash, and those that a round of histograms looks at.
HASH_BITS, BITS = 60, 10
#: Sources, and bytes of their names, up to which their limits are sent to all tasks; beyond, they are copied for so many salts.
MOST_SOURCES, MOST_BYTES, SALTS = 20_000, 4 << 20, 64
_SPACES = "\t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    for c in _SPACES:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(text, " "), "")).cast("long")


def place(doc_id: Column, text: Column, seed: str) -> Column:
    """A document's hash, HASH_BITS bits of it."""
    key = F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit(":"), F.md5(text.cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(38,0)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS) -> DataFrame:
    """sources (group, source_size) with target: share of all sizes by weight, no more than repeats times a source's size.

    The level of words a unit of weight is raised until the sources below their bound take all that the
    others leave (Newton's steps on a concave sum): a round is one sum over the sources.
    """
    ranked = positions(sources.withColumn("_all", F.lit("")), ["_all"], [F.col("group") == "", F.col("group")], "_rank").drop("_all")
    table = F.array(*[F.lit(w) for w in weights])
    bound = F.col("source_size").cast("decimal(38,0)") * _whole(repeats)
    weighed = stored(ranked.withColumn("weight", F.get(table, (F.col("_rank") % len(weights)).cast("int")).cast("decimal(38,0)")), "mix-sources")
    all_sizes, all_weights = weighed.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("weight")).first()
    wanted, capped, left = share[0] * int(all_sizes or 0), 0, int(all_weights or 1)
    while True:
        rest, unit = wanted - share[1] * capped, share[1] * left  # a unit of weight takes rest / unit words
        over = F.col("weight") * _whole(rest) > bound * _whole(unit)
        now = weighed.agg(F.sum(F.when(over, bound)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (int(now[0] or 0), int(now[1] or 0))
        if now == (capped, left) or now[1] == 0:
            break
        capped, left = now
    level = (F.col("weight") * _whole(rest)).cast("double") / F.lit(float(unit))
    return weighed.select("group", "source_size", F.when(over, bound.cast("double")).otherwise(level).alias("target"))


def _with_limits(rows: DataFrame, limits: DataFrame, few: bool) -> DataFrame:
    """Rows with what their source's line of limits holds."""
    if few:
        return rows.join(F.broadcast(limits), "group")  # at most MOST_SOURCES lines and MOST_BYTES of names
    salted = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("hash", "row"), F.lit(SALTS)).cast("int")).join(salted, ["group", "_salt"]).drop("_salt")


def edges(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Per source with a rest: group, low and high (the boundary's hashes), held (its documents), fit (how many of them are taken)."""
    found = plan.where("rest > 0").select("group", "rest", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix"))
    shift, inside = HASH_BITS, rows.where("size > 0")
    while shift > 0:
        before, shift = shift, shift - BITS
        at = F.shiftright("hash", before)
        inside = _with_limits(inside, found.select("group", "prefix"), few).where(at == F.col("prefix")).drop("prefix")
        if before == HASH_BITS - BITS:
            inside = stored(inside, "mix-boundary")  # about one of 2 ** BITS rows; later rounds read only these
        sums = inside.groupBy("group", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count("*").alias("held"))
        up_to = Window.partitionBy("group").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2 ** BITS rows
        crossed = sums.withColumn("up_to", F.sum("words").over(up_to)).join(found.select("group", "rest", "below"), "group")
        crossed = crossed.where((F.col("below") + F.col("up_to") > F.col("rest")) & (F.col("below") + F.col("up_to") - F.col("words") <= F.col("rest")))
        found = stored(
            crossed.select("group", "rest", (F.col("below") + F.col("up_to") - F.col("words")).alias("below"), F.col("bucket").alias("prefix"), "words", "held"),
            "mix-edges",
        )
        if (found.agg(F.max("held")).first()[0] or 0) <= 1:
            break
    fit = F.floor((F.col("rest") - F.col("below")) * F.col("held") / F.col("words") + 0.5)
    return found.select(
        "group", F.shiftleft("prefix", shift).alias("low"), (F.shiftleft(F.col("prefix") + 1, shift) - 1).alias("high"), "held",
        F.least(F.greatest(fit, F.lit(0)), F.col("held")).alias("fit"),
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, repeats: int = REPEATS,
        seed: str = "mix", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, source_size, target (its source's), copies (0 to repeats), and keep.

    weights are dealt to the sources in order of their names, again and again; share is the part
    of all sizes (as a fraction) that is taken together.
    """
    own = ("doc_id", "size", "source_size", "target", "copies", "group", "hash", "row")
    extra = [c for c in keep if c not in own]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("group"),
        n_words(text).alias("size"), place(F.col("doc_id"), text, seed).alias("hash"), F.monotonically_increasing_id().alias("row"), *extra,
    )
    rows = stored(rows, "mix-rows")
    sources = stored(rows.groupBy("group").agg(F.sum("size").alias("source_size")), "mix-sizes")
    n, name_bytes = sources.agg(F.count("*"), F.sum(F.octet_length("group"))).first()
    few = n <= MOST_SOURCES and (name_bytes or 0) <= MOST_BYTES

    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets(sources, weights, share, repeats).withColumn("whole", whole)
    plan = stored(plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-plan")
    limits = stored(plan.drop("rest").join(edges(rows, plan, few), "group", "left"), "mix-limits")
    placed = _with_limits(rows, limits, few)
    at_edge = F.coalesce(F.col("hash").between(F.col("low"), F.col("high")) & (F.col("size") > 0), F.lit(False))
    split = F.coalesce((F.col("fit") > 0) & (F.col("fit") < F.col("held")), F.lit(False))
    once_more = F.when(at_edge, F.col("fit") == F.col("held")).otherwise(F.coalesce(F.col("hash") < F.col("low"), F.lit(False)))
    if limits.where(split).limit(1).count() == 0:
        taken = placed.withColumn("more", once_more)
    else:  # rows of one hash at a boundary: the first so many
        equal = positions(placed.where(at_edge & split), ["group"], [F.col("hash"), F.col("row")], "_turn")
        taken = placed.where(~(at_edge & split)).withColumn("more", once_more)
        taken = taken.unionByName(equal.withColumn("more", F.col("_turn") < F.col("fit")).drop("_turn"))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(0)
    return taken.select("doc_id", *extra, "size", "source_size", "target", copies.cast("int").alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The rows of mix, each as often as it is taken, with copy (from 0)."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))


_ROUNDS = 16  # of the checking SQL


def _sql_levels() -> str:
    parts = ["lv0 AS MATERIALIZED (SELECT CAST(3 * sum(source_size) AS HUGEINT) AS num, CAST(2 * sum(w) AS HUGEINT) AS den FROM weighed)"]
    for k in range(_ROUNDS):
        parts.append(
            f"""lv{k + 1} AS MATERIALIZED (SELECT CAST(3 * sum(source_size) - 2 * coalesce(sum(2 * source_size) FILTER (WHERE o), 0) AS HUGEINT) AS num,
  CAST(2 * sum(w) FILTER (WHERE NOT o) AS HUGEINT) AS den FROM (SELECT w.*, w * num > 2 * source_size * den AS o FROM weighed w, lv{k}))"""
        )
    return ",\n".join(parts)


#: DuckDB's form: the documents of a source by running sum over their hashes.
ORACLE = f"""WITH rows AS MATERIALIZED (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighed AS MATERIALIZED (SELECT *, ([5, 2, 1])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w FROM sizes),
{_sql_levels()},
plan AS (SELECT source, source_size, CASE WHEN w * num > 2 * source_size * den THEN CAST(2 * source_size AS DOUBLE)
  ELSE CAST(w * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target FROM weighed, lv{_ROUNDS}),
rest AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM plan),
placed AS (SELECT r.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
  CAST(sum(size) OVER (PARTITION BY r.source ORDER BY h, doc_id) - size AS BIGINT) AS before
  FROM rows r JOIN rest p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size = 0 THEN 0 ELSE size * (whole + CASE WHEN before + size <= rest THEN 1
  WHEN before > rest THEN 0 ELSE least(greatest(floor((rest - before) / size + 0.5), 0), 1) END) END AS BIGINT) AS taken FROM placed"""
