"""Uniform shuffle into shards of exact size by a communication matrix (operator 10).

Rows fall into a fixed number of buckets by hash. From the bucket counts alone the driver
draws how many rows each bucket sends to each shard (sequential hypergeometric draws, so
every assignment of rows to shards of these sizes is equally likely). Each bucket permutes
its rows and cuts them by its line of the matrix; after the exchange each shard permutes
again, in parts, for the slots. Only narrow columns are shuffled unless keep asks for more.

Law: rows. Shard sizes are at most one apart.

Defined results: null text counts as empty (size 1, crc32 0); a null doc_id is a key like
any other; repeated rows are rows of their own; an empty table gives no rows; other columns
are ignored unless named in keep. Equal input gives equal output for a seed, whatever the
partitions are; rows equal in all columns are interchangeable.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import stored

#: Buckets of the exchange, and parts that each shard is ordered in: the driver holds
#: BUCKETS x shards counts at any size of input.
BUCKETS = 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of drawn items are good: inversion outward from the mode, at any population size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    mode = min(max((drawn + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, drawn - mode) - log_choose(good + bad, drawn))
    u, left, right, below, above = rng.random() - p, mode, mode, p, p
    if u <= 0:
        return mode
    while left > low or right < high:
        if right < high:
            above *= (good - right) * (drawn - right) / ((right + 1) * (bad - drawn + right + 1))
            right += 1
            u -= above
            if u <= 0:
                return right
        if left > low:
            below *= left * (bad - drawn + left) / ((good - left + 1) * (drawn - left + 1))
            left -= 1
            u -= below
            if u <= 0:
                return left
        if above == 0 and below == 0:
            break
    return mode  # what rounding has left over


def communication_matrix(counts: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """How many rows of each bucket go to each shard; columns sum to the shards' sizes, lines to counts."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    lines = []
    for count in counts:
        line, left, population = [], count, sum(room)
        for s in range(n_shards):
            population -= room[s]
            k = hypergeometric(rng, room[s], population, left)
            line.append(k)
            left -= k
        room = [r - k for r, k in zip(room, line)]
        lines.append(line)
    return lines


def shard(documents: DataFrame, n_shards: int = 8, seed: int = 7, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard (0 to n_shards - 1), slot (0 on, without gaps), and keep."""
    spark = documents.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    extra = [c for c in keep if c not in ("doc_id", "size", "text_crc32", "shard", "slot")]

    def scrambled(step: int):
        return F.xxhash64(F.lit(seed), F.lit(step), "doc_id", "text_crc32", "size")

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), *extra,
    ).withColumn("bucket", F.pmod(scrambled(0), F.lit(BUCKETS)).cast("int"))
    rows = stored(rows, "shard-rows")

    held = {r["bucket"]: r["n"] for r in rows.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([held.get(b, 0) for b in range(BUCKETS)], n_shards, seed)
    bounds = spark.createDataFrame(
        [(b, np.cumsum(line).tolist()) for b, line in enumerate(matrix)], "bucket int, bounds array<bigint>"
    ).coalesce(1)

    ties = ["doc_id", "text_crc32", "size", *extra]
    local = Window.partitionBy("bucket").orderBy(scrambled(1), *ties)
    placed = (
        rows.withColumn("place", F.row_number().over(local))
        .join(F.broadcast(bounds), "bucket")  # BUCKETS lines
        .withColumn("shard", F.size(F.filter("bounds", lambda b: b < F.col("place"))))
        .drop("bounds")
        .withColumn("part", F.pmod(scrambled(2), F.lit(BUCKETS)).cast("int"))
    )
    placed = stored(placed, "shard-placed")
    ahead = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .drop("n")
    )
    within = Window.partitionBy("shard", "part").orderBy(scrambled(3), "bucket", "place")
    return (
        placed.withColumn("within", F.row_number().over(within))
        .join(before, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", *extra, "shard", (F.col("before") + F.col("within") - 1).alias("slot"))
    )
