"""Constraints as audits: each returns the rows that break a rule."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_rules(df: DataFrame, key: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows breaking a rule, one per (row, rule). A null result passes, as in SQL."""
    broken = F.array(
        *[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]
    )
    return df.select(key, F.explode(F.array_compact(broken)).alias("rule"))


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign-key values without a parent, and how many rows hold each."""
    used = child.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count("*").alias("n_rows"))
    return used.join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)


# Stage labels in the order in which messages are joined.
STAGES = [("summary", "Summary"), ("flashcards", "Flashcards"), ("quiz", "Quiz")]


def stage_summary(stages: DataFrame) -> DataFrame:
    """Overall status per item from its stage outcomes (item_id, stage, ok, message)."""
    label = F.lit(None).cast("string")
    rank = F.lit(None).cast("int")
    for i, (stage, text) in enumerate(STAGES):
        label = F.when(F.col("stage") == stage, F.lit(text)).otherwise(label)
        rank = F.when(F.col("stage") == stage, F.lit(i)).otherwise(rank)
    note = F.when(
        ~F.col("ok"),
        F.struct(
            rank.alias("rank"),
            F.concat(label, F.lit(": "), F.coalesce("message", F.lit("Generation failed."))).alias("note"),
        ),
    )
    # three stages per item at most, so the list is short
    notes = F.array_sort(F.collect_list(note))
    return stages.groupBy("item_id").agg(
        F.when(F.bool_or("ok"), "ready").otherwise("failed").alias("status"),
        F.nullif(F.array_join(F.transform(notes, lambda x: x["note"]), " · "), F.lit("")).alias("note"),
    )
