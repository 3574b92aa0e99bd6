"""Write-side rules as whole-table jobs: upserts, child replacement, packing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.functions.text import strip, sub
from scholia.operators.ordering import positions


def upsert_by_key(
    base: DataFrame, updates: DataFrame, keys: Sequence[str], keep_if_null: Sequence[str] = ()
) -> DataFrame:
    """Insert or update; ``keep_if_null`` columns keep the old value over a null.

    ``updates`` must hold each key once. Columns absent from it stay as they are.
    """
    old, new = base.alias("o"), updates.withColumn("_in", F.lit(True)).alias("n")
    condition = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    joined = old.join(new, condition, "full_outer")
    columns: list[Column] = []
    for name in base.columns:
        if name in keys or name in keep_if_null:
            value = F.coalesce(f"n.{name}", f"o.{name}")
        elif name in updates.columns:
            value = F.when(F.col("n._in"), F.col(f"n.{name}")).otherwise(F.col(f"o.{name}"))
        else:
            value = F.col(f"o.{name}")
        columns.append(value.alias(name))
    return joined.select(*columns)


def insert_ignore(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = new.dropDuplicates(list(keys)).join(base, list(keys), "left_anti")
    return base.unionByName(fresh)


def resequence(df: DataFrame, parent: str, order: Sequence[Column], name: str = "position") -> DataFrame:
    """Dense 0-based positions per parent, replacing the old ones."""
    if name not in df.columns:
        return positions(df, [parent], order, name)
    numbered = positions(df, [parent], order, "_new")
    return numbered.withColumn(name, F.col("_new")).drop("_new")


def next_position(df: DataFrame, parent: str, position: str = "position") -> DataFrame:
    return df.groupBy(parent).agg((F.max(position) + 1).alias("next_position"))


def swap_positions(
    df: DataFrame, parent: str, parent_value: object, first: int, second: int, position: str = "position"
) -> DataFrame:
    here = F.col(parent) == F.lit(parent_value)
    moved = (
        F.when(here & (F.col(position) == first), F.lit(second))
        .when(here & (F.col(position) == second), F.lit(first))
        .otherwise(F.col(position))
    )
    return df.withColumn(position, moved.cast(df.schema[position].dataType))


def replace_children(
    children: DataFrame, new: DataFrame, parent: str, order: Sequence[Column], position: str = "position"
) -> DataFrame:
    """Drop all children of the touched parents and add the new ones from 0."""
    touched = new.select(parent).distinct()
    kept = children.join(touched, parent, "left_anti")
    numbered = resequence(new, parent, order, position)
    return kept.unionByName(numbered.select(*children.columns))


def write_children(df: DataFrame, path: str, parent_bucket: str) -> None:
    """Sink form of child replacement: overwrite only the buckets present."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        parent_bucket
    ).parquet(path)


def cascade_delete(
    child: DataFrame, deleted_parents: DataFrame, fk: str, mode: str = "cascade", pk: str = "id"
) -> DataFrame:
    """Children after their parents go: removed too, or left with no link."""
    gone = deleted_parents.select(F.col(pk).alias(fk)).distinct()
    if mode == "cascade":
        return child.join(gone, fk, "left_anti")
    if mode != "set_null":
        raise ValueError(f"unknown delete mode {mode!r}")
    marked = child.join(gone.withColumn("_gone", F.lit(True)), fk, "left")
    return marked.withColumn(fk, F.when(F.col("_gone").isNull(), F.col(fk))).select(*child.columns)


def distinct_normalised(df: DataFrame, parent: str, key: str, order: Sequence[Column]) -> DataFrame:
    """First row of each parent's rows that are equal under lower/trim of key.

    A minimum over an ordering struct, so duplicates fold on the map side.
    """
    ranked = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    whole = F.struct(*[F.col(c) for c in df.columns])
    first = df.groupBy(F.col(parent).alias("_p"), F.lower(strip(key)).alias("_k")).agg(
        F.min_by(whole, ranked).alias("_row")
    )
    return first.select("_row.*")


def profile_state_json(mastery: DataFrame) -> DataFrame:
    """One JSON document per user holding the state of each topic.

    A user's map is as large as the number of topics they studied.
    """
    value = F.struct("level", "attempts", "correct")
    entries = F.array_sort(F.collect_list(F.struct(F.col("topic"), value.alias("state"))))
    return mastery.groupBy("user_id").agg(
        F.to_json(F.struct(F.map_from_entries(entries).alias("topicMastery"))).alias("state_json")
    )


def profile_state_from_json(states: DataFrame) -> DataFrame:
    schema = "topicMastery map<string, struct<level:double, attempts:bigint, correct:bigint>>"
    parsed = states.select("user_id", F.from_json("state_json", schema).alias("s"))
    return parsed.select("user_id", F.explode("s.topicMastery").alias("topic", "v")).select(
        "user_id", "topic", "v.level", "v.attempts", "v.correct"
    )


def merge_chunk_results(rows: DataFrame, n: int, doc: str = "doc_id") -> DataFrame:
    """Concatenate per-chunk rows in chunk order, keep n per document, renumber."""
    order = W.partitionBy(doc).orderBy("chunk", "position")
    return (
        rows.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
        .withColumn("position", (F.col("_n") - 1).cast("long"))
        .drop("_n", "chunk")
    )


def merge_summaries(summaries: DataFrame, max_sentences: int, doc: str = "doc_id") -> DataFrame:
    """First sentences over all chunk summaries of a document, in order.

    One chunk keeps its summary as it is; more are cut at ". " and pieces of 20
    characters or fewer are left out.
    """
    # at most max_sentences pieces per document can survive, so cut early
    pieces = summaries.select(
        doc, "chunk", F.posexplode(F.split("summary", r"\. ")).alias("pos", "piece")
    ).where(F.length(strip("piece")) > 20)
    order = W.partitionBy(doc).orderBy("chunk", "pos")
    kept = pieces.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_sentences)
    merged = kept.groupBy(doc).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_n", "piece"))), lambda r: r["piece"]), ". "
        ).alias("merged")
    )
    single = summaries.groupBy(doc).agg(
        F.count("*").alias("_chunks"), F.min_by("summary", "chunk").alias("_only")
    )
    return single.join(merged, doc, "left").select(
        doc,
        F.when(F.col("_chunks") <= 1, F.col("_only")).otherwise(F.coalesce("merged", F.lit(""))).alias("summary"),
    )


def normalise_cards(raw: DataFrame, n: int = 20) -> DataFrame:
    """Clean generated cards: trim, drop blanks and repeats, keep n per document."""
    from scholia.operators.text import sanitise

    cleaned = raw.select(
        "doc_id", "position", sanitise("question").alias("question"), sanitise("answer").alias("answer")
    ).where((F.col("question") != "") & (F.col("answer") != ""))
    unique = distinct_normalised(cleaned, "doc_id", "question", [F.col("position")])
    order = W.partitionBy("doc_id").orderBy("position")
    return (
        unique.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
        .select("doc_id", (F.col("_n") - 1).alias("position"), "question", "answer")
    )


def normalise_quiz(raw: DataFrame, n: int = 12) -> DataFrame:
    """Clean generated quiz rows and re-derive the answer index.

    Blank options go first; two must remain and four are kept. The answer moves
    with its option, or falls back to the first when it was dropped.
    """
    from scholia.operators.text import sanitise

    indexed = F.transform(
        F.coalesce("options", F.array().cast("array<string>")),
        lambda o, i: F.struct(F.coalesce(sanitise(o), F.lit("")).alias("value"), i.alias("old")),
    )
    kept = F.slice(F.filter(indexed, lambda o: o["value"] != ""), 1, 4)
    wanted = F.coalesce(F.col("correct_index"), F.lit(0))
    found = F.array_position(F.transform("_kept", lambda o: o["old"]), wanted.cast("int"))
    ready = (
        raw.withColumn("question", sanitise("question"))
        .withColumn("_kept", kept)
        .where((F.col("question") != "") & (F.size("_kept") >= 2))
        .select(
            "doc_id",
            "position",
            "question",
            F.transform("_kept", lambda o: o["value"]).alias("options"),
            F.greatest(found - 1, F.lit(0)).cast("int").alias("correct_index"),
            sanitise("explanation").alias("explanation"),
        )
    )
    order = W.partitionBy("doc_id").orderBy("position")
    return (
        ready.withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= n)
        .withColumn("position", (F.col("_n") - 1).cast("long"))
        .drop("_n")
    )
