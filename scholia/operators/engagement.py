"""Engagement and coverage roll-ups over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.operators.catalog import PUBLISHED, visible


def popular_courses(materials: DataFrame, courses: DataFrame, n: int = 6) -> DataFrame:
    """Courses by downloads + likes of visible materials, topped up by code.

    A course with a visible material ranks even at score 0, before the top-up.
    """
    scores = (
        visible(materials)
        .where(F.col("course_code").isNotNull())
        .groupBy(F.col("course_code").alias("code"))
        .agg(F.sum(F.coalesce("download_count", F.lit(0)) + F.coalesce("likes_count", F.lit(0))).alias("score"))
    )
    return (
        courses.join(scores, "code", "left")
        .withColumn("ranked", F.col("score").isNotNull())
        .orderBy(F.desc("ranked"), F.col("score").desc_nulls_last(), "code")
        .limit(n)
    )


def course_material_stats(materials: DataFrame) -> DataFrame:
    """Visible materials and their distinct types per course."""
    per_type = (
        visible(materials)
        .where(F.col("course_code").isNotNull())
        .groupBy("course_code", "type")
        .agg(F.count("*").alias("n"))
    )
    # one row per distinct type, so the collected list is the type vocabulary
    return per_type.groupBy("course_code").agg(
        F.sum("n").alias("n_materials"), F.array_sort(F.collect_list("type")).alias("types")
    )


def programme_rollup(programmes: DataFrame, courses: DataFrame, materials: DataFrame) -> DataFrame:
    """Courses and visible materials per programme and course, with subtotals."""
    per_course = visible(materials).groupBy(F.col("course_code").alias("code")).agg(F.count("*").alias("m"))
    base = (
        courses.select("code", "programme_code")
        .join(programmes.select(F.col("code").alias("programme_code"), "name"), "programme_code", "left")
        .join(per_course, "code", "left")
    )
    return base.rollup("programme_code", "code").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count("*").alias("n_courses"),
        F.sum(F.coalesce("m", F.lit(0))).alias("n_materials"),
    )


def admin_overview(
    materials: DataFrame, requests: DataFrame, profiles: DataFrame, programmes: DataFrame
) -> DataFrame:
    """Headline counts, one row per measure."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "n")

    by_status = materials.where(F.col("status").isin("ready", "failed")).groupBy("status").agg(
        F.count("*").alias("n")
    )
    named = F.when(F.col("status") == "ready", "materials_ready").otherwise("materials_failed")
    return (
        by_status.select(named.alias("measure"), "n")
        .unionByName(one("open_requests", requests.where(F.col("status") == "open")))
        .unionByName(one("students", profiles))
        .unionByName(one("programmes", programmes))
    )


def generation_coverage(materials: DataFrame, cards: DataFrame, quiz: DataFrame) -> DataFrame:
    """Visible and idle materials, and how many have cards or a quiz at all.

    Cards and quiz counts include materials that are not visible.
    """
    shown = visible(materials, PUBLISHED).agg(
        F.count("*").alias("visible_count"),
        F.count_if((F.col("download_count") == 0) & (F.col("likes_count") == 0)).alias("no_engagement"),
    )
    with_cards = cards.agg(F.count_distinct("material_id").alias("n")).scalar()
    with_quiz = quiz.agg(F.count_distinct("material_id").alias("n")).scalar()
    return shown.select("*", with_cards.alias("with_cards"), with_quiz.alias("with_quiz"))


def recount_likes(materials: DataFrame, likes: DataFrame) -> DataFrame:
    counts = likes.groupBy(F.col("material_id").alias("id")).agg(F.count("*").alias("n"))
    return materials.select("id").join(counts, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).cast("long").alias("likes_count")
    )


def toggle_replay(toggles: DataFrame) -> DataFrame:
    """Live likes per item: a user likes an item after an odd number of toggles."""
    state = toggles.groupBy("user_id", "material_id").agg((F.count("*") % 2).alias("on"))
    return state.groupBy("material_id").agg(F.sum("on").alias("likes"))


def download_counts(events: DataFrame, materials: DataFrame) -> DataFrame:
    """Downloads per item, counting before the join so hot items stay small."""
    counts = (
        events.where(F.col("kind") == "download").groupBy("material_id").agg(F.count("*").alias("downloads"))
    )
    public = visible(materials).select(F.col("id").alias("material_id"))
    return counts.join(public, "material_id", "left_semi")


def quiz_scores(answers: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Score per attempt; an unanswered question is wrong.

    answers (attempt_id, question_id, choice), questions (quiz_id, question_id,
    position, question, correct_index), attempts (attempt_id, quiz_id).
    """
    sheet = attempts.join(questions, "quiz_id").join(answers, ["attempt_id", "question_id"], "left")
    right = F.coalesce(F.col("choice") == F.col("correct_index"), F.lit(False))
    missed = F.when(~right, F.struct("position", "question"))
    # bounded by the number of questions of one quiz
    return sheet.groupBy("attempt_id").agg(
        F.count_if(right).alias("score"),
        F.count("*").alias("total"),
        F.transform(F.array_sort(F.collect_list(missed)), lambda m: m["question"]).alias("wrong_questions"),
    )


def quiz_average(attempts: DataFrame, order: str = "event_id") -> DataFrame:
    """Mean of score/total over a user's attempts, as a rounded percentage.

    The ratios count as added one by one by ``order``, a unique column: a mean on half a per cent
    is rounded by the order of its sum. Sums combine on the map side; only users so near a half
    that another order could round them otherwise have their attempts sorted and added in order.
    """
    ratio = F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0)
    marks = attempts.select("user_id", order, ratio.alias("ratio"))
    totals = marks.groupBy("user_id").agg(
        F.count("*").alias("n_attempts"), F.avg("ratio").alias("mean"), F.avg(F.abs("ratio")).alias("size")
    )
    percent = F.col("mean") * 100 + 0.5
    # two orders of n doubles differ by less than 2n rounding errors (1.1e-16) of their absolute sum
    slack = (F.col("n_attempts") + 1) * 1e-15 * (F.col("size") * 100 + 1)
    doubtful = F.abs(percent - F.rint(percent)) <= slack
    close = totals.where(doubtful).select(F.col("user_id").alias("_close"))
    so_far = W.partitionBy("user_id").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    in_order = (
        marks.join(close, F.col("user_id").eqNullSafe(F.col("_close")), "left_semi")
        .withColumn("_sum", F.sum("ratio").over(so_far))
        .groupBy(F.col("user_id").alias("_user"))
        .agg((F.max_by("_sum", order) / F.count("ratio")).alias("_mean"))
    )
    # asked again here, so that both uses of the totals need the same columns and share one shuffle
    mean = F.when(doubtful, F.coalesce("_mean", "mean")).otherwise(F.col("mean"))
    return totals.join(in_order, F.col("user_id").eqNullSafe(F.col("_user")), "left").select(
        "user_id", "n_attempts", F.floor(mean * 100 + 0.5).cast("long").alias("average_pct")
    )


def recent_distinct(events: DataFrame, n: int | None = 15, item: str = "material_id") -> DataFrame:
    """Each user's last n distinct items, newest first (ties by event order)."""
    last = events.groupBy("user_id", item).agg(F.max(F.struct("ts", "event_id")).alias("last"))
    newest = W.partitionBy("user_id").orderBy(F.desc("last"))
    ranked = last.withColumn("rank", F.row_number().over(newest))
    if n is not None:
        ranked = ranked.where(F.col("rank") <= n)
    return ranked.select("user_id", "rank", item)


def focus_courses(attempts: DataFrame, downloads: DataFrame, materials: DataFrame, k: int = 2) -> DataFrame:
    """A user's top courses by quiz attempts plus recent downloads, with 2+ hits."""
    course = materials.where(F.col("course_code").isNotNull()).select(
        F.col("id").alias("material_id"), "course_code"
    )
    # count per (user, item) first: the join then meets each pair once
    quiz = attempts.groupBy("user_id", "material_id").agg(F.count("*").alias("n"))
    recent = recent_distinct(downloads, 15).select("user_id", "material_id", F.lit(1).cast("long").alias("n"))
    tally = (
        quiz.unionByName(recent)
        .join(course, "material_id")
        .groupBy("user_id", "course_code")
        .agg(F.sum("n").alias("hits"))
        .where(F.col("hits") >= 2)
    )
    best = W.partitionBy("user_id").orderBy(F.desc("hits"), "course_code")
    return tally.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def library_stats(library: DataFrame) -> DataFrame:
    return library.groupBy("user_id").agg(
        F.count("*").alias("items"),
        F.sum(F.coalesce("size_bytes", F.lit(0))).alias("bytes"),
        F.count_if(F.col("size_bytes").isNotNull()).alias("files"),
    )


def recent_library(library: DataFrame, n: int | None = None) -> DataFrame:
    """A user's saved items by last use."""
    touched = F.coalesce("last_opened_at", "saved_at")
    order = W.partitionBy("user_id").orderBy(touched.desc(), "material_id")
    ranked = library.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n) if n is not None else ranked


def recent_courses(library: DataFrame, materials: DataFrame, n: int = 5) -> DataFrame:
    """The first n distinct courses over a user's items, most recent first."""
    course = materials.where(F.col("course_code").isNotNull()).select(
        F.col("id").alias("material_id"), "course_code"
    )
    touched = F.coalesce("last_opened_at", "saved_at")
    latest = (
        library.join(course, "material_id")
        .groupBy("user_id", "course_code")
        .agg(F.max(F.struct(touched.alias("t"), (-F.col("material_id")).alias("m"))).alias("last"))
    )
    order = W.partitionBy("user_id").orderBy(F.desc("last"), "course_code")
    return (
        latest.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("user_id", "rank", "course_code")
    )


def stale_items(library: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    touched = F.coalesce("last_opened_at", "saved_at")
    return library.where(touched < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def bundle_pages(pages: DataFrame) -> DataFrame:
    """One document per bundle from its ordered pages (bundle_id, page, text, quality, confidence)."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    readable = F.count_if(F.col("quality") != "none")
    missing = F.count("*") - readable
    return pages.groupBy("bundle_id").agg(
        F.array_join(
            F.transform(
                ordered, lambda p, i: F.concat(F.lit("[Page "), i + 1, F.lit("]\n"), F.coalesce(p["text"], F.lit("")))
            ),
            "\n\n",
        ).alias("text"),
        F.count("*").alias("n_pages"),
        readable.alias("readable_pages"),
        F.min("confidence").alias("confidence"),
        F.when(
            missing > 0,
            F.concat(
                missing.cast("string"), F.lit(" of "), F.count("*").cast("string"),
                F.lit(" pages didn't have any readable text."),
            ),
        ).alias("note"),
    )
