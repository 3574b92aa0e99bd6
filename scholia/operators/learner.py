"""Learner state for all users: streaks, mastery, habits, plans, limits.

A user's or topic's history may be very long, so ordered folds run per time
slice and the slices are then combined; no full history meets in one row.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.operators.containment import contained_in
from scholia.operators.ordering import positions

DAY = 86_400
# The mastery model.
QUIZ_KEEP, QUIZ_GAIN, QUIZ_PASS = 0.7, 0.3, 0.7
CARD_KEEP, CARD_GAIN = 0.8, 0.2
TREND_STEP = 0.05
WEAK_BELOW, STRONG_FROM, NEGLECT_BELOW, NEGLECT_DAYS = 0.5, 0.75, 0.7, 6


def time_slice(ts: Column | str, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5).cast("long")


# --- streaks ----------------------------------------------------------------


def study_days(events: DataFrame) -> DataFrame:
    """One row per (user, day) with activity."""
    return events.select("user_id", F.to_date("ts").alias("day")).distinct()


def study_streaks(events: DataFrame) -> DataFrame:
    """Current and longest run of consecutive study days; +14 progress per day, up to 100."""
    order = W.partitionBy("user_id").orderBy("day")
    runs = (
        study_days(events)
        .withColumn("_run", F.date_sub("day", F.row_number().over(order)))
        .groupBy("user_id", "_run")
        .agg(F.count("*").alias("days"), F.max("day").alias("last_day"))
    )
    return runs.groupBy("user_id").agg(
        F.max_by("days", "last_day").alias("current_streak"),
        F.max("days").alias("longest_streak"),
        F.max("last_day").alias("last_studied_on"),
        F.least(F.lit(100), F.sum("days") * 14).alias("weekly_progress"),
    )


def weekly_progress(events: DataFrame) -> DataFrame:
    return study_days(events).groupBy("user_id").agg(
        F.least(F.lit(100), F.count("*") * 14).cast("long").alias("weekly_progress")
    )


def session_streak(sessions: DataFrame) -> DataFrame:
    """Streak on elapsed 24-hour periods between consecutive sessions.

    Two sessions of one calendar day never differ by a full period, so each
    day is first reduced to its first and last session.
    """
    per_day = sessions.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    by_day = W.partitionBy("user_id").orderBy("day")
    seconds = (F.unix_micros("first_ts") - F.unix_micros(F.lag("last_ts").over(by_day))) / 1_000_000
    gapped = per_day.withColumn("gap", F.floor(seconds / DAY))
    groups = gapped.withColumn(
        "_group", F.sum(F.when(F.col("gap").isNull() | (F.col("gap") > 1), 1).otherwise(0)).over(by_day)
    )
    per_group = groups.groupBy("user_id", "_group").agg(
        (F.count_if(F.col("gap") == 1) + 1).alias("streak")
    )
    # a run restarts at 1; its steps of exactly one period add to it
    return per_group.groupBy("user_id").agg(
        F.max_by("streak", "_group").cast("long").alias("streak_days")
    )


# --- mastery ----------------------------------------------------------------


def topic_mastery(attempts: DataFrame, as_of: str, slice_seconds: int = 7 * DAY) -> DataFrame:
    """Mastery per (user, topic) from ordered attempts (kind quiz|card, ratio).

    Each attempt maps level L to keep*L + gain, so the attempts of a slice
    compose to one such map. Composing those per topic gives the level at the
    start of each slice; a second fold inside the slices then finds the trend.
    Make ``slice_seconds`` shorter where one topic gets very many attempts.
    """
    quiz = F.col("kind") == "quiz"
    hit = F.when(quiz, F.col("ratio") >= QUIZ_PASS).otherwise(F.col("ratio") >= 0.5)
    steps = attempts.select(
        "user_id",
        "topic",
        time_slice("ts", slice_seconds).alias("_slice"),
        F.struct(
            "ts",
            "event_id",
            quiz.alias("quiz"),
            F.when(quiz, F.lit(QUIZ_KEEP)).otherwise(F.lit(CARD_KEEP)).alias("keep"),
            F.when(quiz, F.col("ratio") * QUIZ_GAIN)
            .otherwise(F.when(hit, F.lit(CARD_GAIN)).otherwise(F.lit(0.0)))
            .alias("gain"),
        ).alias("step"),
        hit.alias("hit"),
    )
    sliced = steps.groupBy("user_id", "topic", "_slice").agg(
        F.array_sort(F.collect_list("step")).alias("steps"),
        F.count("*").alias("n"),
        F.count_if("hit").alias("hits"),
        F.max("step.ts").alias("last_ts"),
    )
    affine = F.aggregate(
        "steps",
        F.struct(F.lit(1.0).alias("keep"), F.lit(0.0).alias("gain")),
        lambda m, s: F.struct(
            (m["keep"] * s["keep"]).alias("keep"), (m["gain"] * s["keep"] + s["gain"]).alias("gain")
        ),
    )
    # one small entry per slice of a topic
    per_topic = sliced.select("user_id", "topic", F.struct("_slice", affine.alias("map")).alias("m")).groupBy(
        "user_id", "topic"
    ).agg(F.array_sort(F.collect_list("m")).alias("maps"))
    starts = per_topic.select(
        "user_id",
        "topic",
        F.explode(
            F.aggregate(
                "maps",
                F.struct(
                    F.lit(0.0).alias("level"),
                    F.array().cast("array<struct<_slice:bigint,start:double>>").alias("out"),
                ),
                lambda acc, m: F.struct(
                    (acc["level"] * m["map"]["keep"] + m["map"]["gain"]).alias("level"),
                    F.concat(
                        acc["out"],
                        F.array(F.struct(m["_slice"].alias("_slice"), acc["level"].alias("start"))),
                    ).alias("out"),
                ),
                lambda acc: acc["out"],
            )
        ).alias("s"),
    ).select("user_id", "topic", "s._slice", "s.start")

    def step(acc: Column, s: Column) -> Column:
        level = acc["level"] * s["keep"] + s["gain"]
        change = level - acc["level"]
        trend = (
            F.when(change > TREND_STEP, F.lit("improving"))
            .when(change < -TREND_STEP, F.lit("declining"))
            .when(s["quiz"], F.lit("stable"))
            .otherwise(acc["trend"])  # a card keeps the trend on a small change
        )
        return F.struct(level.alias("level"), trend.alias("trend"))

    folded = sliced.join(starts, ["user_id", "topic", "_slice"]).withColumn(
        "end",
        F.aggregate(
            "steps",
            F.struct(F.col("start").alias("level"), F.lit(None).cast("string").alias("trend")),
            step,
        ),
    )
    return (
        folded.groupBy("user_id", "topic")
        .agg(
            F.max_by("end.level", "_slice").alias("level"),
            F.sum("n").alias("attempts"),
            F.sum("hits").alias("correct"),
            F.max("last_ts").alias("last_reviewed"),
            F.max_by("end.trend", F.when(F.col("end.trend").isNotNull(), F.col("_slice"))).alias("trend"),
        )
        .withColumn("trend", F.coalesce("trend", F.lit("stable")))
        .withColumn(
            "days_since_review",
            F.floor(
                (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros("last_reviewed"))
                / (DAY * 1_000_000)
            ).cast("long"),
        )
    )


def topic_classes(mastery: DataFrame) -> DataFrame:
    """Weak, strong and neglected topics, ranked within (user, class)."""
    level, tries = F.col("level"), F.col("attempts")
    classes = [
        ("weak", (level < WEAK_BELOW) & (tries >= 2), level),
        ("strong", (level >= STRONG_FROM) & (tries >= 2), -level),
        (
            "neglected",
            (F.col("days_since_review") >= NEGLECT_DAYS) & (level < NEGLECT_BELOW) & (tries >= 1),
            F.col("days_since_review").cast("double"),
        ),
    ]
    tagged = F.array_compact(
        F.array(
            *[
                F.when(test, F.struct(F.lit(name).alias("class"), F.round(key, 9).alias("key")))
                for name, test, key in classes
            ]
        )
    )
    order = W.partitionBy("user_id", "c.class").orderBy("c.key", "topic")
    return mastery.withColumn("c", F.explode(tagged)).select(
        "user_id",
        F.col("c.class").alias("class"),
        F.row_number().over(order).alias("rank"),
        "topic",
        "level",
        "attempts",
        "correct",
        "trend",
        "days_since_review",
    )


def preferred_difficulty(attempts: DataFrame) -> DataFrame:
    """From the mean of each user's last five quiz ratios."""
    latest = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last5 = (
        attempts.where(F.col("kind") == "quiz")
        .withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= 5)
    )
    mean = F.round(F.avg("ratio"), 9)
    return last5.groupBy("user_id").agg(
        F.when(mean >= 0.8, "hard").when(mean >= 0.5, "medium").otherwise("easy").alias("difficulty")
    )


def daily_minutes(classes: DataFrame, streaks: DataFrame) -> DataFrame:
    counts = classes.groupBy("user_id").agg(
        F.count_if(F.col("class") == "neglected").alias("n_neglected"),
        F.count_if(F.col("class") == "weak").alias("n_weak"),
    )
    joined = streaks.select("user_id", "streak_days").join(counts, "user_id", "full_outer")
    return joined.select(
        "user_id",
        F.when(F.col("n_neglected") > 3, 35)
        .when(F.col("n_weak") > 2, 30)
        .when(F.col("streak_days") >= 7, 20)
        .otherwise(25)
        .alias("daily_minutes"),
    )


def topic_effort(sessions: DataFrame) -> DataFrame:
    """Minutes and number of sessions per (user, topic); ``topics`` is an array."""
    return sessions.select("user_id", "minutes", F.explode("topics").alias("topic")).groupBy(
        "user_id", "topic"
    ).agg(F.sum("minutes").alias("minutes"), F.count("*").alias("revisions"))


def study_time_profile(sessions: DataFrame, quiz: DataFrame, slice_seconds: int = 7 * DAY) -> DataFrame:
    """Preferred hour, total minutes, and mean session length per user.

    The hour is a moving average rounded at every step, so a slice of sessions
    is a map from 24 hours to 24 hours; the maps compose in order. Minutes of
    quizzes (seconds, rounded up) count in the total but not in the divisor.
    """
    hours = sessions.select(
        "user_id",
        time_slice("ts", slice_seconds).alias("_slice"),
        F.struct("ts", "event_id", F.hour("ts").cast("long").alias("hour")).alias("s"),
        "minutes",
    )
    sliced = hours.groupBy("user_id", "_slice").agg(
        F.array_sort(F.collect_list("s")).alias("list"),
        F.sum("minutes").alias("minutes"),
        F.count("*").alias("n"),
    )
    blend = lambda h, s: half_up(h * 0.8 + s["hour"] * 0.2)
    mapped = sliced.select(
        "user_id",
        "minutes",
        "n",
        F.struct(
            "_slice",
            F.transform(
                F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")),
                lambda h0: F.aggregate("list", h0, blend),
            ).alias("map"),
            F.col("list")[0]["hour"].alias("first"),
        ).alias("m"),
    )
    per_user = mapped.groupBy("user_id").agg(
        F.array_sort(F.collect_list("m")).alias("maps"),
        F.sum("minutes").alias("session_minutes"),
        F.sum("n").alias("sessions"),
    )
    hour = F.aggregate("maps", F.col("maps")[0]["first"], lambda h, m: m["map"][h.cast("int")])
    quizzes = quiz.groupBy("user_id").agg(F.sum(F.ceil(F.col("seconds") / 60)).alias("quiz_minutes"))
    total = F.col("session_minutes") + F.coalesce("quiz_minutes", F.lit(0))
    return per_user.join(quizzes, "user_id", "left").select(
        "user_id",
        hour.alias("preferred_hour"),
        total.alias("total_minutes"),
        (total / F.col("sessions")).alias("average_session"),
    )


# --- limits and expiry ------------------------------------------------------


def trailing_counts(calls: DataFrame, seconds: int) -> DataFrame:
    """Calls the same user made in the ``seconds`` before each call.

    Each call is placed in its time slice and, as context, in the next one, so
    the frame is complete inside (user, slice) and no user is one big group.
    """
    width = seconds * 1_000_000
    micros = F.unix_micros("ts")
    own = F.floor(micros / width).cast("long")
    placed = calls.withColumn("_us", micros).withColumn(
        "_p",
        F.explode(
            F.array(
                F.struct(own.alias("slice"), F.lit(True).alias("own")),
                F.struct((own + 1).alias("slice"), F.lit(False).alias("own")),
            )
        ),
    )
    # ties on time: earlier event ids come first
    at = W.partitionBy("user_id", "_p.slice").orderBy("_us")
    window = at.rangeBetween(-width, 0)
    same = W.partitionBy("user_id", "_p.slice", "_us").orderBy(F.desc("event_id"))
    counted = placed.withColumn(
        "trailing", F.count("*").over(window) - F.row_number().over(same)
    )
    return counted.where("_p.own").drop("_p", "_us")


def rate_limit_audit(calls: DataFrame, k: int = 5, seconds: int = 600) -> DataFrame:
    """Accept or reject each call: rejected once k accepted calls are in the window.

    Rejected calls do not count. A call after a quiet window starts afresh, so
    calls are split into bursts there; one window marks bursts that ever reach k
    calls, and only these are folded, in time order, holding the last k accepted
    times and nothing else.
    """
    dense = trailing_counts(calls.select("event_id", "user_id", "ts"), seconds)
    day = F.to_date("ts")
    start = F.when(F.col("trailing") == 0, F.unix_micros("ts"))
    marked = dense.withColumn("_day", day).withColumn("_start", start)
    per_day = marked.groupBy("user_id", "_day").agg(F.max("_start").alias("_last"))
    before = W.partitionBy("user_id").orderBy("_day").rowsBetween(W.unboundedPreceding, -1)
    carried = per_day.select("user_id", "_day", F.max("_last").over(before).alias("_carry"))
    in_day = W.partitionBy("user_id", "_day").orderBy("ts", "event_id").rowsBetween(
        W.unboundedPreceding, 0
    )
    bursts = marked.withColumn("_in", F.max("_start").over(in_day)).join(
        carried, ["user_id", "_day"]
    ).select("event_id", "user_id", "ts", "trailing", F.coalesce("_in", "_carry").alias("burst"))
    hot = F.max("trailing").over(W.partitionBy("user_id", "burst")) >= k
    return (
        bursts.withColumns({"hot": hot, "us": F.unix_micros("ts")})
        .sortWithinPartitions("user_id", "burst", "us", "event_id")
        .mapInPandas(
            lambda parts: _accept(parts, k, seconds * 1_000_000),
            "event_id long, user_id long, ts timestamp, trailing long, accepted boolean",
        )
    )


def _accept(parts: Iterator[pd.DataFrame], k: int, window: int) -> Iterator[pd.DataFrame]:
    """Streamed over sorted rows; calm bursts pass, of a hot one the last k accepted times are held."""
    current, recent = None, deque(maxlen=k)
    for part in parts:
        accepted = np.ones(len(part), bool)
        for i in np.flatnonzero(part["hot"].to_numpy()):
            key, us = (part["user_id"].iat[i], part["burst"].iat[i]), part["us"].iat[i]
            if key != current:
                current, recent = key, deque(maxlen=k)
            accepted[i] = len(recent) < k or recent[0] < us - window
            if accepted[i]:
                recent.append(us)
        yield part[["event_id", "user_id", "ts", "trailing"]].assign(accepted=accepted)


def expire_stale(materials: DataFrame, as_of: str, minutes: int = 10, updated: str = "created_at") -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    stale = (F.col("status") == "processing") & (F.col(updated) < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return materials.withColumns(
        {
            "status": F.when(stale, "failed").otherwise(F.col("status")),
            updated: F.when(stale, now).otherwise(F.col(updated)),
        }
    )


# --- topics to materials ----------------------------------------------------


def _topic_matches(topics: DataFrame, materials: DataFrame, tag_in_topic: bool) -> DataFrame:
    needles = topics.select(F.lower("topic").alias("needle")).distinct()
    tags = materials.select("id", F.explode("tags").alias("t")).select("id", F.lower("t").alias("body"))
    bodies = materials.select("id", F.lower("title").alias("body")).unionByName(tags)
    if "summary" in materials.columns and tag_in_topic:
        bodies = bodies.unionByName(
            materials.where("summary is not null").select("id", F.lower("summary").alias("body"))
        )
    found = contained_in(needles, bodies)
    if tag_in_topic:
        words = tags.select(F.col("body").alias("needle")).distinct()
        inside = contained_in(words, needles.select(F.col("needle").alias("id"), F.col("needle").alias("body")))
        by_tag = inside.select(F.col("needle").alias("body"), F.col("id").alias("needle"))
        found = found.unionByName(tags.join(by_tag, "body").select("needle", "id"))
    return found.distinct()


def _ranked_matches(topics: DataFrame, materials: DataFrame, tag_in_topic: bool) -> DataFrame:
    matches = _topic_matches(topics, materials, tag_in_topic)
    return positions(matches, ["needle"], [F.col("id")], "_pos")


def _first_outside(topics: DataFrame, ranked: DataFrame, used: DataFrame, fall_back: bool) -> DataFrame:
    """Per (user, topic) the first match the user has not used.

    Of the user's used matches in rank order, those whose rank equals their
    own number form the unbroken head of the list; the next rank is the answer.
    """
    asked = topics.select("user_id", "topic", F.lower("topic").alias("needle")).distinct()
    hits = (
        used.select("user_id", F.col("material_id").alias("id"))
        .distinct()
        .join(ranked, "id")
        .join(asked.select("user_id", "needle").distinct(), ["user_id", "needle"], "left_semi")
    )
    own = W.partitionBy("user_id", "needle").orderBy("_pos")
    head = (
        hits.withColumn("_n", F.row_number().over(own) - 1)
        .where(F.col("_n") == F.col("_pos"))
        .groupBy("user_id", "needle")
        .agg(F.count("*").alias("_skip"))
    )
    sizes = ranked.groupBy("needle").agg(F.count("*").alias("_size"))
    chosen = (
        asked.join(sizes, "needle")
        .join(head, ["user_id", "needle"], "left")
        .withColumn("_skip", F.coalesce("_skip", F.lit(0)))
    )
    free = F.col("_skip") < F.col("_size")
    chosen = chosen.withColumn("_pos", F.when(free, F.col("_skip")).otherwise(F.lit(0)))
    if not fall_back:
        chosen = chosen.where(free)
    return chosen.join(ranked, ["needle", "_pos"]).select(
        "user_id", "topic", F.col("id").alias("material_id")
    )


def topic_material_match(topics: DataFrame, materials: DataFrame, downloads: DataFrame) -> DataFrame:
    """One material per (user, topic): the first not yet downloaded, else the first."""
    ranked = _ranked_matches(topics, materials, True)
    return _first_outside(topics, ranked, downloads, True)


def advanced_material_match(topics: DataFrame, materials: DataFrame, sessions: DataFrame) -> DataFrame:
    """Like the topic match, but never a material the user has studied."""
    ranked = _ranked_matches(topics, materials, False)
    return _first_outside(topics, ranked, sessions, False)


def tag_order(materials: DataFrame) -> DataFrame:
    """Distinct tags by first appearance in catalogue order."""
    first = (
        materials.select("id", F.posexplode("tags").alias("pos", "tag"))
        .groupBy("tag")
        .agg(F.min(F.struct("id", "pos")).alias("first"))
    )
    return positions(first, [], [F.col("first"), F.col("tag")], "tag_pos").select("tag", "tag_pos")


def unexplored_topics(materials: DataFrame, mastery: DataFrame, users: DataFrame, n: int = 3) -> DataFrame:
    """Each user's first n catalogue tags without a mastery row.

    Only the user's own tags are looked at: with m of them known, the first n
    unknown ones are among the first m + n positions.
    """
    order = tag_order(materials)
    known = mastery.select("user_id", F.col("topic").alias("tag")).distinct().join(order, "tag")
    seen = known.groupBy("user_id").agg(F.collect_set("tag_pos").alias("_seen"))
    size = order.agg(F.count("*").alias("n")).scalar()
    per_user = users.select("user_id").distinct().join(seen, "user_id", "left").withColumn(
        "_seen", F.coalesce("_seen", F.array().cast("array<bigint>"))
    ).withColumn("_all", size)
    upto = F.least(F.col("_all"), F.size("_seen") + n)
    missing = F.slice(
        F.array_except(
            F.sequence(F.lit(0).cast("long"), F.greatest(upto - 1, F.lit(0)).cast("long")), "_seen"
        ),
        1,
        n,
    )
    picked = per_user.where("_all > 0").select("user_id", F.posexplode(missing).alias("i", "tag_pos"))
    return picked.join(order, "tag_pos").select(
        "user_id", (F.col("i") + 1).alias("rank"), F.col("tag").alias("topic")
    )


# --- recommendations for learners -------------------------------------------


def adaptive_recommendations(
    classes: DataFrame,
    difficulty: DataFrame,
    materials: DataFrame,
    downloads: DataFrame,
    sessions: DataFrame,
    mastery: DataFrame,
    n_explore: int = 3,
) -> DataFrame:
    """What each user should study next, in priority order."""
    neglected = classes.where((F.col("class") == "neglected") & (F.col("rank") <= 3))
    all_neglected = classes.where(F.col("class") == "neglected").select("user_id", "topic")
    weak = classes.where((F.col("class") == "weak") & (F.col("rank") <= 3)).join(
        all_neglected, ["user_id", "topic"], "left_anti"
    )
    strong = classes.where((F.col("class") == "strong") & (F.col("rank") <= 2))
    users = classes.select("user_id").distinct()
    fresh = unexplored_topics(materials, mastery, users, n_explore)

    columns = ["user_id", "rank", "topic", "level", "days_since_review"]
    asked = (
        neglected.select(*columns, F.lit(0).alias("branch"))
        .unionByName(weak.select(*columns, F.lit(1).alias("branch")))
        .unionByName(
            fresh.select(
                "user_id", "rank", "topic", F.lit(None).cast("double").alias("level"),
                F.lit(None).cast("long").alias("days_since_review"), F.lit(3).alias("branch"),
            )
        )
    )
    found = asked.join(topic_material_match(asked, materials, downloads), ["user_id", "topic"])
    ahead = strong.select(*columns, F.lit(2).alias("branch")).join(
        advanced_material_match(strong, materials, sessions), ["user_id", "topic"]
    )
    percent = half_up(F.round(F.col("level"), 9) * 100).cast("string")
    branch = F.col("branch")

    def pick(*values: object) -> Column:
        out = F.when(branch == 0, values[0])
        for i, value in enumerate(values[1:], 1):
            out = out.when(branch == i, value)
        return out

    reason = pick(
        F.concat(
            F.lit("You haven't revised \""), F.col("topic"), F.lit("\" in "),
            F.col("days_since_review").cast("string"), F.lit(" days. Your mastery is at "), percent, F.lit("%."),
        ),
        F.concat(
            F.lit("You're struggling with \""), F.col("topic"), F.lit("\" ("), percent,
            F.lit("% mastery). Let's strengthen this area."),
        ),
        F.concat(
            F.lit("You've mastered \""), F.col("topic"), F.lit("\" — ready to advance to related content.")
        ),
        F.concat(
            F.lit("Explore something new: \""), F.col("topic"),
            F.lit("\" appears in your course materials but you haven't studied it yet."),
        ),
    )
    titles = materials.select(F.col("id").alias("material_id"), "title")
    order = W.partitionBy("user_id").orderBy("branch", "rank")
    return (
        found.unionByName(ahead)
        .join(titles, "material_id")
        .join(difficulty, "user_id", "left")
        .select(
            "user_id",
            F.row_number().over(order).alias("position"),
            pick(F.lit("critical"), F.lit("high"), F.lit("medium"), F.lit("low")).alias("priority"),
            pick(F.lit("review"), F.lit("remediate"), F.lit("advance"), F.lit("explore")).alias("type"),
            "topic",
            "material_id",
            "title",
            pick(F.lit(15), F.lit(25), F.lit(30), F.lit(20)).alias("minutes"),
            pick(
                F.coalesce("difficulty", F.lit("medium")), F.lit("easy"), F.lit("hard"), F.lit("medium")
            ).alias("difficulty"),
            reason.alias("reason"),
        )
    )


def study_plan(
    recs: DataFrame, classes: DataFrame, minutes: DataFrame, warmups: DataFrame | None = None
) -> DataFrame:
    """One day's sessions per user within the daily budget.

    Warm-up on the strongest topic, up to four recommendations (the last one
    shortened to fit), and a cool-down. ``warmups`` gives the material of the
    warm-up topic (user_id, topic, material_id).
    """
    strongest = classes.where((F.col("class") == "strong") & (F.col("rank") == 1)).select(
        "user_id", "topic"
    )
    if warmups is not None:
        strongest = strongest.join(warmups, ["user_id", "topic"], "left")
    else:
        strongest = strongest.withColumn("material_id", F.lit(None).cast("long"))
    warm = minutes.join(strongest, "user_id").select(
        "user_id",
        F.lit(0).alias("_order"),
        F.lit("warmup").alias("type"),
        F.col("material_id").cast("long"),
        F.concat(F.lit("Quick review: "), "topic").alias("title"),
        F.lit(5).cast("long").alias("duration"),
        "topic",
    )
    warm_minutes = strongest.select("user_id", F.lit(5).alias("_warm"))
    earlier = W.partitionBy("user_id").orderBy("position").rowsBetween(W.unboundedPreceding, -1)
    budgeted = (
        recs.where(F.col("position") <= 4)
        .withColumn("_spent", F.coalesce(F.sum("minutes").over(earlier), F.lit(0)))
        .join(minutes, "user_id")
        .join(warm_minutes, "user_id", "left")
        .withColumn("_left", F.col("daily_minutes") - F.coalesce("_warm", F.lit(0)) - F.col("_spent"))
        .where(F.col("_left") > 0)
    )
    kind = (
        F.when(F.col("type") == "review", "review")
        .when(F.col("type").isin("remediate", "advance"), "learn")
        .otherwise("practice")
    )
    main = budgeted.select(
        "user_id",
        F.col("position").alias("_order"),
        kind.alias("type"),
        F.col("material_id").cast("long"),
        "title",
        F.least("minutes", "_left").cast("long").alias("duration"),
        "topic",
    )
    weak3 = classes.where((F.col("class") == "weak") & (F.col("rank") <= 3)).groupBy("user_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "topic"))), lambda w: w["topic"]), ", "
        ).alias("topic")
    )
    spent = warm.unionByName(main).groupBy("user_id").agg(F.sum("duration").alias("_total"))
    cool = (
        minutes.join(spent, "user_id", "left")
        .where(F.coalesce("_total", F.lit(0)) < F.col("daily_minutes") + 5)
        .join(weak3, "user_id", "left")
        .select(
            "user_id",
            F.lit(99).alias("_order"),
            F.lit("cooldown").alias("type"),
            F.lit(None).cast("long").alias("material_id"),
            F.lit("Flashcard practice").alias("title"),
            F.lit(5).cast("long").alias("duration"),
            F.coalesce("topic", F.lit("")).alias("topic"),
        )
    )
    order = W.partitionBy("user_id").orderBy("_order")
    return (
        warm.unionByName(main)
        .unionByName(cool)
        .withColumn("position", F.row_number().over(order))
        .drop("_order")
    )


def plan_goal(classes: DataFrame, users: DataFrame) -> DataFrame:
    """Focus topic and goal sentence of each user's plan."""
    counts = classes.groupBy("user_id").agg(
        F.count_if(F.col("class") == "neglected").alias("n_neglected"),
        F.count_if(F.col("class") == "weak").alias("n_weak"),
        F.min_by("topic", F.when(F.col("class") == "neglected", F.col("rank"))).alias("_n1"),
        F.min_by("topic", F.when(F.col("class") == "weak", F.col("rank"))).alias("_w1"),
    )
    goal = (
        F.when(
            F.col("n_neglected") > 0,
            F.concat(F.lit("Catch up on "), F.col("n_neglected").cast("string"), F.lit(" neglected topics")),
        )
        .when(
            F.col("n_weak") > 0,
            F.concat(F.lit("Improve "), F.col("n_weak").cast("string"), F.lit(" weak areas")),
        )
        .otherwise("Maintain and advance your knowledge")
    )
    return users.join(counts, "user_id", "left").select(
        "user_id",
        F.coalesce("_n1", "_w1", F.lit("general study")).alias("focus"),
        goal.alias("goal"),
    )


def student_insights(classes: DataFrame, streaks: DataFrame, habits: DataFrame) -> DataFrame:
    """Rule rows about each user's learning."""
    percent = half_up(F.round("level", 9) * 100).cast("string")

    def rows(df: DataFrame, rank: int, type_: str, title: Column, text: Column, priority: str) -> DataFrame:
        return df.select(
            "user_id", F.lit(rank).alias("section"), F.col("rank").alias("rank"), F.lit(type_).alias("type"),
            title.alias("title"), text.alias("description"), F.lit(priority).alias("priority"),
        )

    def of(name: str, upto: int) -> DataFrame:
        return classes.where((F.col("class") == name) & (F.col("rank") <= upto))

    topic, tries = F.col("topic"), F.col("attempts").cast("string")
    strength = rows(
        of("strong", 3), 1, "strength", F.concat(F.lit("Strong: "), topic),
        F.concat(
            F.lit("You've achieved "), percent, F.lit("% mastery on "), topic, F.lit(" across "), tries,
            F.lit(" attempts. Your performance is "), F.col("trend"), F.lit("."),
        ), "info",
    )
    weakness = rows(
        of("weak", 3), 2, "weakness", F.concat(F.lit("Needs work: "), topic),
        F.concat(
            F.lit("Your mastery on "), topic, F.lit(" is "), percent, F.lit("%. You've gotten "),
            F.col("correct").cast("string"), F.lit(" out of "), tries, F.lit(" attempts correct."),
        ), "high",
    )
    warning = rows(
        of("neglected", 2), 3, "warning", F.concat(F.lit("Neglected: "), topic),
        F.concat(
            F.lit("You haven't reviewed "), topic, F.lit(" in "), F.col("days_since_review").cast("string"),
            F.lit(" days. Knowledge decay starts after 6 days without review."),
        ), "high",
    )
    days = F.col("streak_days").cast("string")
    achievement = rows(
        streaks.where(F.col("streak_days") >= 7).withColumn("rank", F.lit(1)), 4, "achievement",
        F.concat(days, F.lit("-day streak!")),
        F.concat(F.lit("You've studied every day for "), days, F.lit(" consecutive days. Keep it up!")), "info",
    )
    hour = F.col("preferred_hour")
    period = F.when(hour < 12, "morning").when(hour < 17, "afternoon").otherwise("evening")
    pattern = rows(
        habits.withColumn("rank", F.lit(1)), 5, "pattern",
        F.concat(F.lit("You're a "), period, F.lit(" studier")),
        F.concat(
            F.lit("You tend to study around "), hour.cast("string"), F.lit(":00. Your average session is "),
            half_up(F.round("average_session", 6)).cast("string"), F.lit(" minutes."),
        ), "low",
    )
    many = classes.where(F.col("class") == "weak").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 3")
    suggestion = rows(
        many.withColumn("rank", F.lit(1)), 6, "suggestion", F.lit("Focus strategy"),
        F.concat(
            F.lit("You have "), F.col("n").cast("string"),
            F.lit(" weak topics. Rather than spreading your time, focus on 1-2 per session for deeper learning."),
        ), "medium",
    )
    out = strength
    for part in (weakness, warning, achievement, pattern, suggestion):
        out = out.unionByName(part)
    return out
