"""Queries over learner histories: streaks, mastery, plans, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import learner as l
from scholia.operators import writes as w
from scholia.operators.containment import contained_in
from scholia.plans.duck import sql
from scholia.plans.registry import register
from scholia.session import cut_lineage
from scholia.sources.tables import Catalog

AS_OF = "2024-01-31 00:00:00"
LIMIT_K, LIMIT_WINDOW = 5, 86_400

# --- checking SQL shared by several queries ---------------------------------

DAYS = "SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM study_events"
SESSIONS = "SELECT * FROM study_events WHERE kind = 'session'"
ATTEMPT_SEQ = """
    SELECT *, row_number() OVER (PARTITION BY user_id, topic ORDER BY ts, event_id) AS rn,
           CASE WHEN kind = 'quiz' THEN ratio >= 0.7 ELSE ratio >= 0.5 END AS hit FROM {attempts}"""
MASTERY_STEPS = """
    SELECT user_id, topic, rn, 0.0::DOUBLE AS before, (CASE WHEN kind = 'quiz' THEN 0.3::DOUBLE * ratio ELSE 0.2::DOUBLE * hit::INT END) AS level,
      CASE WHEN (CASE WHEN kind = 'quiz' THEN 0.3::DOUBLE * ratio ELSE 0.2::DOUBLE * hit::INT END) > 0.05 THEN 'improving' ELSE 'stable' END AS trend
    FROM attempt_seq WHERE rn = 1
    UNION ALL
    SELECT n.user_id, n.topic, n.rn, m.level,
      CASE WHEN n.kind = 'quiz' THEN m.level * 0.7::DOUBLE + n.ratio * 0.3::DOUBLE ELSE m.level * 0.8::DOUBLE + n.hit::INT * 0.2::DOUBLE END AS lv,
      CASE WHEN lv > m.level + 0.05 THEN 'improving' WHEN lv < m.level - 0.05 THEN 'declining'
           WHEN n.kind = 'quiz' THEN 'stable' ELSE m.trend END
    FROM mastery_steps m JOIN attempt_seq n ON n.user_id = m.user_id AND n.topic = m.topic AND n.rn = m.rn + 1"""
MASTERY = """
    SELECT s.user_id, s.topic, arg_max(m.level, s.rn) AS level, count(*) AS attempts, count(*) FILTER (WHERE s.hit) AS correct,
      max(s.ts) AS last_reviewed, arg_max(m.trend, s.rn) AS trend,
      CAST(floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(s.ts))) / 86400000000) AS BIGINT) AS days_since_review
    FROM attempt_seq s JOIN mastery_steps m USING (user_id, topic, rn) GROUP BY s.user_id, s.topic"""
CLASSES = """
    SELECT user_id, class, row_number() OVER (PARTITION BY user_id, class ORDER BY key, topic) AS rank, topic, level, attempts, correct,
           trend, days_since_review FROM (
      SELECT *, 'weak' AS class, round(level, 9) AS key FROM mastery WHERE level < 0.5 AND attempts >= 2
      UNION ALL SELECT *, 'strong', round(-level, 9) FROM mastery WHERE level >= 0.75 AND attempts >= 2
      UNION ALL SELECT *, 'neglected', CAST(days_since_review AS DOUBLE) FROM mastery
        WHERE days_since_review >= 6 AND level < 0.7 AND attempts >= 1)"""
DIFFICULTY = """
    SELECT user_id, CASE WHEN m >= 0.8 THEN 'hard' WHEN m >= 0.5 THEN 'medium' ELSE 'easy' END AS difficulty FROM (
      SELECT user_id, round(avg(ratio), 9) AS m FROM (SELECT * FROM attempts_in WHERE kind = 'quiz'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5) GROUP BY user_id)"""
SESSION_STREAK = """
    SELECT user_id, CAST(arg_max(streak, g) AS BIGINT) AS streak_days FROM (
      SELECT user_id, g, count(*) FILTER (WHERE gap = 1) + 1 AS streak FROM (
        SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
          SELECT *, floor((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 86400000000) AS gap
          FROM sessions)) GROUP BY user_id, g) GROUP BY user_id"""
MINUTES = """
    SELECT user_id, CASE WHEN n_neglected > 3 THEN 35 WHEN n_weak > 2 THEN 30 WHEN streak_days >= 7 THEN 20 ELSE 25 END AS daily_minutes
    FROM session_streak FULL OUTER JOIN (SELECT user_id, count(*) FILTER (WHERE class = 'neglected') AS n_neglected,
      count(*) FILTER (WHERE class = 'weak') AS n_weak FROM classes GROUP BY user_id) USING (user_id)"""
HOUR_STEPS = """
    SELECT user_id, rn, hour FROM hour_seq WHERE rn = 1
    UNION ALL
    SELECT n.user_id, n.rn, CAST(floor(h.hour * 0.8::DOUBLE + n.hour * 0.2::DOUBLE + 0.5) AS BIGINT) FROM hour_steps h
    JOIN hour_seq n ON n.user_id = h.user_id AND n.rn = h.rn + 1"""
HABITS = """
    SELECT s.user_id, s.preferred_hour, s.session_minutes + coalesce(q.quiz_minutes, 0) AS total_minutes,
      (s.session_minutes + coalesce(q.quiz_minutes, 0)) / s.n AS average_session
    FROM (SELECT user_id, arg_max(st.hour, rn) AS preferred_hour, sum(minutes) AS session_minutes, count(*) AS n
          FROM hour_seq JOIN hour_steps st USING (user_id, rn) GROUP BY user_id) s
    LEFT JOIN (SELECT user_id, CAST(sum(ceil(minutes * 10 / 60)) AS BIGINT) AS quiz_minutes FROM study_events WHERE kind = 'quiz' GROUP BY user_id) q
    USING (user_id)"""
MATCHES = """
    SELECT DISTINCT a.user_id, a.topic, m.id FROM (SELECT DISTINCT user_id, topic FROM asked) a JOIN materials m ON
      contains(lower(m.title), lower(a.topic))
      OR len(list_filter(m.tags, lambda x: contains(lower(x), lower(a.topic)) OR contains(lower(a.topic), lower(x)))) > 0"""
MATCHED = """
    SELECT user_id, topic, id AS material_id FROM (SELECT x.*, d.material_id IS NOT NULL AS used FROM matches x
      LEFT JOIN (SELECT DISTINCT user_id, material_id FROM study_events WHERE kind = 'download') d
      ON d.user_id = x.user_id AND d.material_id = x.id)
    QUALIFY row_number() OVER (PARTITION BY user_id, topic ORDER BY used, id) = 1"""
ADVANCED = """
    SELECT a.user_id, a.topic, min(m.id) AS material_id FROM (SELECT DISTINCT user_id, topic FROM asked_up) a JOIN materials m ON
      contains(lower(m.title), lower(a.topic)) OR len(list_filter(m.tags, lambda x: contains(lower(x), lower(a.topic)))) > 0
    WHERE NOT EXISTS (SELECT 1 FROM study_events s WHERE s.kind = 'session' AND s.user_id = a.user_id AND s.material_id = m.id)
    GROUP BY a.user_id, a.topic"""
TAG_ORDER = """
    SELECT tag, row_number() OVER (ORDER BY id, pos) AS n FROM (SELECT id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM materials)
    QUALIFY row_number() OVER (PARTITION BY tag ORDER BY id, pos) = 1"""
UNEXPLORED = """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY n) AS rank, tag AS topic
    FROM (SELECT DISTINCT user_id FROM classes) u CROSS JOIN (SELECT tag, row_number() OVER (ORDER BY n) AS n FROM tag_order) t
    WHERE NOT EXISTS (SELECT 1 FROM mastery m WHERE m.user_id = u.user_id AND m.topic = t.tag)
    QUALIFY rank <= 3"""
WORDED = """
    SELECT event_id, user_id, ts, CASE topic WHEN 't0' THEN 'ring' WHEN 't1' THEN 'bolt' ELSE 'wid' END AS topic, ratio, kind
    FROM attempts"""
BRANCHES = """
    SELECT user_id, rank, topic, level, days_since_review, 0 AS branch FROM classes WHERE class = 'neglected' AND rank <= 3
    UNION ALL
    SELECT user_id, rank, topic, level, days_since_review, 1 FROM classes c WHERE class = 'weak' AND rank <= 3
      AND NOT EXISTS (SELECT 1 FROM classes o WHERE o.class = 'neglected' AND o.user_id = c.user_id AND o.topic = c.topic)
    UNION ALL SELECT user_id, rank, topic, NULL, NULL, 3 FROM unexplored"""
RECS = """
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY branch, rank) AS position,
      ['critical', 'high', 'medium', 'low'][branch + 1] AS priority, ['review', 'remediate', 'advance', 'explore'][branch + 1] AS type,
      topic, material_id, m.title, [15, 25, 30, 20][branch + 1] AS minutes,
      [coalesce(difficulty, 'medium'), 'easy', 'hard', 'medium'][branch + 1] AS difficulty,
      CASE branch
        WHEN 0 THEN 'You haven''t revised "' || topic || '" in ' || days_since_review || ' days. Your mastery is at ' || pct || '%.'
        WHEN 1 THEN 'You''re struggling with "' || topic || '" (' || pct || '% mastery). Let''s strengthen this area.'
        WHEN 2 THEN 'You''ve mastered "' || topic || '" — ready to advance to related content.'
        ELSE 'Explore something new: "' || topic || '" appears in your course materials but you haven''t studied it yet.' END AS reason
    FROM (SELECT *, CAST(floor(round(level, 9) * 100 + 0.5) AS BIGINT) AS pct FROM (
      SELECT b.*, x.material_id FROM branches b JOIN matched x USING (user_id, topic)
      UNION ALL SELECT s.user_id, s.rank, s.topic, s.level, s.days_since_review, 2, x.material_id FROM asked_up s JOIN advanced x USING (user_id, topic)))
    JOIN (SELECT id, title FROM materials) m ON m.id = material_id LEFT JOIN difficulty USING (user_id)"""
CTES = dict(
    attempt_seq=ATTEMPT_SEQ.format(attempts="attempts_in"),
    mastery_steps=MASTERY_STEPS,
    mastery=MASTERY,
    classes=CLASSES,
    difficulty=DIFFICULTY,
    sessions=SESSIONS,
    session_streak=SESSION_STREAK,
    minutes_of=MINUTES,
    hour_seq="SELECT *, hour(ts) AS hour, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM sessions",
    hour_steps=HOUR_STEPS,
    habits=HABITS,
    matches=MATCHES,
    matched=MATCHED,
    advanced=ADVANCED,
    tag_order=TAG_ORDER,
    unexplored=UNEXPLORED,
    branches=BRANCHES,
    asked="SELECT * FROM branches",
    asked_up="SELECT * FROM classes WHERE class = 'strong' AND rank <= 2",
    recs=RECS,
)
PLAIN = {**CTES, "attempts_in": "SELECT * FROM attempts"}
WORDS = {**CTES, "attempts_in": WORDED}


def _worded(t: Catalog):
    """Attempts whose topics are words of material titles."""
    word = F.when(F.col("topic") == "t0", "ring").when(F.col("topic") == "t1", "bolt").otherwise("wid")
    return t.attempts.withColumn("topic", word)


def _sessions(t: Catalog):
    return t.study_events.where("kind = 'session'")


def _quiz_seconds(t: Catalog):
    return t.study_events.where("kind = 'quiz'").select("user_id", (F.col("minutes") * 10).alias("seconds"))


def _mastery(t: Catalog, attempts=None):
    return l.topic_mastery(t.attempts if attempts is None else attempts, AS_OF)


# --- queries ----------------------------------------------------------------


@register(
    "study_streaks",
    sql(
        """SELECT user_id, arg_max(days, last_day) AS current_streak, max(days) AS longest_streak, max(last_day) AS last_studied_on,
             CAST(least(100, sum(days) * 14) AS BIGINT) AS weekly_progress
           FROM (SELECT user_id, count(*) AS days, max(day) AS last_day FROM
             (SELECT *, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INT) AS g FROM study_days) GROUP BY user_id, g)
           GROUP BY user_id""",
        study_days=DAYS,
    ),
)
def _(t: Catalog):
    return l.study_streaks(t.study_events)


@register(
    "weekly_progress",
    sql("SELECT user_id, least(100, count(*) * 14) AS weekly_progress FROM study_days GROUP BY user_id", study_days=DAYS),
)
def _(t: Catalog):
    return l.weekly_progress(t.study_events)


@register("session_streak", sql("SELECT user_id, streak_days FROM session_streak", **PLAIN))
def _(t: Catalog):
    return l.session_streak(_sessions(t))


@register(
    "topic_mastery",
    sql("SELECT user_id, topic, round(level, 6) AS level, attempts, correct, last_reviewed, days_since_review FROM mastery", **PLAIN),
)
def _(t: Catalog):
    return _mastery(t).select(
        "user_id", "topic", F.round("level", 6).alias("level"), "attempts", "correct", "last_reviewed", "days_since_review"
    )


@register("mastery_trend", sql("SELECT user_id, topic, trend FROM mastery", **PLAIN))
def _(t: Catalog):
    return _mastery(t).select("user_id", "topic", "trend")


@register("topic_classes", sql("SELECT user_id, class, rank, topic FROM classes", **PLAIN))
def _(t: Catalog):
    return l.topic_classes(_mastery(t)).select("user_id", "class", "rank", "topic")


@register("preferred_difficulty", sql("SELECT user_id, difficulty FROM difficulty", **PLAIN))
def _(t: Catalog):
    return l.preferred_difficulty(t.attempts)


@register("daily_minutes", sql("SELECT user_id, daily_minutes FROM minutes_of", **PLAIN))
def _(t: Catalog):
    return l.daily_minutes(l.topic_classes(_mastery(t)), l.session_streak(_sessions(t)))


@register(
    "topic_effort",
    sql("""SELECT user_id, topic, round(sum(minutes), 6) AS minutes, count(*) AS revisions FROM
           (SELECT user_id, minutes, unnest([topic, 'm' || material_id % 5]) AS topic FROM study_events WHERE kind = 'session')
           GROUP BY user_id, topic"""),
)
def _(t: Catalog):
    second = F.concat(F.lit("m"), (F.col("material_id") % 5).cast("string"))
    sessions = _sessions(t).select("user_id", "minutes", F.array("topic", second).alias("topics"))
    return l.topic_effort(sessions).withColumn("minutes", F.round("minutes", 6))


@register(
    "study_time_profile",
    sql(
        """SELECT user_id, preferred_hour, round(total_minutes, 6) AS total_minutes, round(average_session, 6) AS average_session
           FROM habits""",
        **PLAIN,
    ),
)
def _(t: Catalog):
    return l.study_time_profile(_sessions(t), _quiz_seconds(t)).withColumns(
        {"total_minutes": F.round("total_minutes", 6), "average_session": F.round("average_session", 6)}
    )


@register(
    "rate_limit_density",
    sql("""SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS trailing
           FROM study_events"""),
)
def _(t: Catalog):
    return l.trailing_counts(t.study_events, LIMIT_WINDOW).select("event_id", "user_id", "trailing")


@register(
    "rate_limit_audit",
    sql(
        "SELECT event_id, user_id, ok AS accepted FROM calls_fold",
        calls_seq="SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM study_events",
        calls_fold="""
          SELECT user_id, rn, event_id, true AS ok, [us] AS acc FROM calls_seq WHERE rn = 1
          UNION ALL
          SELECT n.user_id, n.rn, n.event_id, (len(c.acc) < 5 OR c.acc[1] < n.us - 86400000000),
            CASE WHEN len(c.acc) < 5 THEN list_append(c.acc, n.us)
                 WHEN c.acc[1] < n.us - 86400000000 THEN list_append(c.acc[2:], n.us) ELSE c.acc END
          FROM calls_fold c JOIN calls_seq n ON n.user_id = c.user_id AND n.rn = c.rn + 1""",
    ),
)
def _(t: Catalog):
    return l.rate_limit_audit(t.study_events, LIMIT_K, LIMIT_WINDOW).select("event_id", "user_id", "accepted")


@register(
    "expire_stale",
    sql("""SELECT id, CASE WHEN s THEN 'failed' ELSE status END AS status, CASE WHEN s THEN TIMESTAMP '1996-01-01 00:00:00' ELSE created_at END AS created_at
           FROM (SELECT *, coalesce(status = 'processing' AND created_at < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 10 MINUTE, false) AS s FROM materials)"""),
)
def _(t: Catalog):
    return l.expire_stale(t.materials, "1996-01-01 00:00:00").select("id", "status", "created_at")


ASKED = """
    SELECT DISTINCT e.user_id, CASE WHEN e.event_id % 2 = 0 THEN m.tags[1] ELSE substr(m.tags[2], 1, 3) END AS topic
    FROM study_events e JOIN materials m ON m.id = e.material_id WHERE e.kind = 'quiz'"""


def _asked(t: Catalog):
    """Topics users met in quizzes: words and word beginnings of titles."""
    m = t.materials.select(F.col("id").alias("material_id"), "tags")
    word = F.when(F.col("event_id") % 2 == 0, F.get("tags", F.lit(0))).otherwise(F.substring(F.get("tags", F.lit(1)), 1, 3))
    return (
        t.study_events.where("kind = 'quiz'").join(m, "material_id").select("user_id", word.alias("topic")).distinct()
    )


@register(
    "topic_material_match",
    sql("SELECT user_id, topic, material_id FROM matched", **{**PLAIN, "asked": ASKED}),
)
def _(t: Catalog):
    downloads = t.study_events.where("kind = 'download'").select("user_id", "material_id")
    return l.topic_material_match(_asked(t), t.materials, downloads)


@register(
    "advanced_material_match",
    sql("SELECT user_id, topic, material_id FROM advanced", **{**PLAIN, "asked_up": ASKED}),
)
def _(t: Catalog):
    return l.advanced_material_match(_asked(t), t.materials, _sessions(t).select("user_id", "material_id"))


@register(
    "topic_mentions",
    sql("""SELECT DISTINCT lower(a.topic) AS topic, m.doc_id AS material_id
           FROM (SELECT DISTINCT topic FROM asked) a JOIN material_text m ON a.topic <> '' AND contains(lower(m.text), lower(a.topic))""", asked=ASKED),
)
def _(t: Catalog):
    """Topics met in quizzes that the whole text of a material contains."""
    needles = _asked(t).select(F.lower("topic").alias("needle"))
    bodies = t.material_text.select(F.col("doc_id").alias("id"), F.lower("text").alias("body"))
    return contained_in(needles, bodies).select(F.col("needle").alias("topic"), F.col("id").alias("material_id"))


@register("unexplored_topics", sql("SELECT user_id, rank, topic FROM unexplored", **WORDS))
def _(t: Catalog):
    mastery = _mastery(t, _worded(t))
    return l.unexplored_topics(t.materials, mastery, l.topic_classes(mastery)).select("user_id", "rank", "topic")


def _recs(t: Catalog):
    attempts = _worded(t)
    mastery = cut_lineage(_mastery(t, attempts))
    classes = cut_lineage(l.topic_classes(mastery))
    recs = l.adaptive_recommendations(
        classes,
        l.preferred_difficulty(attempts),
        t.materials,
        t.study_events.where("kind = 'download'").select("user_id", "material_id"),
        _sessions(t).select("user_id", "material_id"),
        mastery,
    )
    return recs, classes


@register(
    "adaptive_recommendations",
    sql("SELECT user_id, position, priority, type, topic, material_id, title, minutes, difficulty, reason FROM recs", **WORDS),
)
def _(t: Catalog):
    return _recs(t)[0]


@register(
    "study_plan",
    sql(
        """
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY o) AS position, type, title, duration, topic FROM (
          SELECT user_id, 0 AS o, 'warmup' AS type, 'Quick review: ' || topic AS title, 5::BIGINT AS duration, topic FROM warm
          UNION ALL
          SELECT user_id, position, CASE type WHEN 'review' THEN 'review' WHEN 'explore' THEN 'practice' ELSE 'learn' END, title,
                 CAST(least(minutes, daily_minutes - w - spent) AS BIGINT), topic FROM (
            SELECT r.*, d.daily_minutes, CASE WHEN warm.user_id IS NULL THEN 0 ELSE 5 END AS w,
              coalesce(sum(r.minutes) OVER (PARTITION BY r.user_id ORDER BY r.position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent
            FROM recs r JOIN minutes_of d USING (user_id) LEFT JOIN warm USING (user_id) WHERE r.position <= 4)
          WHERE daily_minutes - w - spent > 0
          UNION ALL
          SELECT user_id, 99, 'cooldown', 'Flashcard practice', 5, coalesce(t, '') FROM minutes_of LEFT JOIN
            (SELECT user_id, string_agg(topic, ', ' ORDER BY rank) AS t FROM classes WHERE class = 'weak' AND rank <= 3 GROUP BY user_id) USING (user_id))""",
        **{**WORDS, "warm": "SELECT user_id, topic FROM classes JOIN minutes_of USING (user_id) WHERE class = 'strong' AND rank = 1"},
    ),
)
def _(t: Catalog):
    recs, classes = _recs(t)
    recs = cut_lineage(recs)
    minutes = l.daily_minutes(classes, l.session_streak(_sessions(t)))
    return l.study_plan(recs, classes, minutes).select("user_id", "position", "type", "title", "duration", "topic")


@register(
    "plan_goal",
    sql(
        """SELECT u.user_id, coalesce(n1, w1, 'general study') AS focus, CASE WHEN nn > 0 THEN 'Catch up on ' || nn || ' neglected topics'
             WHEN nw > 0 THEN 'Improve ' || nw || ' weak areas' ELSE 'Maintain and advance your knowledge' END AS goal
           FROM (SELECT DISTINCT user_id FROM attempts) u LEFT JOIN (SELECT user_id, count(*) FILTER (WHERE class = 'neglected') AS nn,
             count(*) FILTER (WHERE class = 'weak') AS nw, max(topic) FILTER (WHERE class = 'neglected' AND rank = 1) AS n1,
             max(topic) FILTER (WHERE class = 'weak' AND rank = 1) AS w1 FROM classes GROUP BY user_id) USING (user_id)""",
        **PLAIN,
    ),
)
def _(t: Catalog):
    return l.plan_goal(l.topic_classes(_mastery(t)), t.attempts.select("user_id").distinct())


@register(
    "student_insights",
    sql(
        """
        WITH c AS (SELECT *, CAST(floor(round(level, 9) * 100 + 0.5) AS BIGINT) AS pct FROM classes)
        SELECT user_id, 1 AS section, rank, 'strength' AS type, 'Strong: ' || topic AS title, 'You''ve achieved ' || pct || '% mastery on ' || topic
            || ' across ' || attempts || ' attempts. Your performance is ' || trend || '.' AS description, 'info' AS priority FROM c WHERE class = 'strong' AND rank <= 3
        UNION ALL SELECT user_id, 2, rank, 'weakness', 'Needs work: ' || topic, 'Your mastery on ' || topic || ' is ' || pct || '%. You''ve gotten '
            || correct || ' out of ' || attempts || ' attempts correct.', 'high' FROM c WHERE class = 'weak' AND rank <= 3
        UNION ALL SELECT user_id, 3, rank, 'warning', 'Neglected: ' || topic, 'You haven''t reviewed ' || topic || ' in ' || days_since_review
            || ' days. Knowledge decay starts after 6 days without review.', 'high' FROM c WHERE class = 'neglected' AND rank <= 2
        UNION ALL SELECT user_id, 4, 1, 'achievement', streak_days || '-day streak!', 'You''ve studied every day for ' || streak_days
            || ' consecutive days. Keep it up!', 'info' FROM session_streak WHERE streak_days >= 7
        UNION ALL SELECT user_id, 5, 1, 'pattern', 'You''re a ' || CASE WHEN preferred_hour < 12 THEN 'morning' WHEN preferred_hour < 17 THEN 'afternoon' ELSE 'evening' END || ' studier',
            'You tend to study around ' || preferred_hour || ':00. Your average session is ' || CAST(floor(round(average_session, 6) + 0.5) AS BIGINT) || ' minutes.', 'low' FROM habits
        UNION ALL SELECT user_id, 6, 1, 'suggestion', 'Focus strategy', 'You have ' || n || ' weak topics. Rather than spreading your time, focus on 1-2 per session for deeper learning.', 'medium'
            FROM (SELECT user_id, count(*) AS n FROM c WHERE class = 'weak' GROUP BY user_id) WHERE n > 3""".replace(
            "WITH c AS (SELECT *, CAST(floor(round(level, 9) * 100 + 0.5) AS BIGINT) AS pct FROM classes)", ""
        ).replace("FROM c ", "FROM classes_pct "),
        **{**PLAIN, "classes_pct": "SELECT *, CAST(floor(round(level, 9) * 100 + 0.5) AS BIGINT) AS pct FROM classes"},
    ),
)
def _(t: Catalog):
    classes = l.topic_classes(_mastery(t))
    habits = l.study_time_profile(_sessions(t), _quiz_seconds(t))
    return l.student_insights(classes, l.session_streak(_sessions(t)), habits)


@register(
    "profile_state_json",
    sql("SELECT user_id, topic, round(level, 6) AS level, attempts, correct FROM mastery", **PLAIN),
)
def _(t: Catalog):
    """Round trip: pack each user's topics into JSON and read them back."""
    packed = w.profile_state_json(_mastery(t))
    return w.profile_state_from_json(packed).withColumn("level", F.round("level", 6))
