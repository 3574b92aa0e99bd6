"""Queries over the catalogue: reads, joins, roll-ups, audits, write rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.operators import catalog as c
from scholia.operators import engagement as e
from scholia.operators import integrity as v
from scholia.operators import writes as w
from scholia.plans.duck import sql
from scholia.plans.registry import register
from scholia.sources.tables import Catalog, read_table

VIS = "('ready', 'processing', 'catalog_only')"


@register(
    "read_table",
    sql("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_size > 25"),
)
def _(t: Catalog):
    return read_table(t.spark, t.folder, "part", ["p_partkey", "p_name", "p_retailprice", "p_size"]).where(
        "p_size > 25"
    ).drop("p_size")


@register(
    "filter_catalog",
    sql(f"""SELECT id, title, type, status FROM materials
            WHERE status IN {VIS} AND course_code IS NULL AND type = 'LARGE' AND id <> 11"""),
)
def _(t: Catalog):
    return c.filter_catalog(t.materials, c.VISIBLE, None, "LARGE", 11).select("id", "title", "type", "status")


@register(
    "lookup_by_slug",
    sql("""SELECT s.slug, k.code, k.title FROM (SELECT lower(replace(s_name, '#', '-')) AS slug FROM supplier) s
           JOIN courses k ON lower(replace(k.title, '#', ' ')) = replace(s.slug, '-', ' ')"""),
)
def _(t: Catalog):
    named = t.courses.withColumn("name", F.replace("title", F.lit("#"), F.lit(" ")))
    slugs = t.courses.select(F.lower(F.replace("title", F.lit("#"), F.lit("-"))).alias("slug"))
    return c.lookup_by_slug(named, slugs, "name").select("slug", "code", "title")


@register(
    "search_courses",
    sql("SELECT code, title FROM courses WHERE contains(CAST(code AS VARCHAR), '1') OR contains(lower(title), '1')"),
)
def _(t: Catalog):
    return c.search_courses(t.courses, " 1 ").select("code", "title")


SEARCH_MATERIALS = f"""
    SELECT m.id, m.title, k.title AS course_title FROM materials m LEFT JOIN courses k ON m.course_code = k.code
    WHERE m.status IN {VIS} AND (m.course_code IS NULL OR k.programme_code = 3)
      AND (contains(lower(m.title), 'ring') OR contains(lower(m.type), 'ring')
           OR coalesce(contains(lower(k.title), 'ring'), false)
           OR coalesce(contains(CAST(k.code AS VARCHAR), 'ring'), false)
           OR len(list_filter(m.tags, lambda x: contains(lower(x), 'ring'))) > 0)"""


@register("search_catalog", sql(SEARCH_MATERIALS))
def _(t: Catalog):
    return c.search_catalog(t.materials, t.courses, "Ring", 3).select("id", "title", "course_title")


@register(
    "universal_search",
    sql(f"""
    SELECT 'course' AS entity, CAST(k.code AS VARCHAR) AS key, k.title FROM courses k
      LEFT JOIN programmes p ON k.programme_code = p.code
      WHERE contains(CAST(k.code AS VARCHAR), '7') OR contains(lower(k.title), '7')
         OR contains(CAST(k.programme_code AS VARCHAR), '7') OR contains(lower(p.name), '7')
    UNION ALL
    SELECT 'material', CAST(m.id AS VARCHAR), m.title FROM materials m LEFT JOIN courses k ON m.course_code = k.code
      WHERE m.status IN {VIS} AND (contains(lower(m.title), '7') OR contains(lower(m.type), '7')
        OR coalesce(contains(CAST(k.code AS VARCHAR), '7') OR contains(lower(k.title), '7'), false)
        OR len(list_filter(m.tags, lambda x: contains(lower(x), '7'))) > 0)
    UNION ALL
    SELECT 'programme', CAST(code AS VARCHAR), name FROM programmes
      WHERE contains(CAST(code AS VARCHAR), '7') OR contains(lower(name), '7') OR contains(lower(school), '7')"""),
)
def _(t: Catalog):
    return c.universal_search(t.courses, t.materials, t.programmes, "7")


@register(
    "browse_drilldown",
    sql(f"""SELECT code, title FROM courses WHERE year = 2 AND code IN
            (SELECT course_code FROM materials WHERE status IN {VIS} AND type = 'PROMO')"""),
)
def _(t: Catalog):
    return c.browse_drilldown(t.courses, t.materials, year=2, type="PROMO").select("code", "title")


@register(
    "admin_materials",
    sql("""SELECT m.id, m.title, m.status FROM materials m LEFT JOIN courses k ON m.course_code = k.code
           WHERE m.status = 'ready' AND (contains(lower(m.title), 'red') OR contains(m.status, 'red')
             OR coalesce(contains(CAST(k.code AS VARCHAR), 'red'), false))"""),
)
def _(t: Catalog):
    return c.admin_materials(t.materials, t.courses, "ready", "red").select("id", "title", "status")


@register(
    "admin_people",
    sql("""SELECT p.id, p.full_name, r.role = 'admin' AS is_admin FROM profiles p JOIN user_roles r ON r.user_id = p.id
           WHERE contains(lower(p.full_name), '5') OR contains(CAST(p.programme_code AS VARCHAR), '5')"""),
)
def _(t: Catalog):
    return c.admin_people(t.profiles, t.user_roles, "5").select("id", "full_name", "is_admin")


@register(
    "visible_rows",
    sql(f"""SELECT id, status FROM materials WHERE status IN {VIS} OR uploaded_by = 7
            OR EXISTS (SELECT 1 FROM user_roles WHERE user_id = 7 AND role = 'admin')"""),
)
def _(t: Catalog):
    return c.visible_rows(t.materials, 7, t.user_roles).select("id", "status")


@register(
    "visible_rows_admin",
    sql("SELECT id, status FROM materials"),
)
def _(t: Catalog):
    return c.visible_rows(t.materials, 50, t.user_roles).select("id", "status")


@register(
    "row_audiences",
    sql(f"""SELECT id, uploaded_by, CASE WHEN status IN {VIS} THEN 'all' WHEN uploaded_by IS NOT NULL THEN 'owner' ELSE 'admin' END AS audience
            FROM materials"""),
)
def _(t: Catalog):
    return c.row_audiences(t.materials).select("id", "uploaded_by", "audience")


@register(
    "visible_rows_by_viewer",
    sql(f"""SELECT p.id AS viewer, count(m.id) AS n_rows, CAST(coalesce(sum(m.id), 0) AS BIGINT) AS id_sum
            FROM (SELECT id, EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = profiles.id AND r.role = 'admin') AS admin FROM profiles) p
            LEFT JOIN materials m ON m.status IN {VIS} OR p.admin OR m.uploaded_by = p.id GROUP BY p.id"""),
)
def _(t: Catalog):
    return c.visible_totals(t.profiles.select(F.col("id").alias("viewer")), t.materials, t.user_roles)


@register(
    "visible_children",
    sql("""SELECT id, material_id FROM flashcards WHERE material_id IN
           (SELECT id FROM materials WHERE status IN ('ready', 'catalog_only'))"""),
)
def _(t: Catalog):
    return c.visible_children(t.flashcards, t.materials).select("id", "material_id")


@register(
    "readable_files",
    sql(f"""SELECT DISTINCT 'm/' || l_partkey || '/' || l_linenumber || '.pdf' AS path FROM lineitem
            JOIN materials ON id = l_partkey
            WHERE status IN {VIS} AND l_linenumber <= 3"""),
)
def _(t: Catalog):
    """Files named after sales lines; a material's page array lists its pages 2 and 3."""
    name = lambda key, n: F.concat(F.lit("m/"), key.cast("string"), F.lit("/"), n.cast("string"), F.lit(".pdf"))
    files = t.lineitem.select(name(F.col("l_partkey"), F.col("l_linenumber")).alias("path")).distinct()
    key = F.col("id")
    held = t.materials.select(
        "status",
        name(key, F.lit(1)).alias("file_path"),
        F.array(name(key, F.lit(2)), name(key, F.lit(3))).alias("extra_file_paths"),
    )
    return c.readable_files(files, held)


@register(
    "signup_defaults",
    sql("""SELECT event_id AS id, '' AS full_name, NULLIF(CASE WHEN event_id % 3 = 0 THEN '' ELSE json_extract_string(props, '$.k') END, '') AS student_number,
                  '' AS school, 'GEN' AS programme_code,
                  CAST(coalesce(TRY_CAST(NULLIF(json_extract_string(props, '$.k'), '') AS INT), 1) AS INT) AS year FROM events"""),
)
def _(t: Catalog):
    meta = F.concat(
        F.lit('{"student_number": "'),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.get_json_object("props", "$.k")),
        F.lit('", "programme_code": "", "year": "'),
        F.get_json_object("props", "$.k"),
        F.lit('"}'),
    )
    return c.signup_defaults(t.events.select(F.col("event_id").alias("id"), meta.alias("meta")))


@register(
    "featured_courses",
    sql("""SELECT row_number() OVER (ORDER BY t DESC, code) - 1 AS position, code, title FROM
           (SELECT course_code AS code, sum(download_count) AS t FROM materials
            WHERE course_code IS NOT NULL GROUP BY course_code QUALIFY row_number() OVER (ORDER BY t DESC, code) <= 5)
           JOIN courses USING (code)"""),
)
def _(t: Catalog):
    """The settings array holds the five most downloaded courses."""
    top = (
        t.materials.where("course_code is not null")
        .groupBy("course_code")
        .agg(F.sum("download_count").alias("t"))
        .orderBy(F.desc("t"), "course_code")
        .limit(5)
    )
    codes = F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("t")).alias("t"), "course_code"))), lambda x: x["course_code"]
    )
    settings = top.agg(codes.alias("featured_course_codes"))
    return c.featured_courses(settings, t.courses).select(F.col("position").cast("long"), "code", "title")


@register(
    "courses_with_programme",
    sql("SELECT k.code, k.title, p.name AS programme_name, p.school FROM courses k LEFT JOIN programmes p ON k.programme_code = p.code"),
)
def _(t: Catalog):
    return c.courses_with_programme(t.courses, t.programmes).select("code", "title", "programme_name", "school")


@register(
    "materials_enriched",
    sql("""SELECT m.id, m.title, k.title AS course_title, k.programme_code, p.full_name AS uploader_name
           FROM materials m LEFT JOIN courses k ON m.course_code = k.code LEFT JOIN profiles p ON m.uploaded_by = p.id"""),
)
def _(t: Catalog):
    return c.materials_enriched(t.materials, t.courses, t.profiles).select(
        "id", "title", "course_title", "programme_code", "uploader_name"
    )


@register(
    "materials_by_ids",
    sql("""SELECT m.id, m.title, m.type, k.code AS course_code FROM
           (SELECT DISTINCT material_id AS id FROM study_events) i JOIN materials m USING (id)
           LEFT JOIN courses k ON m.course_code = k.code"""),
)
def _(t: Catalog):
    ids = t.study_events.select(F.col("material_id").alias("id"))
    return c.materials_by_ids(ids, t.materials, t.courses)


@register(
    "requests_with_course",
    sql("""SELECT r.id, r.status, r.created_at, k.title AS course_title FROM material_requests r
           LEFT JOIN courses k ON r.course_code = k.code"""),
)
def _(t: Catalog):
    return c.requests_with_course(t.material_requests, t.courses).select("id", "status", "created_at", "course_title")


@register(
    "saved_with_material",
    sql("""SELECT s.profile_id, s.material_id, s.created_at, m.title AS material_title, k.title AS course_title
           FROM saved_materials s JOIN materials m ON s.material_id = m.id LEFT JOIN courses k ON m.course_code = k.code"""),
)
def _(t: Catalog):
    return c.saved_with_material(t.saved_materials, t.materials, t.courses).select(
        "profile_id", "material_id", "created_at", "material_title", "course_title"
    )


@register(
    "like_status",
    sql("""SELECT s.profile_id, s.material_id, l.material_id IS NOT NULL AS liked FROM
           (SELECT DISTINCT user_id AS profile_id, material_id FROM study_events) s
           LEFT JOIN material_likes l ON s.profile_id = l.profile_id AND s.material_id = l.material_id"""),
)
def _(t: Catalog):
    pairs = t.study_events.select(F.col("user_id").alias("profile_id"), "material_id").distinct()
    return c.like_status(pairs, t.material_likes)


@register(
    "stage_status_backfill",
    sql(f"""
    SELECT m.id, m.status,
      CASE WHEN m.status = 'failed' THEN 'failed' ELSE 'pending' END AS summary_status,
      CASE WHEN f.mid IS NOT NULL THEN 'ready' WHEN m.status IN ('ready', 'failed') THEN 'failed' ELSE 'pending' END AS flashcards_status,
      CASE WHEN z.mid IS NOT NULL THEN 'ready' WHEN m.status IN ('ready', 'failed') THEN 'failed' ELSE 'pending' END AS quiz_status,
      CASE WHEN f.mid IS NULL AND m.status IN ('ready', 'failed') THEN '{c.NO_CARDS}' END AS flashcards_error,
      CASE WHEN z.mid IS NULL AND m.status IN ('ready', 'failed') THEN '{c.NO_QUIZ}' END AS quiz_error
    FROM materials m LEFT JOIN (SELECT DISTINCT material_id AS mid FROM flashcards) f ON f.mid = m.id
    LEFT JOIN (SELECT DISTINCT material_id AS mid FROM quiz_questions) z ON z.mid = m.id
    WHERE m.status IN ('ready', 'catalog_only', 'failed')"""),
)
def _(t: Catalog):
    return c.stage_status_backfill(t.materials, t.flashcards, t.quiz_questions)


# --- ranked lists -----------------------------------------------------------


@register(
    "popular_materials",
    sql(f"""SELECT id, title, likes_count, download_count FROM materials WHERE status IN {VIS}
            ORDER BY likes_count DESC, download_count DESC, id LIMIT 8"""),
)
def _(t: Catalog):
    return c.popular_materials(t.materials).select("id", "title", "likes_count", "download_count")


@register(
    "top_engagement",
    sql("""SELECT 'downloads' AS board, id, title, download_count AS score, k.code AS course_code FROM
             (SELECT * FROM materials ORDER BY download_count DESC, id LIMIT 8) m LEFT JOIN (SELECT code FROM courses) k ON m.course_code = k.code
           UNION ALL
           SELECT 'likes', id, title, likes_count, k.code FROM
             (SELECT * FROM materials ORDER BY likes_count DESC, id LIMIT 8) m LEFT JOIN (SELECT code FROM courses) k ON m.course_code = k.code"""),
)
def _(t: Catalog):
    return c.top_engagement(t.materials, t.courses)


@register("failed_queue", sql("SELECT id, title, created_at FROM materials WHERE status = 'failed'"))
def _(t: Catalog):
    return c.failed_queue(t.materials).select("id", "title", "created_at")


@register(
    "recent_materials",
    sql(f"""SELECT id, title, created_at FROM materials WHERE status IN {VIS}
            ORDER BY created_at DESC NULLS LAST, id LIMIT 8"""),
)
def _(t: Catalog):
    return c.recent_materials(t.materials).select("id", "title", "created_at")


@register(
    "related_materials",
    sql(f"""SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC NULLS LAST, b.id) AS rank,
                   b.id AS related_id, b.title AS related_title
            FROM materials a JOIN materials b ON a.course_code IS NOT DISTINCT FROM b.course_code AND a.id <> b.id
            WHERE b.status IN {VIS}
            QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.created_at DESC NULLS LAST, b.id) <= 6"""),
)
def _(t: Catalog):
    return c.related_materials(t.materials)


@register(
    "past_papers_by_year",
    sql("""SELECT course_code, id, content_year, created_at, row_number() OVER (PARTITION BY course_code
             ORDER BY content_year DESC NULLS LAST, created_at DESC NULLS LAST, id) AS position
           FROM materials WHERE type = 'PROMO' AND course_code IS NOT NULL"""),
)
def _(t: Catalog):
    return c.past_papers_by_year(t.materials, "PROMO")


@register(
    "own_first_order",
    sql("""SELECT p.code, p.name, p.school, v.programme_code IS NOT NULL AS own FROM programmes p
           LEFT JOIN (SELECT programme_code FROM profiles WHERE id = 7) v ON v.programme_code = p.code"""),
)
def _(t: Catalog):
    return c.own_first_order(t.programmes, t.profiles, 7)


@register(
    "own_first_by_viewer",
    sql("""SELECT v.id, p.code AS own, p.moved_from FROM profiles v
           LEFT JOIN (SELECT code, row_number() OVER (ORDER BY name, code) AS moved_from FROM programmes) p ON p.code = v.programme_code"""),
)
def _(t: Catalog):
    return c.own_first_moves(t.programmes, t.profiles)


# --- roll-ups ---------------------------------------------------------------


@register(
    "popular_courses",
    sql(f"""SELECT k.code, k.title, k.programme_code, k.year, CAST(s.score AS BIGINT) AS score, s.score IS NOT NULL AS ranked
            FROM courses k LEFT JOIN (SELECT course_code, sum(download_count + likes_count) AS score FROM materials
              WHERE status IN {VIS} AND course_code IS NOT NULL GROUP BY course_code) s ON s.course_code = k.code
            ORDER BY ranked DESC, score DESC NULLS LAST, code LIMIT 6"""),
)
def _(t: Catalog):
    return e.popular_courses(t.materials, t.courses)


@register(
    "course_material_stats",
    sql(f"""SELECT course_code, count(*) AS n_materials, string_agg(DISTINCT type, ',' ORDER BY type) AS types
            FROM materials WHERE status IN {VIS} AND course_code IS NOT NULL GROUP BY course_code"""),
)
def _(t: Catalog):
    return e.course_material_stats(t.materials).withColumn("types", F.array_join("types", ","))


@register(
    "programme_rollup",
    sql(f"""SELECT programme_code, code, CAST(grouping_id(programme_code, code) AS INT) AS level, count(*) AS n_courses,
              CAST(sum(coalesce(m, 0)) AS BIGINT) AS n_materials
            FROM (SELECT k.code, k.programme_code, m.m FROM courses k LEFT JOIN
              (SELECT course_code, count(*) AS m FROM materials WHERE status IN {VIS} GROUP BY course_code) m
              ON m.course_code = k.code) GROUP BY ROLLUP (programme_code, code)"""),
)
def _(t: Catalog):
    return e.programme_rollup(t.programmes, t.courses, t.materials)


@register(
    "admin_overview",
    sql("""SELECT 'materials_ready' AS measure, count(*) AS n FROM materials WHERE status = 'ready'
           UNION ALL SELECT 'materials_failed', count(*) FROM materials WHERE status = 'failed'
           UNION ALL SELECT 'open_requests', count(*) FROM material_requests WHERE status = 'open'
           UNION ALL SELECT 'students', count(*) FROM profiles
           UNION ALL SELECT 'programmes', count(*) FROM programmes"""),
)
def _(t: Catalog):
    return e.admin_overview(t.materials, t.material_requests, t.profiles, t.programmes)


@register(
    "generation_coverage",
    sql("""SELECT count(*) AS visible_count,
              count(*) FILTER (WHERE download_count = 0 AND likes_count = 0) AS no_engagement,
              (SELECT count(DISTINCT material_id) FROM flashcards) AS with_cards,
              (SELECT count(DISTINCT material_id) FROM quiz_questions) AS with_quiz
           FROM materials WHERE status IN ('ready', 'catalog_only')"""),
)
def _(t: Catalog):
    return e.generation_coverage(t.materials, t.flashcards, t.quiz_questions)


@register(
    "recount_likes",
    sql("""SELECT m.id, count(l.profile_id) AS likes_count FROM materials m
           LEFT JOIN material_likes l ON l.material_id = m.id GROUP BY m.id"""),
)
def _(t: Catalog):
    return e.recount_likes(t.materials, t.material_likes)


@register(
    "toggle_replay",
    sql("""SELECT material_id, CAST(sum(n % 2) AS BIGINT) AS likes FROM (SELECT user_id, material_id, count(*) AS n FROM study_events
           WHERE kind = 'like_toggle' GROUP BY ALL) GROUP BY material_id"""),
)
def _(t: Catalog):
    return e.toggle_replay(t.study_events.where("kind = 'like_toggle'"))


@register(
    "download_counts",
    sql(f"""SELECT material_id, count(*) AS downloads FROM study_events WHERE kind = 'download'
            AND material_id IN (SELECT id FROM materials WHERE status IN {VIS}) GROUP BY material_id"""),
)
def _(t: Catalog):
    return e.download_counts(t.study_events, t.materials)


@register(
    "quiz_scores",
    sql("""
    SELECT a.o_orderkey AS attempt_id,
      count(*) FILTER (WHERE l.l_orderkey IS NOT NULL AND l.l_quantity::INT % 4 = q.n % 4) AS score,
      count(*) AS total,
      coalesce(string_agg(CASE WHEN l.l_orderkey IS NULL OR l.l_quantity::INT % 4 <> q.n % 4 THEN 'Q' || q.n END, ',' ORDER BY q.n), '') AS wrong_questions
    FROM orders a CROSS JOIN (SELECT unnest(range(1, 8)) AS n) q
    LEFT JOIN lineitem l ON l.l_orderkey = a.o_orderkey AND l.l_linenumber = q.n
    GROUP BY a.o_orderkey"""),
)
def _(t: Catalog):
    """Each order is an attempt at a seven-question quiz; its lines are the answers."""
    numbers = t.lineitem.select(F.col("l_linenumber").alias("question_id")).distinct()
    questions = numbers.select(
        F.lit(1).alias("quiz_id"),
        "question_id",
        F.col("question_id").alias("position"),
        F.concat(F.lit("Q"), F.col("question_id").cast("string")).alias("question"),
        (F.col("question_id") % 4).alias("correct_index"),
    )
    attempts = t.orders.select(F.col("o_orderkey").alias("attempt_id"), F.lit(1).alias("quiz_id"))
    answers = t.lineitem.select(
        F.col("l_orderkey").alias("attempt_id"),
        F.col("l_linenumber").alias("question_id"),
        (F.col("l_quantity").cast("int") % 4).alias("choice"),
    )
    return e.quiz_scores(answers, questions, attempts).withColumn(
        "wrong_questions", F.array_join("wrong_questions", ",")
    )


@register(
    "quiz_average",
    sql("""SELECT user_id, count(*) AS n_attempts,
             CAST(floor(avg(CASE WHEN total > 0 THEN score / total ELSE 0.0 END) * 100 + 0.5) AS BIGINT) AS average_pct
           FROM (SELECT user_id, CAST(floor(value) AS INT) % 11 AS score, CAST(event_id % 6 * 2 AS INT) AS total FROM events
                 WHERE event_type = 'signup') GROUP BY user_id"""),
)
def _(t: Catalog):
    attempts = t.events.where("event_type = 'signup'").select(
        "user_id",
        "event_id",
        (F.floor("value").cast("int") % 11).alias("score"),
        (F.col("event_id") % 6 * 2).cast("int").alias("total"),
    )
    return e.quiz_average(attempts)


RECENT = """recent AS (
  SELECT user_id, material_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM (
    SELECT user_id, material_id, ts, event_id FROM study_events WHERE kind = 'download'
    QUALIFY row_number() OVER (PARTITION BY user_id, material_id ORDER BY ts DESC, event_id DESC) = 1)
  QUALIFY rank <= 15)"""


@register(
    "recent_distinct",
    sql("SELECT user_id, rank, material_id FROM recent", recent=RECENT[len("recent AS ("):-1]),
)
def _(t: Catalog):
    return e.recent_distinct(t.study_events.where("kind = 'download'"))


@register(
    "focus_courses",
    sql(
        """SELECT user_id, course_code, CAST(hits AS BIGINT) AS hits, row_number() OVER (PARTITION BY user_id ORDER BY hits DESC, course_code) AS rank
        FROM (SELECT u.user_id, m.course_code, count(*) AS hits FROM
          (SELECT user_id, material_id FROM study_events WHERE kind = 'quiz' UNION ALL SELECT user_id, material_id FROM recent) u
          JOIN materials m ON m.id = u.material_id WHERE m.course_code IS NOT NULL GROUP BY ALL HAVING count(*) >= 2)
        QUALIFY rank <= 2""",
        recent=RECENT[len("recent AS ("):-1],
    ),
)
def _(t: Catalog):
    ev = t.study_events
    return e.focus_courses(ev.where("kind = 'quiz'"), ev.where("kind = 'download'"), t.materials)


LIBRARY = """
  SELECT profile_id AS user_id, material_id, created_at AS saved_at,
    CASE WHEN (profile_id + material_id) % 3 = 0 THEN created_at + INTERVAL 40 DAY END AS last_opened_at,
    CASE WHEN material_id % 4 <> 0 THEN material_id * 1000 END AS size_bytes
  FROM saved_materials"""


def _library(t: Catalog):
    return t.saved_materials.select(
        F.col("profile_id").alias("user_id"),
        "material_id",
        F.col("created_at").alias("saved_at"),
        F.when(
            (F.col("profile_id") + F.col("material_id")) % 3 == 0, F.col("created_at") + F.expr("INTERVAL 40 DAYS")
        ).alias("last_opened_at"),
        F.when(F.col("material_id") % 4 != 0, F.col("material_id") * 1000).alias("size_bytes"),
    )


@register(
    "library_stats",
    sql(
        """SELECT user_id, count(*) AS items, CAST(sum(coalesce(size_bytes, 0)) AS BIGINT) AS bytes, count(size_bytes) AS files
           FROM library GROUP BY user_id""",
        library=LIBRARY,
    ),
)
def _(t: Catalog):
    return e.library_stats(_library(t))


@register(
    "recent_library",
    sql(
        """SELECT user_id, material_id, row_number() OVER (PARTITION BY user_id
             ORDER BY coalesce(last_opened_at, saved_at) DESC, material_id) AS rank FROM library""",
        library=LIBRARY,
    ),
)
def _(t: Catalog):
    return e.recent_library(_library(t)).select("user_id", "material_id", "rank")


@register(
    "recent_courses",
    sql(
        """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, mid, course_code) AS rank, course_code FROM (
             SELECT user_id, course_code, coalesce(last_opened_at, saved_at) AS seen, material_id AS mid
             FROM library JOIN materials ON id = material_id WHERE course_code IS NOT NULL
             QUALIFY row_number() OVER (PARTITION BY user_id, course_code ORDER BY coalesce(last_opened_at, saved_at) DESC, material_id) = 1)
           QUALIFY rank <= 5""",
        library=LIBRARY,
    ),
)
def _(t: Catalog):
    return e.recent_courses(_library(t), t.materials)


@register(
    "stale_items",
    sql(
        """SELECT user_id, material_id FROM library
           WHERE coalesce(last_opened_at, saved_at) < TIMESTAMP '1998-01-01 00:00:00' - INTERVAL 30 DAY""",
        library=LIBRARY,
    ),
)
def _(t: Catalog):
    return e.stale_items(_library(t), "1998-01-01 00:00:00").select("user_id", "material_id")


@register(
    "bundle_pages",
    sql("""
    SELECT conv_id AS bundle_id, string_agg('[Page ' || n || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text,
      count(*) AS n_pages, count(*) FILTER (WHERE role = 'user') AS readable_pages,
      min(CASE WHEN role = 'user' THEN turn * 0.1::DOUBLE + 0.3::DOUBLE END) AS confidence,
      CASE WHEN count(*) FILTER (WHERE role <> 'user') > 0 THEN count(*) FILTER (WHERE role <> 'user') || ' of ' || count(*)
        || ' pages didn''t have any readable text.' END AS note
    FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations) GROUP BY conv_id"""),
)
def _(t: Catalog):
    pages = t.conversations.select(
        F.col("conv_id").alias("bundle_id"),
        F.col("turn").alias("page"),
        "text",
        F.when(F.col("role") == "user", "good").otherwise("none").alias("quality"),
        F.when(F.col("role") == "user", F.col("turn") * 0.1 + 0.3).alias("confidence"),
    )
    return e.bundle_pages(pages)


# --- write rules ------------------------------------------------------------


@register(
    "upsert_by_key",
    sql("""
    SELECT coalesce(u.id, p.id) AS id, CASE WHEN u.id IS NOT NULL THEN u.full_name ELSE p.full_name END AS full_name,
           coalesce(u.programme_code, p.programme_code) AS programme_code
    FROM profiles p FULL OUTER JOIN (SELECT s_suppkey * 7 AS id, s_name AS full_name,
      CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE s_nationkey END AS programme_code FROM supplier) u ON p.id = u.id"""),
)
def _(t: Catalog):
    updates = t.supplier.select(
        (F.col("s_suppkey") * 7).alias("id"),
        F.col("s_name").alias("full_name"),
        F.when(F.col("s_suppkey") % 2 != 0, F.col("s_nationkey")).alias("programme_code"),
    )
    return w.upsert_by_key(t.profiles, updates, ["id"], ["programme_code"])


@register(
    "insert_ignore",
    sql("""SELECT user_id, role FROM user_roles UNION ALL
           SELECT DISTINCT o_custkey, 'admin' FROM orders WHERE o_orderkey % 10 = 0
             AND NOT EXISTS (SELECT 1 FROM user_roles r WHERE r.user_id = o_custkey AND r.role = 'admin')"""),
)
def _(t: Catalog):
    new = t.orders.where("o_orderkey % 10 = 0").select(F.col("o_custkey").alias("user_id"), F.lit("admin").alias("role"))
    return w.insert_ignore(t.user_roles, new, ["user_id", "role"])


@register(
    "replace_children",
    sql("""
    SELECT id, material_id, position, question FROM flashcards WHERE material_id NOT IN (SELECT material_id FROM quiz_questions WHERE material_id % 2 = 0)
    UNION ALL
    SELECT id, material_id, row_number() OVER (PARTITION BY material_id ORDER BY position, id) - 1, question FROM quiz_questions WHERE material_id % 2 = 0"""),
)
def _(t: Catalog):
    new = t.quiz_questions.where("material_id % 2 = 0")
    return w.replace_children(t.flashcards, new, "material_id", [F.col("position"), F.col("id")])


@register(
    "cascade_delete",
    sql("""SELECT id, material_id FROM flashcards WHERE material_id NOT IN (SELECT id FROM materials WHERE status = 'failed')"""),
)
def _(t: Catalog):
    gone = t.materials.where("status = 'failed'")
    return w.cascade_delete(t.flashcards, gone, "material_id").select("id", "material_id")


@register(
    "cascade_set_null",
    sql("""SELECT m.id, CASE WHEN k.code IS NULL THEN m.course_code END AS course_code FROM materials m
           LEFT JOIN (SELECT code FROM courses WHERE year = 1) k ON k.code = m.course_code"""),
)
def _(t: Catalog):
    gone = t.courses.where("year = 1")
    return w.cascade_delete(t.materials, gone, "course_code", "set_null", "code").select("id", "course_code")


@register(
    "resequence",
    sql("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber) - 1 AS position
           FROM lineitem"""),
)
def _(t: Catalog):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    out = w.resequence(rows, "l_orderkey", [F.desc("l_shipdate"), F.col("l_linenumber")])
    return out.select("l_orderkey", "l_linenumber", "position")


@register(
    "next_position",
    sql("SELECT material_id, max(position) + 1 AS next_position FROM flashcards GROUP BY material_id"),
)
def _(t: Catalog):
    return w.next_position(t.flashcards, "material_id")


@register(
    "distinct_normalised",
    sql("""SELECT doc_id, k FROM (SELECT doc_id, md5(lower(trim(text))) AS k FROM documents)
           QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id) = 1"""),
)
def _(t: Catalog):
    """Documents whose whole text repeats under lower/trim, first one kept."""
    docs = t.documents.select("doc_id", F.md5(F.lower(F.trim("text"))).alias("k"), F.lit(0).alias("p"))
    return w.distinct_normalised(docs, "p", "k", [F.col("doc_id")]).select("doc_id", "k")


@register(
    "merge_chunk_results",
    sql("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk, position) - 1 AS position, question FROM
             (SELECT material_id // 4 AS doc_id, material_id AS chunk, position, question FROM flashcards)
           QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk, position) <= 3"""),
)
def _(t: Catalog):
    rows = t.flashcards.select(
        F.floor(F.col("material_id") / 4).alias("doc_id"), F.col("material_id").alias("chunk"), "position", "question"
    )
    return w.merge_chunk_results(rows, 3).select("doc_id", "position", "question")


# --- audits -----------------------------------------------------------------


@register(
    "check_rules",
    sql("""
    SELECT id, 'year_range' AS rule FROM materials WHERE NOT coalesce(content_year BETWEEN 2008 AND 2024, true)
    UNION ALL SELECT id, 'type_known' FROM materials WHERE NOT coalesce(type IN ('SMALL', 'LARGE', 'MEDIUM', 'PROMO'), true)
    UNION ALL SELECT id, 'counts' FROM materials WHERE NOT coalesce(download_count >= likes_count * 2, true)"""),
)
def _(t: Catalog):
    rules = {
        "year_range": F.col("content_year").between(2008, 2024),
        "type_known": F.col("type").isin("SMALL", "LARGE", "MEDIUM", "PROMO"),
        "counts": F.col("download_count") >= F.col("likes_count") * 2,
    }
    return v.check_rules(t.materials, "id", rules)


@register(
    "orphans",
    sql("""SELECT material_id, count(*) AS n_rows FROM flashcards WHERE material_id NOT IN (SELECT id FROM materials WHERE status = 'ready')
           GROUP BY material_id"""),
)
def _(t: Catalog):
    return v.orphans(t.flashcards, "material_id", t.materials.where("status = 'ready'"), "id")


@register(
    "orphan_requests",
    sql("""SELECT course_code, count(*) AS n_rows FROM material_requests WHERE course_code NOT IN (SELECT code FROM courses)
           GROUP BY course_code"""),
)
def _(t: Catalog):
    return v.orphans(t.material_requests, "course_code", t.courses, "code")


@register(
    "key_duplicates",
    sql("SELECT user_id, material_id, count(*) AS n_rows FROM study_events GROUP BY ALL HAVING count(*) > 1"),
)
def _(t: Catalog):
    return v.key_duplicates(t.study_events, ["user_id", "material_id"])


@register(
    "stage_summary",
    sql("""
    SELECT item_id, CASE WHEN bool_or(ok) THEN 'ready' ELSE 'failed' END AS status,
      NULLIF(coalesce(string_agg(CASE WHEN NOT ok THEN label || ': error ' || item_id END, ' · ' ORDER BY r), ''), '') AS note
    FROM (SELECT o_orderkey AS item_id, r, label, (o_orderkey // (r * r + 1)) % 2 = 0 AS ok FROM orders
          CROSS JOIN (VALUES (1, 'Summary'), (2, 'Flashcards'), (3, 'Quiz')) AS s(r, label)) GROUP BY item_id"""),
)
def _(t: Catalog):
    stage = F.explode(
        F.array(*[F.struct(F.lit(i + 1).alias("r"), F.lit(s).alias("stage")) for i, (s, _) in enumerate(v.STAGES)])
    )
    stages = t.orders.select(F.col("o_orderkey").alias("item_id"), stage.alias("s")).select(
        "item_id",
        "s.stage",
        (F.floor(F.col("item_id") / (F.col("s.r") * F.col("s.r") + 1)) % 2 == 0).alias("ok"),
        F.concat(F.lit("error "), F.col("item_id").cast("string")).alias("message"),
    )
    return v.stage_summary(stages)
