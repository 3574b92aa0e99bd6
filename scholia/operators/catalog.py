"""Catalogue reads: filters, search, lookups, enrichment and ranked lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.operators.ordering import positions

# Statuses a reader may see, and the stages still open to owners.
VISIBLE = ("ready", "processing", "catalog_only")
PUBLISHED = ("ready", "catalog_only")


def visible(materials: DataFrame, statuses: Sequence[str] = VISIBLE) -> DataFrame:
    return materials.where(F.col("status").isin(*statuses))


def _has(col: Column | str, needle: str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.lower(col.cast("string")).contains(needle), F.lit(False))


def _any_has(cols: Sequence[str], needle: str, arrays: Sequence[str] = ()) -> Column:
    hit = F.lit(False)
    for col in cols:
        hit = hit | _has(col, needle)
    for col in arrays:
        hit = hit | F.coalesce(
            F.exists(col, lambda t: F.lower(t).contains(needle)), F.lit(False)
        )
    return hit


def _needle(text: str | None) -> str:
    return (text or "").strip().lower()


def newest_first(*keys: str) -> list[Column]:
    return [F.col("created_at").desc_nulls_last(), *[F.col(k) for k in (keys or ("id",))]]


# --- filters and search -----------------------------------------------------


def filter_catalog(
    materials: DataFrame,
    status_in: Sequence[str] | None = None,
    course: object = ...,
    type: str | None = None,
    exclude_id: object = None,
) -> DataFrame:
    """Equality, membership and null filters; ``course=None`` asks for no course."""
    out = materials
    if status_in is not None:
        out = out.where(F.col("status").isin(*status_in))
    if course is None:
        out = out.where(F.col("course_code").isNull())
    elif course is not ...:
        out = out.where(F.col("course_code") == F.lit(course))
    if type is not None:
        out = out.where(F.col("type") == type)
    if exclude_id is not None:
        out = out.where(F.col("id") != F.lit(exclude_id))
    return out


def lookup_by_slug(courses: DataFrame, slugs: DataFrame, code: str = "code") -> DataFrame:
    """Dashed slug -> course, ignoring case. Slugs without a course drop out."""
    keyed = courses.withColumn("_key", F.lower(F.col(code).cast("string")))
    asked = slugs.select("slug", F.lower(F.replace("slug", F.lit("-"), F.lit(" "))).alias("_key"))
    return asked.join(keyed, "_key").drop("_key")


def search_courses(
    courses: DataFrame,
    needle: str,
    columns: Sequence[str] = ("code", "title", "lecturer", "description"),
    arrays: Sequence[str] = ("topics",),
) -> DataFrame:
    """Substring search over the text columns present; empty needle keeps all."""
    needle = _needle(needle)
    if not needle:
        return courses
    present = [c for c in columns if c in courses.columns]
    lists = [c for c in arrays if c in courses.columns]
    return courses.where(_any_has(present, needle, lists))


def in_programme(materials: DataFrame, courses: DataFrame, programme: object | None) -> DataFrame:
    """Materials with their course; those without a course pass every scope."""
    course = courses.select(
        F.col("code").alias("course_code"),
        F.col("title").alias("course_title"),
        F.col("programme_code"),
    )
    joined = materials.join(course, "course_code", "left")
    if programme is None:
        return joined
    return joined.where(
        F.col("course_code").isNull() | (F.col("programme_code") == F.lit(programme))
    )


def search_catalog(
    materials: DataFrame, courses: DataFrame, needle: str, programme: object | None = None
) -> DataFrame:
    scoped = in_programme(visible(materials), courses, programme)
    needle = _needle(needle)
    if not needle:
        return scoped
    # The course code counts only where the course row exists.
    code = F.when(F.col("course_title").isNotNull(), F.col("course_code"))
    return scoped.where(
        _any_has(["title", "type", "course_title"], needle, ["tags"]) | _has(code, needle)
    )


def universal_search(
    courses: DataFrame,
    materials: DataFrame,
    programmes: DataFrame,
    needle: str,
    programme: object | None = None,
) -> DataFrame:
    """Courses, materials and programmes under one needle, tagged by entity."""
    needle_ = _needle(needle)
    named = courses.join(
        programmes.select(F.col("code").alias("programme_code"), F.col("name").alias("programme_name")),
        "programme_code",
        "left",
    )
    if programme is not None:
        named = named.where(F.col("programme_code") == F.lit(programme))
    found_courses = search_courses(
        named,
        needle_,
        ("code", "title", "lecturer", "description", "programme_code", "programme_name"),
    )
    groups = programmes.where(F.col("code").cast("string") != "ADMIN")
    if needle_:
        groups = groups.where(_any_has(["code", "name", "school"], needle_))
    return (
        found_courses.select(F.lit("course").alias("entity"), F.col("code").cast("string").alias("key"), "title")
        .unionByName(
            search_catalog(materials, courses, needle_, programme).select(
                F.lit("material").alias("entity"), F.col("id").cast("string").alias("key"), "title"
            )
        )
        .unionByName(
            groups.select(
                F.lit("programme").alias("entity"),
                F.col("code").cast("string").alias("key"),
                F.col("name").alias("title"),
            )
        )
    )


def browse_drilldown(
    courses: DataFrame,
    materials: DataFrame,
    programme: object | None = None,
    year: int | None = None,
    type: str | None = None,
) -> DataFrame:
    out = courses
    if programme is not None:
        out = out.where(F.col("programme_code") == F.lit(programme))
    if year is not None:
        out = out.where(F.col("year") == year)
    if type is not None:
        having = visible(materials).where(F.col("type") == type)
        out = out.join(
            having.select(F.col("course_code").alias("code")), "code", "left_semi"
        )
    return out


def admin_materials(materials: DataFrame, courses: DataFrame, status: str, needle: str) -> DataFrame:
    joined = in_programme(materials, courses, None)
    if status != "all":
        joined = joined.where(F.col("status") == status)
    needle = _needle(needle)
    if needle:
        code = F.when(F.col("course_title").isNotNull(), F.col("course_code"))
        joined = joined.where(_any_has(["title", "status"], needle) | _has(code, needle))
    return joined


def admin_people(profiles: DataFrame, roles: DataFrame, needle: str) -> DataFrame:
    admins = roles.where(F.col("role") == "admin").select(F.col("user_id").alias("id")).distinct()
    flagged = profiles.join(admins.withColumn("is_admin", F.lit(True)), "id", "left").withColumn(
        "is_admin", F.coalesce("is_admin", F.lit(False))
    )
    needle = _needle(needle)
    if not needle:
        return flagged
    names = [c for c in ("full_name", "student_number", "programme_code") if c in profiles.columns]
    return flagged.where(_any_has(names, needle))


def visible_rows(
    materials: DataFrame,
    viewer: object,
    roles: DataFrame,
    statuses: Sequence[str] = VISIBLE,
) -> DataFrame:
    """Rows one viewer may read: public ones, own ones, or all for an admin."""
    admin = roles.where((F.col("user_id") == F.lit(viewer)) & (F.col("role") == "admin"))
    return materials.where(
        F.col("status").isin(*statuses)
        | F.coalesce(F.col("uploaded_by") == F.lit(viewer), F.lit(False))
        | admin.exists()
    )


def row_audiences(materials: DataFrame, statuses: Sequence[str] = VISIBLE) -> DataFrame:
    """Each row once with its ``audience``: ``all``, ``owner`` (the uploader and admins) or ``admin`` (no uploader)."""
    public = F.coalesce(F.col("status").isin(*statuses), F.lit(False))
    return materials.withColumn(
        "audience", F.when(public, "all").when(F.col("uploaded_by").isNotNull(), "owner").otherwise("admin")
    )


def visible_totals(
    viewers: DataFrame, materials: DataFrame, roles: DataFrame, statuses: Sequence[str] = VISIBLE
) -> DataFrame:
    """Per viewer (``viewer``) the number of rows they may read and the sum of their ids.

    Rows meet viewers by audience: public rows are summed once, hidden ones by uploader, and
    an admin takes both whole, so viewers times rows is never formed. A viewer of several roles is an admin
    if one of them is; a null or repeated viewer keeps its rows.
    """
    held = row_audiences(materials, statuses)
    size = F.struct(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("ids"))
    public = held.where("audience = 'all'").agg(size).scalar()
    hidden = held.where("audience <> 'all'").agg(size).scalar()
    own = held.where("audience = 'owner'").groupBy(F.col("uploaded_by").alias("viewer")).agg(size.alias("_own"))
    admins = roles.where("role = 'admin'").select(F.col("user_id").alias("viewer"), F.lit(True).alias("_admin")).distinct()
    joined = viewers.join(own, "viewer", "left").join(admins, "viewer", "left").withColumns(
        {"_public": public, "_hidden": hidden}
    )

    def total(part: str) -> Column:
        extra = F.when(F.col("_admin"), F.col(f"_hidden.{part}")).otherwise(F.coalesce(f"_own.{part}", F.lit(0)))
        return F.col(f"_public.{part}") + extra

    return joined.select(*viewers.columns, total("n").alias("n_rows"), total("ids").alias("id_sum"))


def own_first_moves(programmes: DataFrame, profiles: DataFrame) -> DataFrame:
    """For every profile the programme that moves to the front (``own``) and the place it leaves (``moved_from``).

    All viewers share one order by name and code, from 1; a viewer's own order is that
    with one programme moved, so orders are kept as one table and one move a viewer. Both are
    null where the profile names no known programme.
    """
    place = positions(programmes.select("code", "name"), [], [F.col("name"), F.col("code")], "_place")
    moves = place.select(F.col("code").alias("own"), (F.col("_place") + 1).alias("moved_from"))
    return profiles.select("id", F.col("programme_code").alias("_p")).join(
        moves, F.col("_p") == F.col("own"), "left"
    ).drop("_p")


def visible_children(
    children: DataFrame, materials: DataFrame, statuses: Sequence[str] = PUBLISHED
) -> DataFrame:
    parents = visible(materials, statuses).select(F.col("id").alias("material_id"))
    return children.join(parents, "material_id", "left_semi")


def readable_files(files: DataFrame, materials: DataFrame, statuses: Sequence[str] = VISIBLE) -> DataFrame:
    """Files that are the main file or a page of a material in a public status."""
    paths = visible(materials, statuses).select(
        F.explode(
            F.concat(
                F.array("file_path"),
                F.coalesce("extra_file_paths", F.array().cast("array<string>")),
            )
        ).alias("path")
    )
    return files.join(paths.where("path is not null"), "path", "left_semi")


def signup_defaults(signups: DataFrame) -> DataFrame:
    """Profiles from sign-up metadata (JSON text in ``meta``)."""

    def field(name: str) -> Column:
        return F.get_json_object("meta", f"$.{name}")

    return signups.select(
        "id",
        F.coalesce(field("full_name"), F.lit("")).alias("full_name"),
        F.nullif(field("student_number"), F.lit("")).alias("student_number"),
        F.coalesce(field("school"), F.lit("")).alias("school"),
        F.coalesce(F.nullif(field("programme_code"), F.lit("")), F.lit("GEN")).alias("programme_code"),
        F.coalesce(F.nullif(field("year"), F.lit("")).try_cast("int"), F.lit(1)).alias("year"),
    )


def featured_courses(settings: DataFrame, courses: DataFrame) -> DataFrame:
    """Courses of the settings array, in array order; unknown codes drop out."""
    wanted = settings.select(F.posexplode("featured_course_codes").alias("position", "code"))
    return wanted.join(courses, "code").orderBy("position")


# --- lookup joins -----------------------------------------------------------


def courses_with_programme(courses: DataFrame, programmes: DataFrame) -> DataFrame:
    names = programmes.select(
        F.col("code").alias("programme_code"), F.col("name").alias("programme_name"), "school"
    )
    return courses.join(names, "programme_code", "left")


def materials_enriched(materials: DataFrame, courses: DataFrame, profiles: DataFrame) -> DataFrame:
    people = profiles.select(
        F.col("id").alias("uploaded_by"), F.col("full_name").alias("uploader_name")
    )
    return in_programme(materials, courses, None).join(people, "uploaded_by", "left")


def materials_by_ids(ids: DataFrame, materials: DataFrame, courses: DataFrame) -> DataFrame:
    """Batch lookup; repeated ids count once, unknown ids drop out."""
    found = ids.select("id").distinct().join(materials.select("id", "title", "type", "course_code"), "id")
    known = courses.select(F.col("code").alias("course_code"), F.lit(True).alias("_known"))
    return found.join(known, "course_code", "left").select(
        "id", "title", "type", F.when(F.col("_known"), F.col("course_code")).alias("course_code")
    )


def requests_with_course(requests: DataFrame, courses: DataFrame) -> DataFrame:
    titles = courses.select(F.col("code").alias("course_code"), F.col("title").alias("course_title"))
    return requests.join(titles, "course_code", "left")


def saved_with_material(saved: DataFrame, materials: DataFrame, courses: DataFrame) -> DataFrame:
    item = materials.select(
        F.col("id").alias("material_id"), F.col("title").alias("material_title"), "type", "course_code"
    )
    titles = courses.select(F.col("code").alias("course_code"), F.col("title").alias("course_title"))
    return saved.join(item, "material_id").join(titles, "course_code", "left")


def like_status(pairs: DataFrame, likes: DataFrame) -> DataFrame:
    liked = likes.select("profile_id", "material_id").distinct().withColumn("_liked", F.lit(True))
    return pairs.join(liked, ["profile_id", "material_id"], "left").select(
        *[F.col(c) for c in pairs.columns], F.coalesce("_liked", F.lit(False)).alias("liked")
    )


def _exists_flag(base: DataFrame, children: DataFrame, flag: str) -> DataFrame:
    keys = children.select(F.col("material_id").alias("id")).distinct().withColumn(flag, F.lit(True))
    return base.join(keys, "id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


# Messages stored with the stage status.
NO_CARDS = "No flashcards were generated before this upgrade — tap Regenerate to create them now."
NO_QUIZ = "No quiz was generated before this upgrade — tap Regenerate to create one now."


def stage_status_backfill(materials: DataFrame, cards: DataFrame, quiz: DataFrame) -> DataFrame:
    """Summary/cards/quiz stage of settled materials, from what exists."""
    settled = visible(materials, ("ready", "catalog_only", "failed"))
    flagged = _exists_flag(_exists_flag(settled, cards, "_cards"), quiz, "_quiz")
    closed = F.col("status").isin("ready", "failed")
    if "summary" in materials.columns:
        has_summary = F.coalesce(F.col("summary") != "", F.lit(False))
    else:
        has_summary = F.lit(False)

    def stage(present: Column, failed: Column) -> Column:
        return F.when(present, "ready").when(failed, "failed").otherwise("pending")

    def error(present: Column, message: str) -> Column:
        return F.when(~present & closed, F.lit(message))

    return flagged.select(
        "id",
        "status",
        stage(has_summary, F.col("status") == "failed").alias("summary_status"),
        stage(F.col("_cards"), closed).alias("flashcards_status"),
        stage(F.col("_quiz"), closed).alias("quiz_status"),
        error(F.col("_cards"), NO_CARDS).alias("flashcards_error"),
        error(F.col("_quiz"), NO_QUIZ).alias("quiz_error"),
    )


# --- ranked lists -----------------------------------------------------------


def popular_materials(materials: DataFrame, n: int = 8) -> DataFrame:
    return (
        visible(materials)
        .orderBy(F.desc("likes_count"), F.desc("download_count"), "id")
        .limit(n)
    )


def top_engagement(materials: DataFrame, courses: DataFrame, n: int = 8) -> DataFrame:
    """Two boards over all statuses: most downloaded and most liked."""
    known = courses.select(F.col("code").alias("course_code"), F.lit(True).alias("_known"))

    def board(name: str, score: str) -> DataFrame:
        best = materials.orderBy(F.desc(score), "id").limit(n)
        return best.join(known, "course_code", "left").select(
            F.lit(name).alias("board"),
            "id",
            "title",
            F.col(score).alias("score"),
            F.when(F.col("_known"), F.col("course_code")).alias("course_code"),
        )

    return board("downloads", "download_count").unionByName(board("likes", "likes_count"))


def failed_queue(materials: DataFrame, updated: str = "created_at") -> DataFrame:
    return materials.where(F.col("status") == "failed").orderBy(F.col(updated).desc_nulls_last(), "id")


def recent_materials(materials: DataFrame, n: int = 8) -> DataFrame:
    return visible(materials).orderBy(*newest_first()).limit(n)


def related_materials(materials: DataFrame, n: int = 6, type: str | None = None) -> DataFrame:
    """For every material, the n newest others of its course.

    Each course keeps n + 1 candidates (one may be the item itself), so the
    join back emits at most n + 1 rows per item however large a course is.
    """
    pool = visible(materials)
    if type is not None:
        pool = pool.where(F.col("type") == type)
    newest = W.partitionBy("course_code").orderBy(*newest_first())
    candidates = (
        pool.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= n + 1)
        .select(
            F.col("course_code").alias("_course"),
            F.col("id").alias("related_id"),
            F.col("title").alias("related_title"),
            "_rank",
        )
    )
    pairs = materials.select("id", "course_code").join(
        candidates,
        F.col("course_code").eqNullSafe(F.col("_course")) & (F.col("id") != F.col("related_id")),
    )
    again = W.partitionBy("id").orderBy("_rank")
    return (
        pairs.withColumn("rank", F.row_number().over(again))
        .where(F.col("rank") <= n)
        .select("id", "rank", "related_id", "related_title")
    )


def past_papers_by_year(materials: DataFrame, paper_type: str = "Past Paper") -> DataFrame:
    order = W.partitionBy("course_code").orderBy(
        F.col("content_year").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "id"
    )
    return materials.where((F.col("type") == paper_type) & F.col("course_code").isNotNull()).select(
        "course_code", "id", "content_year", "created_at", F.row_number().over(order).alias("position")
    )


def own_first_order(programmes: DataFrame, profiles: DataFrame, viewer: object) -> DataFrame:
    """Programmes as one viewer sees them: their own first, then by name."""
    own = profiles.where(F.col("id") == F.lit(viewer)).select(F.col("programme_code").alias("code"))
    marked = programmes.join(own.withColumn("_own", F.lit(0)), "code", "left")
    return marked.withColumn("own", F.col("_own").isNotNull()).orderBy(
        F.coalesce("_own", F.lit(1)), "name", "code"
    ).drop("_own")
