"""Content-based recommendation over whole tables of weighted terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.functions import text as tx
from scholia.operators.neighbours import nearest, pairs_above
from scholia.session import cut_lineage

# Similarity bands of the recommendation reasons.
RELATED, VERY_SIMILAR = 0.3, 0.6
PAPER_TYPES = r"past paper|exam|question paper"


def material_documents(materials: DataFrame, courses: DataFrame) -> DataFrame:
    """(doc_id, text): title, summary, course title, tags and body in one text."""
    titles = courses.select(F.col("code").alias("course_code"), F.col("title").alias("_course"))
    joined = materials.join(titles, "course_code", "left")
    parts = [F.nullif("title", F.lit(""))]
    if "summary" in materials.columns:
        parts.append(F.nullif("summary", F.lit("")))
    parts += [F.nullif("_course", F.lit("")), F.nullif(F.array_join("tags", " "), F.lit("")), F.nullif("text", F.lit(""))]
    return joined.select("doc_id", F.concat_ws(" ", *parts).alias("text"))


def unit_vectors(weights: DataFrame) -> DataFrame:
    """(doc_id, stem, weight) scaled to length one."""
    norms = weights.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_n"))
    return weights.join(norms, "doc_id").where("_n > 0").select(
        "doc_id", "stem", (F.col("weight") / F.col("_n")).alias("u")
    )


def similar_pairs(vectors: DataFrame, min_score: float) -> DataFrame:
    """All pairs (a < b) of unit vectors with cosine >= min_score, exactly, with the number of shared terms.

    Blocks of documents are multiplied, see ``neighbours``; only the pairs above the bound become rows.
    """
    return pairs_above(cut_lineage(vectors), min_score)


def copy_groups(weights: DataFrame) -> DataFrame:
    """(doc_id, rep): documents with the very same weighted terms share a rep."""
    term = F.struct("stem", F.round("weight", 9))
    prints = weights.groupBy("doc_id").agg(
        F.bit_xor(F.xxhash64(term)).alias("x"),
        F.sum(F.xxhash64(F.lit(7), term).cast("decimal(38,0)")).alias("s"),
        F.count("*").alias("n"),
    )
    reps = prints.groupBy("x", "s", "n").agg(F.min("doc_id").alias("rep"))
    return prints.join(reps, ["x", "s", "n"]).select("doc_id", "rep")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Undirected pairs as (item, other) in both directions."""
    sides = F.array(
        F.struct(F.col("a").alias("item"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("item"), F.col("a").alias("other")),
    )
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    return pairs.select(F.explode(sides).alias("p"), *rest).select("p.*", *rest)


def similar_materials(
    weights: DataFrame, k: int = 6, min_score: float = 0.0, allowed: DataFrame | None = None, items: DataFrame | None = None
) -> DataFrame:
    """Top-k most similar items per item, exactly and at any score above zero.

    Exact copies are compared once: only one of a group of equal vectors enters
    the search, and its first k + 1 members stand for the group, which is all a
    top-k can use. ``allowed`` (doc_id) restricts what may be recommended, ``items`` (doc_id)
    for whom; ``min_score`` leaves out weaker partners.
    """
    weights = cut_lineage(weights)
    groups = cut_lineage(copy_groups(weights))
    vectors = cut_lineage(
        unit_vectors(weights.join(groups.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")).where("u > 0")
    )
    eligible = groups if allowed is None else groups.join(allowed.select("doc_id"), "doc_id", "left_semi")
    wanted = groups if items is None else groups.join(items.select("doc_id"), "doc_id", "left_semi")
    # a neighbour without an eligible member must not use up a place
    reps = lambda g: g.select(F.col("rep").alias("doc_id")).distinct()
    turns = eligible.groupBy(F.col("rep").alias("doc_id")).agg(F.min("doc_id").alias("turn"))
    partners = vectors if allowed is None else cut_lineage(vectors.join(turns, "doc_id"))
    seekers = vectors if items is None else cut_lineage(vectors.join(reps(wanted), "doc_id", "left_semi"))
    near = nearest(seekers, partners, k + 1).where(F.col("similarity") >= min_score)
    first = W.partitionBy("rep").orderBy("doc_id")
    members = (
        eligible.withColumn("_m", F.row_number().over(first))
        .where(F.col("_m") <= k + 1)
        .select(F.col("rep").alias("other"), F.col("doc_id").alias("id"), "_m")
    )
    useful = near.join(members.where("_m = 1").select("other", F.col("id").alias("_first")), "other")
    lead = W.partitionBy("item").orderBy(F.desc(F.round("similarity", 9)), "_first")
    best = useful.withColumn("_r", F.row_number().over(lead)).where(F.col("_r") <= k + 1)
    own = wanted.select(F.col("rep").alias("item")).distinct().select("item", F.col("item").alias("other"), F.lit(1.0).alias("similarity"))
    pool = best.select("item", "other", "similarity").unionByName(own).join(members.drop("_m"), "other")
    score = F.round("similarity", 9)
    place = W.partitionBy("item").orderBy(F.desc(score), "id")
    listed = pool.withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= k + 1)
    all_items = wanted.select(F.col("rep").alias("item"), F.col("doc_id").alias("for_id"))
    again = W.partitionBy("for_id").orderBy(F.desc(score), "id")
    return (
        all_items.join(listed.select("item", "id", "similarity"), "item")
        .where(F.col("for_id") != F.col("id"))
        .withColumn("rank", F.row_number().over(again))
        .where(F.col("rank") <= k)
        .select(F.col("for_id").alias("id"), "rank", F.col("id").alias("other_id"), "similarity")
    )


def similar_in_course(weights: DataFrame, materials: DataFrame, k: int = 6) -> DataFrame:
    """Top-k among the materials (doc_id, course_code) of an item's own course; items without a course choose among all.

    A course's stems are words of their own, so that only its members share lists.
    """
    weights = cut_lineage(weights.join(materials.select("doc_id", "course_code"), "doc_id"))
    own = weights.where(F.col("course_code").isNotNull())
    scoped = own.select("doc_id", F.concat(F.col("course_code").cast("string"), F.lit(" "), "stem").alias("stem"), "weight")
    loose = materials.where(F.col("course_code").isNull()).select("doc_id")
    return similar_materials(scoped, k).unionByName(similar_materials(weights.drop("course_code"), k, items=loose))


def related_by_format(
    weights: DataFrame, materials: DataFrame, papers: bool, k: int = 5, min_score: float = 0.0
) -> DataFrame:
    """Similar items that are past papers or exams, or that are not."""
    is_paper = F.coalesce(F.lower("type").rlike(PAPER_TYPES), F.lit(False))
    chosen = materials.where(is_paper if papers else ~is_paper).select("doc_id")
    return similar_materials(weights, k, min_score, chosen)


def concept_overlap(pairs: DataFrame, tags: DataFrame, n: int = 5) -> DataFrame:
    """Tags (and entity names, if given as ``entities``) that both items have."""
    cols = [c for c in ("tags", "entities") if c in tags.columns]
    low = {c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: F.lower(t)) for c in cols}
    sets = tags.select("id", *[e.alias(c) for c, e in low.items()])
    one = sets.select("id", *[F.col(c).alias(f"_a_{c}") for c in cols])
    two = sets.select(F.col("id").alias("other_id"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    joined = pairs.join(one, "id").join(two, "other_id")
    common = F.array_distinct(F.concat(*[F.array_intersect(f"_b_{c}", f"_a_{c}") for c in cols]))
    return joined.withColumn("overlap", F.slice(common, 1, n)).select(*pairs.columns, "overlap")


def recommendation_reasons(recs: DataFrame, materials: DataFrame) -> DataFrame:
    """Reason text per recommendation (id, other_id, similarity, ...)."""
    both = concept_overlap(recs, materials)
    one = materials.select("id", F.col("course_code").alias("_c1"), F.col("type").alias("_t1"))
    two = materials.select(
        F.col("id").alias("other_id"), F.col("course_code").alias("_c2"), F.col("type").alias("_t2")
    )
    s = F.round("similarity", 9)
    parts = F.array(
        F.when(F.col("_c1") == F.col("_c2"), "Same course"),
        F.when(
            F.size("overlap") > 0,
            F.concat(F.lit("Shared concepts: "), F.array_join(F.slice("overlap", 1, 3), ", ")),
        ),
        F.when(s > VERY_SIMILAR, "Very similar content").when(s > RELATED, "Related content").otherwise("Complementary reading"),
        F.when(F.col("_t1") != F.col("_t2"), F.concat(F.lit("Different format ("), "_t2", F.lit(")"))),
    )
    return (
        both.join(one, "id")
        .join(two, "other_id")
        .withColumn("reason", F.array_join(F.array_compact(parts), " · "))
        .drop("_c1", "_t1", "_c2", "_t2")
    )


def novelty_ratio(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Share of the other item's distinct terms that the item does not have.

    ``pairs`` come from ``mirrored(similar_pairs(...))`` with their shared terms.
    """
    sizes = weights.groupBy(F.col("doc_id").alias("other")).agg(F.count("*").alias("_size"))
    return pairs.join(sizes, "other").withColumn(
        "novelty", 1 - F.col("shared_terms") / F.col("_size")
    ).drop("_size")


def next_read(weights: DataFrame, min_score: float = RELATED) -> DataFrame:
    """Per item the related item with the best mix of similarity and new terms."""
    weights = cut_lineage(weights)
    pairs = mirrored(similar_pairs(unit_vectors(weights), min_score))
    scored = novelty_ratio(pairs, weights).withColumn(
        "gap_score", F.round(F.col("similarity") * 0.6 + F.col("novelty") * 0.4, 9)
    )
    # a maximum folds on the map side, so an item with many partners stays small
    best = scored.groupBy("item").agg(
        F.max_by(
            F.struct("other", "similarity", "novelty", "gap_score"),
            F.struct("gap_score", F.round("similarity", 9), (-F.col("other")).alias("o")),
        ).alias("b")
    )
    whole = lambda c: F.floor(F.round(F.col(c), 9) * 100 + 0.5).cast("string")
    return best.select("item", "b.*").select(
        F.col("item").alias("id"),
        F.col("other").alias("other_id"),
        "similarity",
        "novelty",
        "gap_score",
        F.concat(
            F.lit("Best next read — "), whole("similarity"), F.lit("% similar, "), whole("novelty"),
            F.lit("% new content."),
        ).alias("reason"),
    )


# --- plans over materials ---------------------------------------------------

# Levels in learning order.
LEVELS = [
    ("beginner", "Foundation", "Start here — build foundational knowledge"),
    ("intermediate", "Intermediate", "Core concepts and applications"),
    ("advanced", "Advanced", "Complex topics and deeper analysis"),
    ("expert", "Expert", "Research-level content and specialization"),
]
MINUTES_PER_MATERIAL = 60


def _level(col: int) -> Column:
    out = F.when(F.col("level") == LEVELS[0][0], F.lit(LEVELS[0][col]))
    for row in LEVELS[1:]:
        out = out.when(F.col("level") == row[0], F.lit(row[col]))
    return out


def progression_levels(docs: DataFrame) -> DataFrame:
    """The level of each document on the way from foundation to expert."""
    from scholia.operators.text import difficulty

    graded = difficulty(docs).select("doc_id", "level")
    step = F.lit(len(LEVELS))
    for i, row in reversed(list(enumerate(LEVELS))):
        step = F.when(F.col("level") == row[0], F.lit(i)).otherwise(step)
    return graded.select("doc_id", step.alias("step"), _level(1).alias("level"), _level(2).alias("description"))


def progression_plan(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per level: documents, minutes, and skills of its first documents.

    ``topics`` are key topics (doc_id, rank, topic), three per document.
    """
    levels = progression_levels(docs)
    sizes = levels.groupBy("step", "level", "description").agg(F.count("*").alias("n_materials"))
    order = W.partitionBy("step").orderBy("doc_id", "rank")
    first5 = (
        topics.join(levels.select("doc_id", "step"), "doc_id")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= 5)
        .groupBy("step")
        .agg(
            F.array_distinct(
                F.transform(F.array_sort(F.collect_list(F.struct("_n", "topic"))), lambda t: t["topic"])
            ).alias("skills")
        )
    )
    return sizes.join(first5, "step", "left").select(
        "step", "level", "description", "n_materials",
        (F.col("n_materials") * MINUTES_PER_MATERIAL).alias("minutes"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
    )


# --- search queries and re-ranking ------------------------------------------

# Titles that are labels, words that carry no subject.
LABEL_TITLES = [
    r"^[a-z]{2,14}\s*\d{0,4}$",
    r"^(test|notes?|tutorial|tut|assignment|past\s*paper|exam|quiz|worksheet|handout|lecture)\s*\d*$",
]
SCAFFOLD_WORDS = "university lecture explained tutorial example examples demonstration experiment animation derivation solution worked formula programming code real world past paper".split()
RERANK_STOP_WORDS = "a an the of in on at to for and or is are with by from".split()


def search_queries(
    materials: DataFrame, topics: DataFrame, words: DataFrame, domains: DataFrame, formulas: DataFrame
) -> DataFrame:
    """Ranked distinct search strings per material, strongest first.

    materials (doc_id, title, type, course_code, course_title); the others give
    arrays per doc_id: topics, words, domains, and formulas (raw, description).
    """
    none = F.array().cast("array<string>")
    no_formula = F.array().cast("array<struct<raw:string,description:string>>")
    m = (
        materials.join(topics, "doc_id", "left")
        .join(words, "doc_id", "left")
        .join(domains, "doc_id", "left")
        .join(formulas, "doc_id", "left")
        .withColumns(
            {
                "topics": F.coalesce("topics", none),
                "words": F.coalesce("words", none),
                "domains": F.coalesce("domains", none),
                "formulas": F.coalesce("formulas", no_formula),
            }
        )
    )
    topic = F.get("topics", F.lit(0))
    course, code = F.nullif("course_title", F.lit("")), F.col("course_code").cast("string")
    two = F.when(F.size("words") > 0, F.array_join(F.slice("words", 1, 2), " "))
    three = F.when(F.size("words") >= 2, F.array_join(F.slice("words", 1, 3), " "))
    f1, f2 = F.get("formulas", F.lit(0)), F.get("formulas", F.lit(1))
    in_domain = lambda name, value: F.when(F.array_contains("domains", name), value)
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title = tx.strip("title")
    is_label = tx.matches(title, "|".join(f"(?:{p})" for p in LABEL_TITLES), "i")
    good_title = F.when((F.length(title) >= 12) & ~is_label, F.col("title"))
    paper = tx.matches("type", r"past\s*paper|exam", "i")
    parts = [
        say(course, " ", topic, " university lecture"),
        say(code, " ", topic),
        say(topic, " university lecture explained"),
        in_domain("mathematics", say(two, " worked example")),
        in_domain("mathematics", say(f1["raw"], " explained")),
        in_domain("physics", say(topic, " physics demonstration")),
        in_domain("chemistry", say(topic, " chemistry experiment")),
        in_domain("biology", say(topic, " biology animation")),
        in_domain("computer_science", say(two, " programming tutorial")),
        in_domain("economics", say(topic, " economics explained")),
        say(three, " tutorial"),
        say(two, " examples"),
        F.when(paper, say(course, " past paper solution")),
        say(f1["description"], " formula derivation"),
        say(f2["description"], " formula derivation"),
        say(good_title, " explained"),
        say(good_title, " lecture"),
    ]
    queries = F.filter(
        F.array_distinct(F.array_compact(F.array(*parts))), lambda q: F.length(tx.strip(q)) > 3
    )
    return m.select("doc_id", F.posexplode(queries).alias("rank", "query"))


def rerank_results(queries: DataFrame, results: DataFrame, n: int = 6) -> DataFrame:
    """Results by how many subject words of their query they show.

    A word in the title counts 1, in the channel .5; results with none drop
    out unless the query has no subject word at all.
    """
    words = F.array_distinct(
        F.filter(
            F.split(F.lower("query"), "[^a-z0-9]+"),
            lambda w: (F.length(w) > 2) & ~w.isin(*RERANK_STOP_WORDS) & ~w.isin(*SCAFFOLD_WORDS),
        )
    )
    joined = results.join(queries.select("query_id", words.alias("_w")), "query_id")
    score = F.aggregate(
        "_w",
        F.lit(0.0),
        lambda acc, w: acc
        + F.when(F.lower("title").contains(w), 1.0).when(F.lower("channel").contains(w), 0.5).otherwise(0.0),
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return (
        joined.withColumn("score", score)
        .where((F.size("_w") == 0) | (F.col("score") > 0))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("query_id", "rank", "result_id", "score")
    )
