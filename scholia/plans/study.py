"""Queries that extract, rank, link and recommend over document text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scholia.functions import text as fx
from scholia.operators import extraction as ex
from scholia.operators import graph as g
from scholia.operators import local_terms as lt
from scholia.operators import recommend as r
from scholia.operators import structure as st
from scholia.operators import study as s
from scholia.operators import text as x
from scholia.plans import duck
from scholia.plans.corpus import CHUNKS, LANGS, METRICS, TAGGED, keyword_ctes, topic_ctes
from scholia.plans.duck import q, sql
from scholia.plans.registry import register
from scholia.session import cut_lineage
from scholia.sources import files
from scholia.sources.tables import Catalog

text_of = lambda df, *cols: df.withColumns({c: F.array_join(c, "|") for c in cols})
long_of = lambda df, *cols: df.withColumns({c: F.col(c).cast("long") for c in cols})

# --- structure --------------------------------------------------------------


def _any(patterns, col="text"):
    return " OR ".join(f"regexp_matches({col}, {q((f'(?{f})' if f else '') + p)})" for p, f in patterns)


@register(
    "structure_flags",
    sql(f"""SELECT doc_id, {_any(st.CONTENTS)} AS has_contents, {_any(st.REFERENCES)} AS has_references,
              {_any(st.APPENDIX)} AS has_appendix FROM docs"""),
)
def _(t: Catalog):
    return st.structure_flags(t.documents)


def _heading_sql() -> tuple[str, str]:
    """Level and title of a line, by the first heading pattern that it matches."""
    level, title = "CASE", "CASE"
    for i, (pattern, flags, fixed, group) in enumerate(st.HEADINGS):
        p = q((f"(?{flags})" if flags else "") + pattern)
        marker = f"regexp_extract(line, {p}, 1)"
        depth = str(fixed) if fixed is not None else f"length({marker})" if i == 0 else f"len(string_split({marker}, '.'))"
        stripped = duck.strip(f"regexp_extract(line, {p}, {group})")
        level += f" WHEN regexp_matches(line, {p}) THEN {depth}"
        title += f" WHEN regexp_matches(line, {p}) THEN regexp_replace({stripped}, '^[:.]+\\s*', '')"
    return level + " END", title + " END"


_LEVEL, _TITLE = _heading_sql()
SECTIONS = dict(
    heads=f"""SELECT doc_id, line_no, line, CASE WHEN short THEN lv END AS lv, CASE WHEN short THEN title END AS title FROM (
      SELECT *, len(regexp_split_to_array(title, '\\s+')) <= {st.HEADING_WORDS} AS short FROM (
        SELECT doc_id, line_no, line, CASE WHEN line <> '' THEN {_LEVEL} END AS lv, CASE WHEN line <> '' THEN {_TITLE} END AS title FROM (
          SELECT doc_id, i - 1 AS line_no, {duck.strip('ls[i]')} AS line FROM (
            SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM docs)))))""",
    sects="""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS section, CASE WHEN s = 0 THEN 'Introduction' ELSE title END AS title,
        CASE WHEN s = 0 THEN 0 ELSE lv END AS level, coalesce(content, '') AS content FROM (
      SELECT doc_id, s, max(title) AS title, max(lv) AS lv, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE lv IS NULL) AS content,
        max(line_no) FILTER (WHERE line <> '') AS last FROM (
        SELECT *, count(lv) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM heads) GROUP BY doc_id, s)
      WHERE s > 0 OR last >= 5""",
)


@register(
    "sections",
    sql(
        f"""SELECT doc_id, section, title, CAST(level AS BIGINT) AS level, {duck.strip('content')} AS content,
          (SELECT max(e.section) FROM sects e WHERE e.doc_id = f.doc_id AND e.section < f.section AND e.level < f.level) AS parent_section FROM sects f""",
        **SECTIONS,
    ),
)
def _(t: Catalog):
    return long_of(st.sections(t.documents), "section", "level", "parent_section")


@register("text_tables")
def _(t: Catalog):
    return st.text_tables(t.documents)


@register("figures")
def _(t: Catalog):
    return text_of(st.figures(t.documents), "mentions")


@register(
    "document_profile",
    sql(
        f"""SELECT doc_id, word_count, CAST(ceil(word_count / 200) AS BIGINT) AS reading_minutes, n_sections, has_contents, has_references, has_appendix, reading_ease, level, language,
          CAST(least(100, greatest(0, 50 + (word_count > 500)::INT * 10 + (word_count > 2000)::INT * 10 + (n_sections > 3)::INT * 10 + has_references::INT * 5
            + has_contents::INT * 5 + (grade BETWEEN 8 AND 16)::INT * 10 + (level IN ('intermediate', 'advanced'))::INT * 5)) AS BIGINT) AS quality_score
        FROM (SELECT d.doc_id, coalesce(w.n, 0) AS word_count, coalesce(k.n, 0) AS n_sections, {_any(st.CONTENTS, 'd.text')} AS has_contents,
            {_any(st.REFERENCES, 'd.text')} AS has_references, {_any(st.APPENDIX, 'd.text')} AS has_appendix, r.reading_ease, r.grade, f.level, g.language
          FROM docs d JOIN readab r USING (doc_id) JOIN diffs f USING (doc_id) JOIN langs g USING (doc_id)
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM ctoks GROUP BY doc_id) w USING (doc_id)
          LEFT JOIN (SELECT doc_id, count(*) AS n FROM sects f WHERE NOT EXISTS (SELECT 1 FROM sects e WHERE e.doc_id = f.doc_id AND e.section < f.section AND e.level < f.level)
            GROUP BY doc_id) k USING (doc_id))""",
        **SECTIONS, **METRICS, **LANGS,
    ),
)
def _(t: Catalog):
    return long_of(x.document_profile(t.documents), "reading_minutes", "n_sections")


def _local_sql() -> tuple[str, str]:
    """The rewritten text and the terms found, rule by rule. Word edges make one look-ahead idle; the other is kept as a group."""
    text, hits = "text", []
    rule = lambda p, f: q((f"(?{f})" if f else "") + p)
    for term, expansion, category in lt.default_terms():
        p = rule(lt._pattern(term), lt._flags(category))
        hits.append(f"CASE WHEN regexp_matches(text, {p}) THEN regexp_extract(text, {p}) END")
        if category != "slang":
            text = f"regexp_replace({text}, {p}, {q(expansion)}, 'g')"
    for pattern, expansion, flags in lt.PHRASE_RULES:
        ahead = re.search(r"\(\?=(.*)\)$", pattern)
        if ahead:
            pattern, expansion = pattern[: ahead.start()] + f"({ahead[1]})", expansion + "\\1"
        text = f"regexp_replace({text}, {rule(pattern.removesuffix('(?![a-z])'), flags)}, {q(expansion)}, 'g')"
    return text, "[" + ", ".join(hits) + "]"


_LOCAL_TEXT, _LOCAL_HITS = _local_sql()


@register(
    "normalise_local_terms",
    sql(f"""SELECT doc_id, md5(fresh) AS text, array_to_string(found, '|') AS expansions, CAST(codes AS BIGINT) AS n_codes,
              round(greatest(0.5, 1 - (len(found) + codes) / greatest(words, 1) * 0.1), 6) AS confidence
            FROM (SELECT doc_id, {_LOCAL_TEXT} AS fresh, len(regexp_extract_all(text, {q(ex.COURSE_CODE)})) AS codes, len(regexp_split_to_array(text, '\\s+')) AS words,
                list_filter(hits, lambda h, i: list_position(list_transform(hits, lambda g: lower(g)), lower(h)) = i) AS found
              FROM (SELECT doc_id, text, list_filter({_LOCAL_HITS}, lambda h: h IS NOT NULL) AS hits FROM docs))"""),
)
def _(t: Catalog):
    out = lt.normalise_local_terms(t.documents)
    found = F.array_join(F.transform("expansions", lambda e: e["original"]), "|")
    return out.select("doc_id", F.md5("text").alias("text"), found.alias("expansions"), F.size("course_codes").cast("long").alias("n_codes"), "confidence")


@register(
    "has_local_patterns",
    sql(
        "SELECT doc_id, regexp_matches(lower(text), "
        + q("|".join(lt._pattern(w) for w in dict.fromkeys(w.lower() for w, _, _ in lt.default_terms())))
        + f") OR regexp_matches(text, {q(ex.COURSE_CODE)}) AS has_local_patterns FROM docs"
    ),
)
def _(t: Catalog):
    return lt.has_local_patterns(t.documents)


@register(
    "file_kind",
    sql("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'text' WHEN page_id % 4 = 1 THEN 'pdf' WHEN page_id % 4 = 2 THEN 'image' ELSE 'none' END AS kind FROM pages"""),
)
def _(t: Catalog):
    """Pages as files: by extension, by MIME type, by leading bytes, by nothing."""
    turn = F.col("page_id") % 4
    held = t.pages.select(
        "page_id",
        F.when(turn == 0, F.concat("url", F.lit(".html"))).otherwise(F.concat("url", F.lit("/x"))).alias("path"),
        F.when(turn == 1, "application/pdf; q=1").alias("mime"),
        F.when(turn == 2, F.concat(F.unhex(F.lit("89504E47")), F.encode("html", "UTF-8"))).otherwise(F.encode("html", "UTF-8")).alias("content"),
    )
    return files.file_kind(held).select("page_id", "kind")


# --- extraction -------------------------------------------------------------

MENTIONS = " UNION ALL ".join(
    [
        f"SELECT doc_id, {i} AS step, unnest(range(1, len(ms) + 1)) AS pos, {q(k)} AS type, unnest(ms) AS text FROM "
        f"(SELECT doc_id, regexp_extract_all(text, {q((f'(?{f})' if f else '') + p)}, 1) AS ms FROM docs)"
        for i, (k, p, f) in enumerate(ex.ENTITY_PATTERNS)
    ]
    + [
        f"SELECT doc_id, {len(ex.ENTITY_PATTERNS) + i}, unnest(range(1, len(ms) + 1)), 'unit', {q(u)} FROM "
        f"(SELECT doc_id, regexp_extract_all(text, {q(chr(40) + '?i)' + chr(92) + 'b' + u + chr(92) + 'b')}) AS ms FROM docs) WHERE len(ms) > 0"
        for i, u in enumerate(ex.UNITS)
    ]
)
ENTITIES = f"""
    SELECT doc_id, type, lower(text) AS key, count(*) AS frequency FROM mentions
      WHERE type <> 'concept' AND NOT (type = 'person' AND lower(text) IN {duck.word_list(ex.COMMON_PHRASES)}) GROUP BY ALL
    UNION ALL SELECT doc_id, 'concept', lower(text), count(*) FROM (SELECT doc_id, text FROM mentions WHERE type = 'concept'
      AND lower(text) NOT IN {duck.word_list(ex.COMMON_PHRASES)} GROUP BY doc_id, text HAVING count(*) >= 2) GROUP BY ALL
    UNION ALL SELECT doc_id, 'term', token, count(*) FROM ctoks GROUP BY doc_id, token HAVING count(*) >= 5"""
ENT = dict(mentions=MENTIONS, ents=ENTITIES)


@register("entities", sql("SELECT doc_id, type, key, frequency FROM ents", **ENT))
def _(t: Catalog):
    return ex.entities(t.documents).select("doc_id", "type", "key", "frequency")


@register(
    "entity_index",
    sql("SELECT type, key, count(*) AS n_docs, CAST(sum(frequency) AS BIGINT) AS total FROM ents GROUP BY type, key", **ENT),
)
def _(t: Catalog):
    return ex.entity_index(ex.entities(t.documents))


@register("entity_contexts")
def _(t: Catalog):
    return ex.entity_contexts(t.documents, "person")


@register("formulas")
def _(t: Catalog):
    return text_of(ex.formulas(t.documents), "variables")


MATH = [(p.replace("(?!\\w)", ""), n) for p, n in ex.FORMULA_STEPS]


@register(
    "inline_formulas",
    sql(
        """SELECT doc_id, raw FROM (SELECT doc_id, lower(raw) AS k, arg_min(raw, step * 100000 + pos) AS raw FROM found WHERE length(raw) >= 2 GROUP BY ALL)""",
        found=" UNION ALL ".join(
            f"SELECT doc_id, {i} AS step, unnest(range(1, len(ms) + 1)) AS pos, {duck.strip(f'regexp_replace(unnest(ms), {q(n)}, {q(str())}, {q(chr(103))})')} AS raw FROM "
            f"(SELECT doc_id, regexp_extract_all(text, {q(p)}) AS ms FROM docs)"
            for i, (p, n) in enumerate(MATH)
        ),
    ),
)
def _(t: Catalog):
    marked = t.documents.where(F.col("text").contains("$") | F.col("text").contains("\\"))
    parts = F.concat(*[ex._math_matches(i, p, n) for i, (p, n) in enumerate(ex.FORMULA_STEPS)])
    rows = marked.select("doc_id", F.explode(parts).alias("f"))
    first = rows.groupBy("doc_id", F.lower("f.raw").alias("k")).agg(F.min_by("f.raw", F.struct("f.step", "f.i")).alias("raw"))
    return first.select("doc_id", "raw")


DEFS = " UNION ALL ".join(
    f"SELECT doc_id, sent_idx, {i} AS step, {duck.strip(f'regexp_extract(sentence, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 1)')} AS term, "
    f"{duck.strip(f'regexp_extract(sentence, {q(chr(40) + chr(63) + chr(105) + chr(41) + p)}, 2)')} AS definition FROM sents WHERE length(sentence) BETWEEN 20 AND 300"
    for i, p in enumerate(ex.DEFINITION_PATTERNS)
)


@register(
    "definitions",
    sql(
        f"""SELECT doc_id, sent_idx, term, definition FROM (
              SELECT * FROM defs WHERE length(term) BETWEEN 3 AND 80 AND len(regexp_split_to_array(term, '\\s+')) <= 8
                AND lower(regexp_split_to_array(term, '\\s+')[1]) NOT IN {duck.word_list(duck.lexicon.stop_words())}
                AND length(definition) BETWEEN 25 AND 250 AND len(regexp_split_to_array(definition, '\\s+')) >= 4
                AND lower(term) NOT IN {duck.word_list(ex.POINTING_WORDS)}
              QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY step) = 1)
            QUALIFY row_number() OVER (PARTITION BY doc_id, lower(term) ORDER BY sent_idx) = 1""",
        defs=DEFS,
    ),
)
def _(t: Catalog):
    return long_of(ex.definitions(t.documents), "sent_idx").select("doc_id", "sent_idx", "term", "definition")


@register("glossary")
def _(t: Catalog):
    return text_of(ex.glossary(t.documents), "related").drop("key")


@register("references")
def _(t: Catalog):
    return text_of(ex.references(t.documents), "authors")


@register("citation_counts")
def _(t: Catalog):
    return ex.citation_counts(ex.references(t.documents))


@register("causal_relations")
def _(t: Catalog):
    return ex.causal_relations(t.documents)


@register("reasoning_steps")
def _(t: Catalog):
    return text_of(ex.reasoning_steps(t.documents), "fallacies")


@register("inferences")
def _(t: Catalog):
    return text_of(ex.inferences(t.documents), "premises")


@register("prerequisites")
def _(t: Catalog):
    return ex.prerequisites(t.documents)


@register(
    "course_codes",
    sql(f"""SELECT doc_id, code, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(ex.COURSE_CODE)})) AS code FROM docs) GROUP BY ALL"""),
)
def _(t: Catalog):
    return ex.course_codes(t.documents)


@register(
    "course_code_index",
    sql(f"""SELECT code, count(DISTINCT doc_id) AS n_docs, count(*) AS mentions FROM (SELECT doc_id, unnest(regexp_extract_all(text, {q(ex.COURSE_CODE)})) AS code FROM docs) GROUP BY ALL"""),
)
def _(t: Catalog):
    return ex.course_code_index(ex.course_codes(t.documents))


def _questions(t: Catalog):
    return t.flashcards.select(F.col("id").alias("question_id"), F.col("material_id").alias("doc_id"), "question")


@register(
    "answer_sentences",
    sql("""
    SELECT f.id AS question_id, f.material_id AS doc_id, row_number() OVER (PARTITION BY f.id ORDER BY hits DESC, sent_idx) AS rank, sent_idx, hits
    FROM (SELECT f.id, f.material_id, s.sent_idx, len(list_filter(f.w, lambda w: contains(lower(s.sentence), w))) AS hits
      FROM (SELECT id, material_id, list_filter(regexp_split_to_array(lower(question), '\\s+'), lambda w: length(w) > 4) AS w FROM flashcards) f
      JOIN sents s ON s.doc_id = f.material_id) f WHERE hits > 0"""),
)
def _(t: Catalog):
    out = ex.answer_sentences(_questions(t), t.documents)
    return long_of(out, "sent_idx").drop("sentence")


@register("answers")
def _(t: Catalog):
    return ex.answers(_questions(t), t.documents)


# --- sentence ranking and study items ---------------------------------------

SUNIT = """
    SELECT doc_id, sent_idx, stem, tf / sqrt(sum(tf * tf) OVER (PARTITION BY doc_id, sent_idx)) AS u FROM stf"""


@register(
    "sentence_similarity",
    sql(
        """SELECT a.doc_id, a.sent_idx AS i, b.sent_idx AS j, round(sum(a.u * b.u), 6) AS similarity FROM sunit a JOIN sunit b
           ON a.doc_id = b.doc_id AND a.stem = b.stem AND a.sent_idx < b.sent_idx GROUP BY ALL HAVING sum(a.u * b.u) >= 0.5""",
        sunit=SUNIT,
    ),
)
def _(t: Catalog):
    out = s.sentence_similarity(t.documents, 0.5)
    return long_of(out.withColumn("similarity", F.round("similarity", 6)), "i", "j")


@register(
    "sentence_connectivity",
    sql(
        """SELECT doc_id, sent_idx, round(sum(u * (c - u)), 6) AS connectivity FROM
           (SELECT *, sum(u) OVER (PARTITION BY doc_id, stem) AS c FROM sunit) GROUP BY doc_id, sent_idx""",
        sunit=SUNIT,
    ),
)
def _(t: Catalog):
    out = s.sentence_connectivity(t.documents).withColumn("connectivity", F.round("connectivity", 6) + 0.0)
    return long_of(out, "sent_idx")


@register("textrank")
def _(t: Catalog):
    return s.textrank(t.documents)


POINTS = "CASE " + " ".join(f"WHEN {duck.category('w')} = {q(k)} THEN {v}::DOUBLE" for k, v in s.CATEGORY_POINTS.items()) + " ELSE 0.1::DOUBLE END"
SIGNALS = list(dict.fromkeys(duck.lexicon.SIGNAL_WORDS))
CUES = " + ".join(f"regexp_matches(sentence, {q((f'(?{f})' if f else '') + p)})::INT * {v}" for p, f, v in s.SENTENCE_CUES)
DOMS = " + ".join(f"({duck.hits('lower(sentence)', w.split())} > 0)::INT" for w in duck.lexicon.DOMAIN_KEYWORDS.values())


@register(
    "sentence_salience",
    sql(
        f"""SELECT doc_id, sent_idx, round(coalesce(p, 0) + {duck.hits('lower(sentence)', SIGNALS)} + {CUES} + ({DOMS}) * 0.5, 6) AS salience
            FROM sents LEFT JOIN (SELECT doc_id, sent_idx, sum(points) AS p FROM swords JOIN wpoints USING (w) GROUP BY ALL) USING (doc_id, sent_idx)""",
        swords=f"SELECT doc_id, sent_idx, unnest({duck.tok('sentence')}) AS w FROM sents",
        wpoints=f"SELECT w, {POINTS} AS points FROM (SELECT DISTINCT w FROM swords)",
    ),
)
def _(t: Catalog):
    return long_of(s.sentence_salience(t.documents).withColumn("salience", F.round("salience", 6)), "sent_idx")


@register("summarise")
def _(t: Catalog):
    return s.summarise(t.documents, 7)


@register("one_line_summary")
def _(t: Catalog):
    return s.summarise(t.documents, 1)


@register("key_points")
def _(t: Catalog):
    return s.key_points(t.documents)


@register("cloze_cards")
def _(t: Catalog):
    return s.cloze_cards(t.documents, 8)


@register("flashcards")
def _(t: Catalog):
    return s.flashcards(t.documents)


@register("quiz")
def _(t: Catalog):
    return text_of(s.quiz(t.documents), "options")


@register("normalise_cards", sql("""
    SELECT doc_id, place AS position, question, answer FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS place, question, answer FROM (
      SELECT * FROM (SELECT conv_id // 2 AS doc_id, conv_id * 100 + turn AS position, """ + duck.strip("regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')") + """ AS question, role AS answer FROM conversations)
      WHERE question <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, lower(question) ORDER BY position) = 1)
    QUALIFY place < 3)"""))
def _(t: Catalog):
    from scholia.operators.writes import normalise_cards

    raw = t.conversations.select(
        F.floor(F.col("conv_id") / 2).alias("doc_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("position"),
        F.col("text").alias("question"),
        F.col("role").alias("answer"),
    )
    return long_of(normalise_cards(raw, 3), "position")


@register("normalise_quiz", sql("""
    SELECT doc_id, place AS position, question, options, correct_index FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY position) - 1 AS place, question, array_to_string(list_transform(kept, lambda z: z.v), '|') AS options,
      CAST(greatest(coalesce(list_position(list_transform(kept, lambda z: z.i), want), 0) - 1, 0) AS INT) AS correct_index FROM (
      SELECT o_custkey AS doc_id, o_orderkey AS position, 'Q' || o_orderkey AS question, o_orderkey % 6 - 1 AS want,
        list_filter([{i: 0, v: trim(CASE WHEN o_orderkey % 3 = 0 THEN '  ' ELSE o_orderstatus END)}, {i: 1, v: o_orderpriority}, {i: 2, v: CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'x' END},
          {i: 3, v: CASE WHEN o_orderkey % 7 < 4 THEN NULL ELSE 'y' END}, {i: 4, v: 'z'}], lambda z: z.v IS NOT NULL AND z.v <> '')[1:4] AS kept FROM orders WHERE o_orderpriority IS NOT NULL)
    WHERE len(kept) >= 2 QUALIFY place < 12)"""))
def _(t: Catalog):
    from scholia.operators.writes import normalise_quiz

    k = F.col("o_orderkey")
    raw = t.orders.select(
        F.col("o_custkey").alias("doc_id"),
        k.alias("position"),
        F.concat(F.lit("Q"), k.cast("string")).alias("question"),
        F.array(
            F.when(k % 3 == 0, "  ").otherwise(F.col("o_orderstatus")), F.col("o_orderpriority"),
            F.when(k % 5 == 0, "").otherwise("x"), F.when(k % 7 >= 4, "y"), F.lit("z"),
        ).alias("options"),
        (k % 6 - 1).cast("int").alias("correct_index"),
        F.lit("why").alias("explanation"),
    )
    return text_of(normalise_quiz(raw), "options").drop("explanation")


# --- concept graph ----------------------------------------------------------

GRAPH = {
    **keyword_ctes(30, "kw30"),
    "tagged": TAGGED,
    "chunks24": CHUNKS.format(lo=2, hi=4),
    "labels_": """
      SELECT doc_id, label, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS node FROM (
        SELECT doc_id, label, min(o) AS o FROM (
          SELECT doc_id, keyword AS label, rank AS o FROM kw30 UNION ALL SELECT doc_id, phrase, 1000 + nth FROM chunks24 WHERE nth <= 20)
        JOIN ready USING (doc_id) GROUP BY doc_id, label)""",
    "ready": f"SELECT doc_id FROM docs WHERE length({duck.strip('text')}) >= 50",
    "nodes": f"""
      SELECT l.doc_id, l.node, l.label, l.stem, coalesce(tf, 1) AS weight, l.node = max(l.node) OVER (PARTITION BY l.doc_id, l.stem) AS owns_stem,
        CASE WHEN regexp_matches(label, '^[A-Z].*\\s') THEN 'entity' WHEN regexp_matches(label, '(?i)\\b(law|principle|rule|theorem)\\b') THEN 'law'
             WHEN regexp_matches(label, '[=∑∫∏∂∇√]') THEN 'formula' WHEN regexp_matches(label, '(?i)\\b(method|approach|technique|procedure|algorithm|process)\\b') THEN 'method' ELSE 'concept' END AS type
      FROM (SELECT doc_id, node, label, {duck.stem('w')} AS stem FROM (SELECT *, string_split(lower(label), ' ')[1] AS w FROM labels_)) l LEFT JOIN tf t ON t.doc_id = l.doc_id AND t.stem = l.stem""",
    "near8": """
      SELECT a.doc_id, a.stem, b.stem AS near, count(*) AS n, min(a.pos * 1000000 + b.pos) AS first FROM cstems a JOIN cstems b
      ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - 8 AND a.pos + 8 AND a.pos <> b.pos GROUP BY a.doc_id, a.stem, b.stem
      QUALIFY row_number() OVER (PARTITION BY a.doc_id, a.stem ORDER BY n DESC, first) <= 5""",
    "edges": """
      SELECT doc_id, source, target, source_label, target_label, weight FROM (
        SELECT s.doc_id, s.node AS source, d.node AS target, s.label AS source_label, d.label AS target_label, k.n AS weight, k.first
        FROM nodes s JOIN near8 k ON k.doc_id = s.doc_id AND k.stem = s.stem JOIN nodes d ON d.doc_id = s.doc_id AND d.stem = k.near AND d.owns_stem WHERE s.node <> d.node)
      QUALIFY row_number() OVER (PARTITION BY doc_id, least(source, target), greatest(source, target) ORDER BY source, weight DESC, first) = 1""",
}


# labels hold letters, digits, hyphens, apostrophes and blanks, which stand for themselves in a pattern
MEANING = duck.strip("coalesce(" + ", ".join(f"NULLIF(regexp_extract(text, '(?i)' || label || {q(tail)}, 1), '')" for tail in g.DEFINITION_TAILS) + ")")


@register(
    "concept_nodes",
    sql(
        f"""SELECT doc_id, node, label, type, weight, owns_stem, CASE WHEN regexp_matches(text, '(?i)' || label || '\\s+(?:is|are|refers?|means?)\\s') THEN {MEANING} END AS definition
            FROM nodes JOIN docs USING (doc_id)""",
        **GRAPH,
    ),
)
def _(t: Catalog):
    out = g.concept_nodes(t.documents, phrases=g.REFERENCE_PHRASES).drop("stem")
    return long_of(out, "node")


@register("concept_definitions")
def _(t: Catalog):
    return g.concept_nodes(t.documents, phrases=g.REFERENCE_PHRASES).where("definition is not null").select("doc_id", "node", "label", "definition")


def _graph(t: Catalog):
    nodes = cut_lineage(g.concept_nodes(t.documents, with_definitions=False, phrases=g.REFERENCE_PHRASES))
    return nodes, cut_lineage(g.concept_edges(t.documents, nodes))


@register("concept_edges", sql("SELECT doc_id, source, target, weight FROM edges", **GRAPH))
def _(t: Catalog):
    _, edges = _graph(t)
    return long_of(edges.select("doc_id", "source", "target", "weight"), "source", "target")


@register("edge_relations")
def _(t: Catalog):
    _, edges = _graph(t)
    return g.edge_relations(edges, t.documents).select("doc_id", "source", "target", "relation")


#: Rounds of merging that the checking SQL spells out; the query ends as soon as no merge gains.
MERGE_ROUNDS = 16


def _merging(rounds: int) -> dict[str, str]:
    out = {
        "slinks": """SELECT least(a.stem, b.stem) AS a, greatest(a.stem, b.stem) AS b, CAST(sum(e.weight) AS HUGEINT) AS w FROM edges e
          JOIN nodes a ON a.doc_id = e.doc_id AND a.node = e.source JOIN nodes b ON b.doc_id = e.doc_id AND b.node = e.target WHERE a.stem <> b.stem GROUP BY 1, 2""",
        "arcs": "SELECT a, b, w FROM slinks UNION ALL SELECT b, a, w FROM slinks",
        "total2": "SELECT sum(w) AS m2 FROM arcs",
        "lab0": "SELECT DISTINCT a AS node, a AS component FROM arcs",
    }
    for r in range(rounds):
        out[f"arc{r}"] = f"""SELECT x.component AS a, y.component AS b, sum(w) AS w FROM arcs JOIN lab{r} x ON x.node = arcs.a
          JOIN lab{r} y ON y.node = arcs.b GROUP BY 1, 2"""
        out[f"deg{r}"] = f"SELECT a, sum(w) AS d FROM arc{r} GROUP BY a"
        out[f"best{r}"] = f"""SELECT q.a, q.b FROM arc{r} q JOIN deg{r} s ON s.a = q.a JOIN deg{r} t ON t.a = q.b, total2
          WHERE q.a <> q.b AND m2 * q.w > s.d * t.d QUALIFY row_number() OVER (PARTITION BY q.a ORDER BY m2 * q.w - s.d * t.d DESC, q.b) = 1"""
        out[f"lab{r + 1}"] = f"""SELECT l.node, CASE WHEN v.b = f.b THEN least(f.b, u.b) ELSE l.component END AS component FROM lab{r} l
          LEFT JOIN best{r} f ON f.a = l.component LEFT JOIN best{r} u ON u.a = f.b LEFT JOIN best{r} v ON v.a = u.b"""
    return out


@register(
    "concept_clusters",
    sql(
        f"""SELECT component, n_nodes, label, summary FROM (SELECT component, count(*) AS n_nodes FROM lab{MERGE_ROUNDS} GROUP BY component)
            JOIN (SELECT component, max(CASE WHEN r = 1 THEN stem END) AS label, string_agg(stem, ', ' ORDER BY r) AS summary FROM placed_ WHERE r <= 5 GROUP BY component)
            USING (component)""",
        **GRAPH,
        **_merging(MERGE_ROUNDS),
        heavy="SELECT stem, sum(weight) AS weight FROM nodes WHERE owns_stem GROUP BY stem",
        placed_=f"""SELECT component, stem, row_number() OVER (PARTITION BY component ORDER BY weight DESC, stem) AS r
                    FROM lab{MERGE_ROUNDS} JOIN heavy ON stem = node""",
    ),
)
def _(t: Catalog):
    nodes, edges = _graph(t)
    return g.concept_clusters(edges, nodes)


@register(
    "concept_gaps",
    sql(
        """SELECT n.doc_id, round(avg(CASE WHEN coalesce(d, 0) > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage,
             coalesce(string_agg(CASE WHEN coalesce(d, 0) <= 1 THEN label END, '|' ORDER BY n.node), '') AS gaps
           FROM nodes n LEFT JOIN (SELECT doc_id, node, count(*) AS d FROM (SELECT doc_id, source AS node FROM edges UNION ALL SELECT doc_id, target FROM edges) GROUP BY ALL) x
           ON x.doc_id = n.doc_id AND x.node = n.node GROUP BY n.doc_id""",
        **GRAPH,
    ),
)
def _(t: Catalog):
    nodes, edges = _graph(t)
    return text_of(g.concept_gaps(nodes, edges).withColumn("coverage", F.round("coverage", 6)), "gaps")


@register("topic_order")
def _(t: Catalog):
    _, edges = _graph(t)
    return g.topic_order(x.key_topics(t.documents, 10), g.edge_relations(edges, t.documents))


@register("study_path")
def _(t: Catalog):
    return text_of(s.study_path(t.documents), "prerequisites")


# --- recommendation ---------------------------------------------------------

MATERIAL_DOCS = """
    SELECT m.doc_id, concat_ws(' ', NULLIF(m.title, ''), NULLIF(k.title, ''), NULLIF(array_to_string(m.tags, ' '), ''), NULLIF(m.text, '')) AS text
    FROM material_text m LEFT JOIN courses k ON k.code = m.course_code"""
UNIT = "SELECT doc_id, stem, weight / sqrt(sum(weight * weight) OVER (PARTITION BY doc_id)) AS u FROM tfidf"
REC = dict(
    docs=MATERIAL_DOCS,
    unit=UNIT,
    sims="SELECT a.doc_id AS id, b.doc_id AS other_id, sum(a.u * b.u) AS similarity, count(*) AS shared FROM unit a JOIN unit b ON a.stem = b.stem AND a.doc_id <> b.doc_id GROUP BY ALL",
    near_="SELECT * FROM sims WHERE similarity >= 0.3",
    top6="SELECT id, other_id, similarity, row_number() OVER (PARTITION BY id ORDER BY round(similarity, 9) DESC, other_id) AS rank FROM sims QUALIFY rank <= 6",
)


def _weights(t: Catalog):
    return x.tfidf(r.material_documents(t.material_text, t.courses))


@register(
    "similarity_join",
    sql("SELECT id AS a, other_id AS b, round(similarity, 6) AS similarity, shared AS shared_terms FROM near_ WHERE id < other_id", **REC),
)
def _(t: Catalog):
    pairs = r.similar_pairs(r.unit_vectors(cut_lineage(_weights(t))), 0.3)
    return pairs.withColumn("similarity", F.round("similarity", 6))


@register("similar_materials", sql("SELECT id, rank, other_id, round(similarity, 6) AS similarity FROM top6", **REC))
def _(t: Catalog):
    return r.similar_materials(_weights(t)).withColumn("similarity", F.round("similarity", 6))


@register(
    "similar_in_course",
    sql("""SELECT s.id, row_number() OVER (PARTITION BY s.id ORDER BY round(s.similarity, 9) DESC, s.other_id) AS rank, s.other_id, round(s.similarity, 6) AS similarity
           FROM sims s JOIN material_text a ON a.doc_id = s.id JOIN material_text b ON b.doc_id = s.other_id
           WHERE a.course_code IS NULL OR a.course_code = b.course_code QUALIFY rank <= 6""", **REC),
)
def _(t: Catalog):
    out = r.similar_in_course(_weights(t), t.material_text.select("doc_id", "course_code"))
    return out.withColumn("similarity", F.round("similarity", 6))


def _about(t: Catalog):
    return t.material_text.select(F.col("doc_id").alias("id"), "course_code", "type", "tags")


OVERLAP = """
    SELECT p.id, p.other_id, p.similarity, list_filter(list_distinct(list_transform(b.tags, lambda z: lower(z))), lambda z: list_contains(list_transform(a.tags, lambda y: lower(y)), z)) AS common,
      a.course_code AS c1, b.course_code AS c2, a.type AS t1, b.type AS t2
    FROM top6 p JOIN material_text a ON a.doc_id = p.id JOIN material_text b ON b.doc_id = p.other_id"""


@register(
    "concept_overlap",
    sql("SELECT id, other_id, array_to_string(list_sort(common), '|') AS overlap FROM ov_pairs", **REC, ov_pairs=OVERLAP),
)
def _(t: Catalog):
    recs = r.similar_materials(_weights(t)).select("id", "other_id")
    return text_of(r.concept_overlap(recs, _about(t)).withColumn("overlap", F.array_sort("overlap")), "overlap")


@register(
    "recommendation_reasons",
    sql(
        """SELECT id, other_id, concat_ws(' · ', CASE WHEN c1 = c2 THEN 'Same course' END,
             CASE WHEN len(common) > 0 THEN 'Shared concepts: ' || len(common) END,
             CASE WHEN round(similarity, 9) > 0.6 THEN 'Very similar content' WHEN round(similarity, 9) > 0.3 THEN 'Related content' ELSE 'Complementary reading' END,
             CASE WHEN t1 <> t2 THEN 'Different format (' || t2 || ')' END) AS reason FROM ov_pairs""",
        **REC,
        ov_pairs=OVERLAP,
    ),
)
def _(t: Catalog):
    """The number of shared concepts stands for their list, whose order is free."""
    recs = r.similar_materials(_weights(t)).select("id", "other_id", "similarity")
    out = r.recommendation_reasons(recs, _about(t))
    count = F.concat(F.lit("Shared concepts: "), F.size("overlap").cast("string"))
    listed = F.concat(F.lit("Shared concepts: "), F.array_join(F.slice("overlap", 1, 3), ", "))
    return out.select("id", "other_id", F.when(F.size("overlap") > 0, F.replace("reason", listed, count)).otherwise(F.col("reason")).alias("reason"))


@register(
    "novelty_ratio",
    sql("""SELECT n.id AS item, n.other_id AS other, round(1 - n.shared / z.size, 6) AS novelty FROM near_ n
           JOIN (SELECT doc_id, count(*) AS size FROM tf GROUP BY doc_id) z ON z.doc_id = n.other_id""", **REC),
)
def _(t: Catalog):
    weights = cut_lineage(_weights(t))
    pairs = r.mirrored(r.similar_pairs(r.unit_vectors(weights), 0.3))
    return r.novelty_ratio(pairs, weights).select("item", "other", F.round("novelty", 6).alias("novelty"))


@register(
    "next_read",
    sql("""SELECT id, other_id, round(gap, 6) AS gap_score FROM (SELECT n.id, n.other_id, n.similarity, round(n.similarity * 0.6 + (1 - n.shared / z.size) * 0.4, 9) AS gap FROM near_ n
           JOIN (SELECT doc_id, count(*) AS size FROM tf GROUP BY doc_id) z ON z.doc_id = n.other_id)
           QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap DESC, round(similarity, 9) DESC, other_id) = 1""", **REC),
)
def _(t: Catalog):
    return r.next_read(_weights(t)).select("id", "other_id", F.round("gap_score", 6).alias("gap_score"))


@register(
    "related_by_format",
    sql("""SELECT n.id, n.other_id, round(n.similarity, 6) AS similarity, row_number() OVER (PARTITION BY n.id ORDER BY round(n.similarity, 9) DESC, n.other_id) AS rank
           FROM sims n JOIN material_text m ON m.doc_id = n.other_id WHERE m.type IN ('PROMO', 'SMALL') QUALIFY rank <= 5""", **REC),
)
def _(t: Catalog):
    papers = t.material_text.withColumn("type", F.when(F.col("type").isin("PROMO", "SMALL"), "Past Paper").otherwise("Notes"))
    out = r.related_by_format(_weights(t), papers, papers=True)
    return out.withColumn("similarity", F.round("similarity", 6)).select("id", "other_id", "similarity", "rank")


@register("progression_plan")
def _(t: Catalog):
    return text_of(r.progression_plan(t.documents, x.key_topics(t.documents, 3)), "skills")


@register("search_queries")
def _(t: Catalog):
    docs = t.material_text.select("doc_id", "text")
    titles = t.courses.select(F.col("code").alias("course_code"), F.col("title").alias("course_title"))
    materials = t.material_text.select("doc_id", "title", "type", "course_code").join(titles, "course_code", "left")
    sums = ex.formulas(docs).select("doc_id", "position", F.struct("raw", "description").alias("f"))
    return r.search_queries(
        materials,
        x.ranked_list(x.key_topics(docs, 5), "topic", "topics"),
        x.ranked_list(x.keywords(docs, 10), "keyword", "words"),
        x.ranked_list(x.domains(docs), "domain", "domains"),
        x.ranked_list(sums, "f", "formulas", "position"),
    )


@register(
    "rerank_results",
    sql(f"""
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, position) AS rank, result_id, score FROM (
      SELECT q.query_id, r.result_id, r.position, len(q.w) AS nw, CAST(coalesce(list_sum(list_transform(q.w, lambda w: CASE WHEN contains(lower(r.title), w) THEN 1.0 WHEN contains(lower(r.channel), w) THEN 0.5 ELSE 0.0 END)), 0) AS DOUBLE) AS score
      FROM (SELECT id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(title || ' Lecture on the ' || type), '[^a-z0-9]+'),
              lambda w: length(w) > 2 AND w NOT IN {duck.word_list(r.RERANK_STOP_WORDS)} AND w NOT IN {duck.word_list(r.SCAFFOLD_WORDS)})) AS w FROM materials) q
      JOIN (SELECT course_code AS cc, id AS result_id, id AS position, title, type || ' ' || pages AS channel FROM materials WHERE course_code IS NOT NULL) r
      ON r.cc = (SELECT m.course_code FROM materials m WHERE m.id = q.query_id))
    WHERE nw = 0 OR score > 0 QUALIFY rank <= 6"""),
)
def _(t: Catalog):
    """Queries from titles; the results of a query are the materials of its course."""
    m = t.materials
    queries = m.select(
        F.col("id").alias("query_id"), F.concat("title", F.lit(" Lecture on the "), "type").alias("query"), "course_code"
    )
    results = queries.select("query_id", "course_code").join(
        m.select(
            "course_code", F.col("id").alias("result_id"), F.col("id").alias("position"), "title",
            F.concat("type", F.lit(" "), F.col("pages").cast("string")).alias("channel"),
        ),
        "course_code",
    ).drop("course_code")
    return r.rerank_results(queries.drop("course_code"), results)
