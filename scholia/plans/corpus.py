"""Queries over document text: tokens, counts, metrics, cleaning, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import lexicon
from scholia.functions import text as fx
from scholia.operators import text as x
from scholia.plans import duck
from scholia.plans.duck import q, sql
from scholia.plans.registry import register
from scholia.sources.tables import Catalog

# --- tokens, stems, counts --------------------------------------------------


@register("sentences", sql("SELECT doc_id, sent_idx, sentence FROM sents"))
def _(t: Catalog):
    return x.sentences(t.documents).withColumn("sent_idx", F.col("sent_idx").cast("long"))


@register("tokens", sql("SELECT doc_id, pos, token FROM toks"))
def _(t: Catalog):
    return x.tokens(t.documents).withColumn("pos", F.col("pos").cast("long"))


@register("content_tokens", sql("SELECT doc_id, pos, token FROM ctoks"))
def _(t: Catalog):
    return x.content_tokens(t.documents).withColumn("pos", F.col("pos").cast("long"))


@register("stem_vocabulary", sql("SELECT token, stem FROM stems"))
def _(t: Catalog):
    return x.stem_vocabulary(x.tokens(t.documents))


@register("term_frequency", sql("SELECT doc_id, stem, tf FROM tf"))
def _(t: Catalog):
    return x.term_frequency(t.documents)


@register("tfidf", sql("SELECT doc_id, stem, tf, round(weight, 6) AS weight FROM tfidf"))
def _(t: Catalog):
    return x.tfidf(t.documents).withColumn("weight", F.round("weight", 6))


def _grams(n: int) -> str:
    stop = duck.word_list(lexicon.stop_words())
    leads = ", ".join(f"lead(token, {i}) OVER w AS t{i}" for i in range(1, n))
    words = ["token"] + [f"t{i}" for i in range(1, n)]
    keep = " AND ".join([f"t{n - 1} IS NOT NULL"] + [f"{w} NOT IN {stop}" for w in words])
    return (
        f"SELECT doc_id, pos, {' || chr(32) || '.join(words)} AS gram FROM (SELECT doc_id, pos, token, {leads} "
        f"FROM toks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE {keep}"
    )


GRAMS = dict(grams2=_grams(2), grams3=_grams(3))


@register("bigrams", sql("SELECT doc_id, gram, count(*) AS n, min(pos) AS first_pos FROM grams2 GROUP BY ALL", **GRAMS))
def _(t: Catalog):
    return x.ngrams(t.documents, 2).withColumn("first_pos", F.col("first_pos").cast("long"))


@register("trigrams", sql("SELECT doc_id, gram, count(*) AS n, min(pos) AS first_pos FROM grams3 GROUP BY ALL", **GRAMS))
def _(t: Catalog):
    return x.ngrams(t.documents, 3).withColumn("first_pos", F.col("first_pos").cast("long"))


def keyword_ctes(n: int, name: str, corpus_idf: bool = False, src: str = "") -> dict[str, str]:
    """Keyword relation ``name`` over the text CTEs."""
    budget = -(-n // 2)
    score = (
        "round(f.tf * (ln(((SELECT count(*) FROM docs) + 1) / (d.df + 1)) + 1), 9)" if corpus_idf else "CAST(f.tf AS DOUBLE)"
    )
    join = "JOIN df d ON d.stem = f.stem" if corpus_idf else ""
    return {
        **GRAMS,
        f"{name}_phrases": f"""
          SELECT doc_id, gram AS keyword, CAST(n * size AS DOUBLE) AS score,
                 row_number() OVER (PARTITION BY doc_id ORDER BY n * size DESC, size, first) AS rank FROM (
            SELECT doc_id, gram, 2 AS size, count(*) AS n, min(pos) AS first FROM grams2 GROUP BY ALL
            UNION ALL SELECT doc_id, gram, 3, count(*), min(pos) FROM grams3 GROUP BY ALL) WHERE n >= 2
          QUALIFY rank <= {budget}""",
        f"{name}_used": f"""
          SELECT DISTINCT doc_id, {duck.stem('word')} AS stem FROM
            (SELECT doc_id, unnest(string_split(keyword, ' ')) AS word FROM {name}_phrases)""",
        name: f"""
          SELECT doc_id, keyword, score, rank FROM {name}_phrases
          UNION ALL
          SELECT * FROM (SELECT doc_id, form, score, r + coalesce(taken, 0) AS rank FROM (
            SELECT f.doc_id, f.form, {score} AS score, row_number() OVER (PARTITION BY f.doc_id ORDER BY {score} DESC, f.first) AS r
            FROM (SELECT doc_id, stem, count(*) AS tf, min(pos) AS first, arg_max(token, pos) AS form FROM cstems GROUP BY doc_id, stem) f {join}
            WHERE NOT EXISTS (SELECT 1 FROM {name}_used u WHERE u.doc_id = f.doc_id AND u.stem = f.stem))
            LEFT JOIN (SELECT doc_id, count(*) AS taken FROM {name}_phrases GROUP BY doc_id) USING (doc_id)) WHERE rank <= {n}""",
    }


@register(
    "keywords",
    sql("SELECT doc_id, rank, keyword, round(score, 6) AS score FROM kw", **keyword_ctes(10, "kw", True)),
)
def _(t: Catalog):
    return x.keywords(t.documents, 10, corpus_idf=True).select(
        "doc_id", F.col("rank").cast("long"), "keyword", F.round("score", 6).alias("score")
    )


@register("document_keywords", sql("SELECT doc_id, rank, keyword FROM kw", **keyword_ctes(30, "kw")))
def _(t: Catalog):
    return x.keywords(t.documents, 30).select("doc_id", F.col("rank").cast("long"), "keyword")


def topic_ctes(n: int, name: str) -> dict[str, str]:
    stop = duck.word_list(lexicon.stop_words())
    return {
        **keyword_ctes(2 * n, f"{name}_kw"),
        f"{name}_caps": f"""
          SELECT doc_id, phrase, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(pos)) AS rank FROM (
            SELECT doc_id, unnest(ms) AS phrase, generate_subscripts(ms, 1) AS pos FROM
              (SELECT doc_id, regexp_extract_all(text, {q(x.TOPIC_PHRASE)}) AS ms FROM docs))
          WHERE lower(phrase) NOT IN {stop} GROUP BY doc_id, phrase QUALIFY rank <= {n}""",
        name: f"""
          SELECT doc_id, list_reduce(list_transform(coalesce(k, []), lambda w: [w]), lambda acc, w: CASE WHEN len(acc) >= {n}
              OR len(list_filter(acc, lambda c: contains(lower(c), lower(w[1])))) > 0 THEN acc ELSE list_concat(acc, w) END, coalesce(c, [])) AS topics
          FROM (SELECT doc_id, list(phrase ORDER BY rank) AS c FROM {name}_caps GROUP BY doc_id)
          FULL OUTER JOIN (SELECT doc_id, list(keyword ORDER BY rank) AS k FROM {name}_kw GROUP BY doc_id) USING (doc_id)""",
    }


@register(
    "key_topics",
    sql(
        "SELECT doc_id, unnest(range(0, len(topics))) AS rank, unnest(topics) AS topic FROM topic5",
        **topic_ctes(5, "topic5"),
    ),
)
def _(t: Catalog):
    return x.key_topics(t.documents, 5).select("doc_id", F.col("rank").cast("long"), "topic")


TAGGED = f"""
    SELECT t.doc_id, t.pos, t.token, c.category FROM toks t
    JOIN (SELECT token, {duck.category('token')} AS category FROM (SELECT DISTINCT token FROM toks)) c USING (token)"""


@register(
    "token_categories",
    sql("SELECT doc_id, category, count(*) AS n FROM tagged GROUP BY ALL", tagged=TAGGED),
)
def _(t: Catalog):
    return x.token_categories(t.documents)


@register(
    "tagged_tokens",
    sql(f"""SELECT doc_id, pos, token AS word, stem, category, false AS capitalised, token IN {duck.word_list(lexicon.SIGNAL_WORDS)} AS academic
            FROM tagged JOIN stems USING (token)""", tagged=TAGGED),
)
def _(t: Catalog):
    return x.tagged_tokens(t.documents).withColumn("pos", F.col("pos").cast("long"))


CHUNKS = """
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS nth, string_agg(token, ' ' ORDER BY pos) AS phrase, count(*) AS size
    FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM tagged WHERE category IN ('noun', 'adjective'))
    GROUP BY doc_id, g HAVING count(*) BETWEEN {lo} AND {hi}"""


@register(
    "phrase_chunks",
    sql("SELECT doc_id, nth - 1 AS pos, phrase FROM chunks", tagged=TAGGED, chunks=CHUNKS.format(lo=2, hi=5)),
)
def _(t: Catalog):
    return x.phrase_chunks(t.documents).withColumn("pos", F.col("pos").cast("long"))


COOCCUR = """
    SELECT a.doc_id, a.stem, b.stem AS near_stem, count(*) AS n FROM cstems a JOIN cstems b
    ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos - {w} AND a.pos + {w} AND a.pos <> b.pos GROUP BY a.doc_id, a.stem, b.stem"""


@register("cooccurrence", sql("SELECT doc_id, stem, near_stem, n FROM co", co=COOCCUR.format(w=5)))
def _(t: Catalog):
    return x.cooccurrence(t.documents, 5)


# --- metrics ----------------------------------------------------------------

EASE = "CASE " + " ".join(f"WHEN ease >= {b} THEN {q(s)}" for b, s in x.EASE_BANDS) + f" ELSE {q(x.HARDEST)} END"
READ = f"""
    SELECT doc_id, words, sentences, syllables, CASE WHEN len10 THEN 0.0 ELSE greatest(grade, 0.0) END AS grade,
      CASE WHEN len10 THEN 0 ELSE greatest(CAST(floor(grade + 0.5) AS BIGINT), 0) END AS grade_level,
      CASE WHEN len10 THEN 'N/A' ELSE {EASE} END AS reading_ease,
      CASE WHEN len10 THEN 0.0 ELSE words / sentences END AS avg_sentence_length,
      CASE WHEN len10 THEN 0.0 ELSE hard / greatest(words, 1) END AS complex_ratio
    FROM (SELECT *, round(206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / greatest(words, 1)), 9) AS ease,
            round(0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / greatest(words, 1)) - 15.59::DOUBLE, 9) AS grade
          FROM (SELECT d.doc_id, length({duck.strip('d.text')}) < 10 AS len10, coalesce(w.n, 0) AS words, greatest(coalesce(s.n, 0), 1) AS sentences,
                  coalesce(w.syl, 0) AS syllables, coalesce(w.hard, 0) AS hard
                FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n, CAST(sum(c) AS BIGINT) AS syl, count(*) FILTER (WHERE c >= 3) AS hard FROM
                    (SELECT doc_id, {duck.syllables('w')} AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM docs) WHERE w <> '')
                    GROUP BY doc_id) w USING (doc_id)
                LEFT JOIN (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) s USING (doc_id)))"""


@register(
    "readability",
    sql(
        """SELECT doc_id, words, sentences, syllables, round(grade, 6) AS grade, grade_level, reading_ease,
             round(avg_sentence_length, 6) AS avg_sentence_length, round(complex_ratio, 6) AS complex_ratio FROM readab""",
        readab=READ,
    ),
)
def _(t: Catalog):
    out = x.readability(t.documents)
    return out.withColumns({c: F.round(c, 6) for c in ("grade", "avg_sentence_length", "complex_ratio")})


DOMAINS = (
    "SELECT doc_id, domain, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, turn) - 1 AS rank FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, {q(name)} AS domain, {duck.hits('low', words.split())}::BIGINT AS score, {i} AS turn FROM lows"
        for i, (name, words) in enumerate(lexicon.DOMAIN_KEYWORDS.items())
    )
    + ") WHERE score > 0"
)
LOWS = "SELECT doc_id, lower(text) AS low FROM docs"


@register("domains", sql("SELECT doc_id, rank, domain, score FROM doms", lows=LOWS, doms=DOMAINS))
def _(t: Catalog):
    return x.domains(t.documents).withColumn("rank", F.col("rank").cast("long"))


DIFFICULTY = f"""
    SELECT doc_id, CASE WHEN score >= 70 THEN 'expert' WHEN score >= 45 THEN 'advanced' WHEN score >= 25 THEN 'intermediate' ELSE 'beginner' END AS level,
      CAST(score AS BIGINT) AS score, array_to_string(factors, '|') AS factors FROM (
      SELECT doc_id, list_sum(list_transform(f, lambda z: z.p)) AS score, list_transform(f, lambda z: z.n) AS factors FROM (
        SELECT doc_id, list_filter(CASE WHEN short THEN [] ELSE [
          CASE WHEN grade > 12 THEN {{p: 25, n: 'high grade-level readability'}} WHEN grade > 9 THEN {{p: 15, n: 'moderate readability'}}
               WHEN grade > 6 THEN {{p: 5, n: 'accessible readability'}} END,
          CASE WHEN list_has_any(ds, ['mathematics', 'physics']) THEN {{p: 20, n: 'technical domain (math/physics)'}}
               WHEN len(ds) > 0 THEN {{p: 10, n: 'domain: ' || ds[1]}} END,
          CASE WHEN hard / greatest(w, 1) > 0.25 THEN {{p: 20, n: 'high proportion of complex vocabulary'}}
               WHEN hard / greatest(w, 1) > 0.15 THEN {{p: 10, n: 'moderate complex vocabulary'}} END,
          CASE WHEN ns > 0 AND w / ns > 25 THEN {{p: 15, n: 'long, complex sentences'}} WHEN ns > 0 AND w / ns > 18 THEN {{p: 8, n: 'moderate sentence length'}} END,
          CASE WHEN ns > 0 AND u / ns > 15 THEN {{p: 15, n: 'high concept density'}} WHEN ns > 0 AND u / ns > 10 THEN {{p: 7, n: 'moderate concept density'}} END,
          CASE WHEN regexp_matches(text, '[∑∫∏∂∇√∞±≈≠≤≥]') OR regexp_matches(text, '\\$[^$]+\\$') THEN {{p: 10, n: 'contains mathematical formulas'}} END
        ] END, lambda z: z IS NOT NULL) AS f FROM (
          SELECT d.doc_id, d.text, length({duck.strip('d.text')}) < 50 AS short, r.grade, coalesce(ds, []) AS ds, coalesce(c.w, 0) AS w, coalesce(c.u, 0) AS u,
            coalesce(c.hard, 0) AS hard, coalesce(s.ns, 0) AS ns
          FROM docs d JOIN readab r USING (doc_id) LEFT JOIN (SELECT doc_id, list(domain ORDER BY rank) AS ds FROM doms GROUP BY doc_id) USING (doc_id)
          LEFT JOIN (SELECT doc_id, count(*) AS w, count(DISTINCT token) AS u, count(*) FILTER (WHERE {duck.syllables('token')} >= 3) AS hard FROM ctoks GROUP BY doc_id) c USING (doc_id)
          LEFT JOIN (SELECT doc_id, count(*) AS ns FROM sents GROUP BY doc_id) s USING (doc_id))))"""
METRICS = dict(readab=READ, lows=LOWS, doms=DOMAINS, diffs=DIFFICULTY)


@register(
    "difficulty",
    sql("SELECT doc_id, level, coalesce(score, 0) AS score, coalesce(factors, '') AS factors FROM diffs", **METRICS),
)
def _(t: Catalog):
    return x.difficulty(t.documents).withColumn("factors", F.array_join("factors", "|"))


PROFILES = " UNION ALL ".join(
    f"SELECT d.doc_id, {q(name)} AS language, {i} AS turn, (SELECT count(*) FROM toks k WHERE k.doc_id = d.doc_id AND k.token IN {duck.word_list(words.split())}) AS score, least(coalesce(n, 0), 200) AS size "
    "FROM docs d LEFT JOIN sizes USING (doc_id)"
    for i, (name, words) in enumerate(lexicon.LANGUAGE_WORDS.items())
)
LANG = f"""
    SELECT d.doc_id, CASE WHEN known THEN s[1].l ELSE 'Unknown' END AS language, CASE WHEN known THEN least(1.0, s[1].r * 5) ELSE 0.0 END AS confidence,
      known AND s[2].c > s[1].c * 0.3 AND s[2].c > 5 AS is_multilingual,
      CASE WHEN known THEN array_to_string(list_transform(list_filter(s, lambda z: z.c > 2)[1:3], lambda z: z.l), ',') ELSE '' END AS detected
    FROM (SELECT doc_id, length({duck.strip('text')}) >= 20 AND coalesce(n, 0) > 0 AS known FROM docs LEFT JOIN sizes USING (doc_id)) d
    JOIN (SELECT doc_id, list({{c: score, l: language, r: score / size}} ORDER BY score DESC, turn) AS s FROM (
      SELECT * FROM profs
      UNION ALL SELECT doc_id, 'Chinese/Japanese/Korean', -1, n, length(text) FROM (SELECT *, len(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{309f}}\\x{{30a0}}-\\x{{30ff}}]')) AS n FROM docs) WHERE n > length(text) * 0.1
      UNION ALL SELECT doc_id, 'Arabic', -2, n, length(text) FROM (SELECT *, len(regexp_extract_all(text, '[\\x{{0600}}-\\x{{06ff}}]')) AS n FROM docs) WHERE n > length(text) * 0.1)
      GROUP BY doc_id) USING (doc_id)"""
LANGS = dict(sizes="SELECT doc_id, count(*) AS n FROM toks GROUP BY doc_id", profs=PROFILES, langs=LANG)


@register(
    "language_id",
    sql("SELECT doc_id, language, round(confidence, 6) AS confidence, is_multilingual, detected FROM langs", **LANGS),
)
def _(t: Catalog):
    return x.language_id(t.documents).withColumns(
        {"confidence": F.round("confidence", 6), "detected": F.array_join("detected", ",")}
    )


@register(
    "tone",
    sql(
        f"""SELECT doc_id, CASE WHEN short OR (academic > positive AND academic > negative) THEN 'academic'
              WHEN positive > negative AND positive > 2 THEN 'positive' WHEN negative > positive AND negative > 2 THEN 'negative' ELSE 'neutral' END AS tone,
              positive, negative, academic
            FROM (SELECT doc_id, length({duck.strip('text')}) < 50 AS short, {duck.hits('lower(text)', lexicon.POSITIVE_WORDS)}::BIGINT AS positive,
              {duck.hits('lower(text)', lexicon.NEGATIVE_WORDS)}::BIGINT AS negative, {duck.hits('lower(text)', lexicon.ACADEMIC_WORDS)}::BIGINT AS academic FROM docs)"""
    ),
)
def _(t: Catalog):
    return x.tone(t.documents)


@register(
    "complexity",
    sql(
        f"""SELECT d.doc_id, round(CASE WHEN length({duck.strip('text')}) < 50 OR coalesce(ns, 0) = 0 OR coalesce(w, 0) = 0 THEN 0.0
              ELSE least(1.0, w / ns / 30) * 0.4 + least(1.0, u / w * 2) * 0.6 END, 6) AS complexity
            FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS w, count(DISTINCT token) AS u FROM ctoks GROUP BY doc_id) USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS ns FROM sents GROUP BY doc_id) USING (doc_id)"""
    ),
)
def _(t: Catalog):
    return x.complexity(t.documents).withColumn("complexity", F.round("complexity", 6))


@register(
    "coherence",
    sql("""
    SELECT d.doc_id, round(CASE WHEN coalesce(n, 0) < 2 THEN 1.0 ELSE coalesce(s, 0) / (n - 1) END, 6) AS coherence FROM docs d
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) USING (doc_id)
    LEFT JOIN (SELECT doc_id, sum(common / size) AS s FROM (
      SELECT a.doc_id, a.sent_idx, count(*) AS size, count(b.stem) AS common FROM stf a
      LEFT JOIN stf b ON b.doc_id = a.doc_id AND b.sent_idx = a.sent_idx - 1 AND b.stem = a.stem
      WHERE a.sent_idx >= 1 GROUP BY a.doc_id, a.sent_idx) GROUP BY doc_id) USING (doc_id)"""),
)
def _(t: Catalog):
    return x.coherence(t.documents).withColumn("coherence", F.round("coherence", 6))


@register(
    "topic_clusters",
    sql(
        """SELECT c.doc_id, c.rank, c.label, c.n AS n_sentences, round(c.n / z.n, 6) AS weight, k.keywords, p.sentences
           FROM clus c JOIN (SELECT a.doc_id, a.label, string_agg(s.sentence, '|' ORDER BY s.sent_idx) AS sentences
             FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY sent_idx) AS r FROM assigned) a
             JOIN sents s ON s.doc_id = a.doc_id AND s.sent_idx = a.sent_idx WHERE r <= 5 GROUP BY a.doc_id, a.label) p
           ON p.doc_id = c.doc_id AND p.label = c.label JOIN (SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) z ON z.doc_id = c.doc_id
           JOIN (SELECT doc_id, label, string_agg(stem, ',' ORDER BY a, b) AS keywords FROM (
             SELECT s.doc_id, s.label, t.stem, min(t.sent_idx) AS a, arg_min(t.first, t.sent_idx) AS b FROM assigned s JOIN sfirst t USING (doc_id, sent_idx)
             GROUP BY s.doc_id, s.label, t.stem QUALIFY row_number() OVER (PARTITION BY s.doc_id, s.label ORDER BY a, b) <= 10) GROUP BY doc_id, label) k
           ON k.doc_id = c.doc_id AND k.label = c.label""",
        sfirst="SELECT doc_id, sent_idx, stem, count(*) AS tf, min(pos) AS first FROM sstems GROUP BY ALL",
        top20="""SELECT doc_id, stem, row_number() OVER (PARTITION BY doc_id ORDER BY sum(tf) DESC, min(sent_idx), arg_min(first, sent_idx)) AS top
                 FROM sfirst GROUP BY doc_id, stem QUALIFY top <= 20""",
        assigned="""SELECT doc_id, sent_idx, stem AS label FROM sfirst JOIN top20 USING (doc_id, stem)
                    QUALIFY row_number() OVER (PARTITION BY doc_id, sent_idx ORDER BY tf DESC, top) = 1""",
        clus="""SELECT doc_id, label, count(*) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, min(sent_idx)) AS rank FROM assigned
                WHERE doc_id IN (SELECT doc_id FROM sents GROUP BY doc_id HAVING count(*) >= 3) GROUP BY doc_id, label QUALIFY rank <= 8""",
    ),
)
def _(t: Catalog):
    return x.topic_clusters(t.documents).withColumns(
        {
            "weight": F.round("weight", 6),
            "keywords": F.array_join("keywords", ","),
            "sentences": F.array_join("sentences", "|"),
        }
    )


def _cued(cues: list[str], longer: int) -> str:
    pattern = "(?i)" + "|".join(f"(?:{c})" for c in cues)
    return sql(f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS rank, sentence FROM sents
      JOIN (SELECT doc_id FROM docs WHERE length({duck.strip('text')}) >= 50) USING (doc_id)
      WHERE regexp_matches(sentence, {q(pattern)}) AND length(sentence) > {longer} AND length(sentence) < 300""")


@register("argument_sentences", _cued(x.ARGUMENT_CUES, 30))
def _(t: Catalog):
    return x.argument_sentences(t.documents).withColumn("rank", F.col("rank").cast("long"))


@register("evidence_sentences", _cued(x.EVIDENCE_CUES, 25))
def _(t: Catalog):
    return x.evidence_sentences(t.documents).withColumn("rank", F.col("rank").cast("long"))


# --- scanned text, chunks, types --------------------------------------------

m = lambda p, f="": f"regexp_matches(text, {q((f'(?{f})' if f else '') + p)})::INT"
SIGNALS = " + ".join(
    [
        m("\\x{FFFD}"), "(contains(text, '|') AND NOT contains(text, '||'))::INT", m(r"\b\w{1,2}\s\w{1,2}\s\w{1,2}\b"),
        m(r"^\s*\d{1,4}\s*$", "m"), m(r"\w-\n\w"), m(r"\bth e\b", "i"), m("[~@]{2,}"), m("[\\x{200B}-\\x{200F}]"),
        "(len(list_filter(p, lambda w: regexp_matches(w, '^[a-zA-Z]{3,}$'))) / greatest(len(p), 1) < 0.4)::INT",
    ]
)


@register(
    "ocr_signals",
    sql(f"""
    SELECT doc_id, signals, signals >= 2 AS likely_ocr, CASE WHEN length({duck.strip('text')}) < 10 THEN 0.0 ELSE round(greatest(0.0, least(1.0,
        0.5::DOUBLE + (sn > 3)::INT * 0.1::DOUBLE + (sn > 10)::INT * 0.1::DOUBLE + (mean BETWEEN 4 AND 8)::INT * 0.1::DOUBLE - {m('x{FFFD}')} * 0.0 - {m(chr(92) + 'x{FFFD}')} * 0.15::DOUBLE
        - {m(chr(92) + 'b' + chr(92) + 'w' + chr(92) + 's' + chr(92) + 'w' + chr(92) + 's' + chr(92) + 'w' + chr(92) + 'b')} * 0.1::DOUBLE
        - {m('^' + chr(92) + 's*' + chr(92) + 'd+' + chr(92) + 's*$', 'm')} * 0.05::DOUBLE
        - (rr < 0.5)::INT * 0.15::DOUBLE + (rr > 0.7)::INT * 0.1::DOUBLE)), 6) END AS confidence
    FROM (SELECT doc_id, text, CAST({SIGNALS} AS BIGINT) AS signals,
      len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length({duck.strip('s')}) > 15)) AS sn,
      coalesce(list_sum(list_transform(w, lambda z: length(z))), 0) / greatest(len(w), 1) AS mean,
      len(list_filter(w, lambda z: regexp_matches(z, '^[a-zA-Z'']{{2,}}$'))) / greatest(len(w), 1) AS rr
    FROM (SELECT *, list_filter(p, lambda z: z <> '') AS w FROM (SELECT doc_id, text, regexp_split_to_array(text, '\\s+') AS p FROM docs)))"""),
)
def _(t: Catalog):
    return x.ocr_signals(t.documents)


def _re(t: str, pattern: str, repl: str, flags: str = "") -> str:
    return f"regexp_replace({t}, {q((f'(?{flags})' if flags else '') + pattern)}, {q(repl)}, 'g')"


DEDUPE = """
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM (
      SELECT doc_id, i, line, {strip_line} AS t, lag({strip_line}) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (
        SELECT doc_id, unnest(string_split({col}, chr(10))) AS line, unnest(range(0, len(string_split({col}, chr(10))))) AS i FROM {src}))
    WHERE NOT coalesce(t = p AND length(t) > 10, false) GROUP BY doc_id"""


@register(
    "dedupe_adjacent_lines",
    sql(DEDUPE.format(strip_line=duck.strip("line"), col="text", src="docs")),
)
def _(t: Catalog):
    return x.dedupe_adjacent_lines(t.documents)


def _clean_sql(merge: bool) -> str:
    a = "text"
    for p, r in [
        ("[\\x{FFFD}\\x{00BF}]", ""), ("\\x{2018}|\\x{2019}", "'"), ("\\x{201C}|\\x{201D}", '"'), ("\\x{2013}|\\x{2014}", "-"),
        ("\\x{2026}", "..."), ("\\x{00A0}", " "), ("\\x{2022}|\\x{25CF}|\\x{25AA}|\\x{25AB}", "• "), ("[\\x{200B}-\\x{200F}\\x{FEFF}]", ""),
    ]:
        a = _re(a, p, r)
    confusions = [
        (r"\brn(ing|ed|s\b)", r"m\1", ""), (r"\b([a-z]*)0([a-z]*)\b", r"\1o\2", ""), (r"\|", "l", ""), (r"\s~\s", " - ", ""),
        (r"\b@(\w)", r"a\1", ""), (r"(\w)['_](t|s|re|ve|ll|m|d)\b", r"\1'\2", "i"), (r"(^|[^\d])\s=\s", r"\1 - ", ""),
    ]
    cases = " ".join(f"WHEN {_re('a', p, r, f)} <> a THEN {_re('a', p, r, f)}" for p, r, f in confusions)
    artefacts = "c4"
    for p, f in x.ARTEFACT_LINES:
        artefacts = _re(artefacts, p, "", f)
    space = "text"
    for p, r in [(r"\r\n", "\n"), (r"\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]:
        space = _re(space, p, r)
    punct = "c7"
    for p, r in x.SPACING:
        punct = _re(punct, p, r.replace("$", "\\"))
    words = "c8"
    for w in x.SPLIT_WORDS:
        words = _re(words, rf"\b{w}\b", w.replace(" ", ""), "i")
    for w in x.JOINED_WITH_THE:
        words = _re(words, rf"\b{w}the\b", f"{w} the", "i")
    c4 = _re("c3", r"(\w)\s{1,2}(\w)\b", r"\1\2") if merge else "c3"
    hyphen = _re("c2", r"(\w)-\s*\n\s*(\w)", r"\1\2")
    quality = "CASE WHEN len(list_filter(regexp_split_to_array(c9, '\\s+'), lambda w: length(w) > 3)) > 10 THEN least(1.0, length(c9) / greatest(length(c0), 1) * 0.8 + 0.2) ELSE 0.3 END"
    names = ["encoding artifacts", "OCR character confusion", "hyphenated line breaks", "broken word merging", "artifact removal",
             "duplicate line removal", "whitespace normalization", "sentence boundary reconstruction", "word substitution"]
    tests = ["length(c0) <> length(c1)"] + [f"c{i} <> c{i + 1}" for i in range(1, 9)]
    fixes = ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for t, n in zip(tests, names))
    return sql(
        f"""SELECT doc_id, md5(c9) AS cleaned, array_to_string(list_filter([{fixes}], lambda z: z IS NOT NULL), ',') AS fixes,
              length(c0) AS original_length, length(c9) AS cleaned_length, round({quality}, 6) AS quality, {quality} > 0.3 AS accepted
            FROM (SELECT *, {words} AS c9 FROM (SELECT *, {punct} AS c8 FROM s7))""",
        s2=f"SELECT doc_id, c0, a AS c1, CASE {cases} ELSE a END AS c2 FROM (SELECT doc_id, text AS c0, {a} AS a FROM docs)",
        s5=f"SELECT *, {artefacts} AS c5 FROM (SELECT *, {c4} AS c4 FROM (SELECT *, {hyphen} AS c3 FROM s2))",
        s6=DEDUPE.format(strip_line=duck.strip("line"), col="c5", src="s5"),
        s7=f"SELECT s5.*, s6.text AS c6, {duck.strip(space)} AS c7 FROM s5 JOIN s6 USING (doc_id)",
    )


@register("clean_ocr", _clean_sql(False))
def _(t: Catalog):
    return x.clean_ocr(t.documents, merge_single_letters=False).withColumns({"cleaned": F.md5("cleaned"), "fixes": F.array_join("fixes", ",")})


@register("clean_ocr_merged", _clean_sql(True))
def _(t: Catalog):
    return x.clean_ocr(t.documents).withColumns(
        {"cleaned": F.md5("cleaned"), "fixes": F.array_join("fixes", ",")}
    )


SANITISED = duck.strip(
    _re(_re(_re(_re(_re("text", "[\\x00]", ""), "[\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]", " "), "\\r\\n?", "\n"), "[ \\t]+", " "), "\\n{3,}", "\n\n")
)


@register("sanitise_text", sql(f"SELECT doc_id, md5({SANITISED}) AS text FROM docs"))
def _(t: Catalog):
    return x.sanitise_text(t.documents.select("doc_id", "text")).withColumn("text", F.md5("text"))


@register(
    "extraction_quality",
    sql(f"""
    SELECT doc_id, quality, floor(c * 100 + 0.5) / 100 AS confidence,
      CASE WHEN missing > 0 THEN missing || ' of ' || total || ' page' || CASE WHEN total = 1 THEN '' ELSE 's' END || ' couldn''t be read and may be missing from this document''s study tools.'
           WHEN ocr > 0 AND c < 0.6 THEN 'This looks like a scan or photo — some words may have been misread.'
           WHEN quality = 'partial' THEN 'Only a small amount of readable text was found in this document.'
           WHEN quality = 'none' THEN 'We couldn''t find readable text in this document.' END AS note
    FROM (SELECT *, greatest(0.02::DOUBLE, least(0.98::DOUBLE, CASE quality WHEN 'good' THEN 0.92::DOUBLE WHEN 'partial' THEN 0.55::DOUBLE ELSE 0.15::DOUBLE END
        - CASE WHEN ocr > 0 THEN least(1.0::DOUBLE, ocr / total) * 0.2::DOUBLE ELSE 0 END - CASE WHEN missing > 0 THEN least(1.0::DOUBLE, missing / total) * 0.4::DOUBLE ELSE 0 END)) AS c
      FROM (SELECT doc_id, CASE WHEN length({duck.strip('text')}) >= 200 THEN 'good' WHEN length({duck.strip('text')}) >= 20 THEN 'partial' ELSE 'none' END AS quality,
        n_chars // 1000 + 1 AS total, CASE WHEN doc_id % 3 = 0 THEN n_chars // 2000 ELSE 0 END AS ocr, CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS missing FROM documents))"""),
)
def _(t: Catalog):
    pages = t.documents.select(
        "doc_id",
        (F.floor(F.col("n_chars") / 1000) + 1).alias("total_pages"),
        F.when(F.col("doc_id") % 3 == 0, F.floor(F.col("n_chars") / 2000)).otherwise(0).alias("ocr_pages"),
        F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0).alias("uncovered_pages"),
    )
    return x.extraction_quality(t.documents, pages)


@register(
    "fixed_chunks",
    sql("""SELECT doc_id, k AS chunk, CAST(greatest(1, least(100, floor(least(length(text), n * 1500) / length(text) * 100 + 0.5))) AS BIGINT) AS coverage_pct,
             md5(substr(text, k * 1400 + 1, 1500)) AS body
           FROM (SELECT doc_id, text, n, unnest(range(0, n)) AS k FROM
             (SELECT doc_id, text, CAST(greatest(ceil((length(text) - 100) / 1400), 1) AS BIGINT) AS n FROM docs WHERE length(text) > 0))"""),
)
def _(t: Catalog):
    return x.fixed_chunks(t.documents, 1500, 100).withColumns(
        {"chunk": F.col("chunk").cast("long"), "body": F.md5("body")}
    )


@register(
    "sentence_chunks",
    sql(f"""
    SELECT doc_id, unnest(range(0, len(cs))) AS chunk, md5(unnest(cs)) AS body FROM (
      SELECT doc_id, CASE WHEN length(text) <= 1000 THEN [text]
        WHEN {duck.strip('r.o')} <> '' THEN list_append(r.d, {duck.strip('r.o')}) ELSE r.d END AS cs FROM (
        SELECT doc_id, text, list_reduce(list_transform(CASE WHEN len(ps) > 0 THEN ps ELSE [text] END, lambda s: {{d: []::VARCHAR[], o: s}}),
          lambda acc, s: CASE WHEN length(acc.o) + length(s.o) > 1000
            THEN {{d: CASE WHEN acc.o <> '' THEN list_append(acc.d, {duck.strip('acc.o')}) ELSE acc.d END, o: s.o}}
            ELSE {{d: acc.d, o: acc.o || s.o}} END, {{d: []::VARCHAR[], o: ''}}) AS r
        FROM (SELECT doc_id, text, regexp_extract_all(text, '[^.!?]+[.!?]+') AS ps FROM docs)))"""),
)
def _(t: Catalog):
    return x.sentence_chunks(t.documents, 1000).select(
        "doc_id", F.col("chunk").cast("long"), F.md5("body").alias("body")
    )


def _type_sql(name: str, text: str) -> str:
    out = f"CASE WHEN regexp_matches(lower({name}), '\\.pptx?$') THEN 'Slides'"
    for label, patterns in x.TYPE_PATTERNS:
        p = q("(?i)" + "|".join(patterns))
        out += f" WHEN regexp_matches({name}, {p}) OR regexp_matches({text}, {p}) THEN {q(label)}"
    return out + " ELSE 'Notes' END"


@register(
    "guess_material_type",
    sql(f"""SELECT doc_id, {_type_sql('filename', 'text')} AS type FROM
            (SELECT doc_id, text, ['exam-', 'slides ', 'lab_report ', 'outline.', 'summary-', 'x.pptx', 'notes '][doc_id % 7 + 1] || source || CASE WHEN doc_id % 7 = 5 THEN '.PPT' ELSE '' END AS filename FROM documents)"""),
)
def _(t: Catalog):
    kinds = F.array(*[F.lit(k) for k in ["exam-", "slides ", "lab_report ", "outline.", "summary-", "x.pptx", "notes "]])
    turn = (F.col("doc_id") % 7).cast("int")
    name = F.concat(F.get(kinds, turn), F.col("source"), F.when(turn == 5, ".PPT").otherwise(""))
    return x.guess_material_type(t.documents.withColumn("filename", name))


@register(
    "outdated",
    sql(f"""SELECT id, coalesce(a >= 6, false) AS is_outdated, CAST(a AS BIGINT) AS years_old,
              CASE WHEN a >= 10 THEN 'critical' WHEN a >= 6 THEN 'warning' ELSE 'none' END AS severity,
              CASE WHEN a >= 6 THEN '⚠️ This document is from ' || content_year || ' (' || a || ' years old). Some information may be outdated. ' ||
                CASE WHEN a >= 10 THEN {q(x.AGE_NOTES[0][1])} WHEN a >= 8 THEN {q(x.AGE_NOTES[1][1])} ELSE {q(x.AGE_NOTES[2][1])} END ||
                ' Consider looking for a more recent version (2024 or later) or supplementing this with current course materials.' END AS comment
            FROM (SELECT id, content_year, 2026 - content_year AS a FROM materials)"""),
)
def _(t: Catalog):
    return x.outdated(t.materials, 2026)
