"""SQL of the checking engine: catalogue views and text expressions."""

from __future__ import annotations

import re

from scholia.functions import lexicon
from scholia.functions import text as tx
from scholia.sources.tables import VIEWS


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def word_list(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


def _view_sql(name: str) -> str:
    sql = VIEWS[name].replace("SPLIT(", "string_split(").replace("JSONK(", "json_extract_string(")
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def tok(col: str) -> str:
    cleaned = f"regexp_replace(lower({col}), '[^a-z0-9\\s''\\-]', ' ', 'g')"
    return f"list_filter(regexp_split_to_array({cleaned}, '\\s+'), lambda w: length(w) > 1)"


def content(col: str) -> str:
    stop = word_list(lexicon.stop_words())
    return f"list_filter({tok(col)}, lambda w: length(w) > 2 AND w NOT IN {stop})"


def stem(col: str) -> str:
    out = f"lower({col})"
    for pattern, replacement in tx.STEM_STAGES:
        out = f"regexp_replace({out}, {q(pattern)}, {q(replacement)})"
    # double final letter: the oracle compares the last two characters
    doubles = "|".join(f"{c}{c}" for c in "abcdeghijkmnopqrtuvwxy0123456789'-")
    out = f"regexp_replace({out}, {q('^(.{2,})(?:' + doubles + ')$')}, '\\0@')"
    out = f"regexp_replace({out}, '.@$', '')"
    return f"(CASE WHEN length({col}) <= 3 THEN lower({col}) ELSE {out} END)"


def strip(col: str) -> str:
    return f"regexp_replace({col}, '^\\s+|\\s+$', '', 'g')"


def sentences(col: str) -> str:
    t = col
    for dotted, short in tx.DOTTED_ABBREVIATIONS.items():
        pattern = r"\b" + dotted.replace(".", r"\.")
        t = f"regexp_replace({t}, {q(pattern)}, '{short}<DOT>', 'g')"
    t = f"regexp_replace({t}, '\\b({'|'.join(tx.ABBREVIATIONS)})\\.', '\\1<DOT>', 'g')"
    t = f"regexp_replace({t}, '\\b(\\d+)\\.(\\d+)', '\\1<DOT>\\2', 'g')"
    t = f"regexp_replace({t}, '(\\d)\\.(\\d)', '\\1<DOT>\\2', 'g')"
    t = replace_inside(t, r"\$[^$]+\$", "replace(m, '.', '<DOT>')")
    t = f"regexp_replace({t}, '([.!?])\\s+([A-Z\"''(\\[])', '\\1<SPLIT>\\2', 'g')"
    t = f"regexp_replace({t}, '(?m)([.!?])\\s*$', '\\1<SPLIT>', 'g')"
    part = strip("replace(s, '<DOT>', '.')")
    return f"list_filter(list_transform(string_split({t}, '<SPLIT>'), lambda s: {part}), lambda s: length(s) > 15)"


def replace_inside(t: str, pattern: str, fix: str) -> str:
    """Interleave the text between matches with the changed matches."""
    return (
        "(SELECT array_to_string(list_transform(range(1, len(parts) + 1), lambda i: "
        "parts[i] || coalesce(list_transform(ms, lambda m: " + fix + ")[i], '')), '') "
        f"FROM (SELECT string_split_regex(src, {q(pattern)}) AS parts, "
        f"regexp_extract_all(src, {q(pattern)}) AS ms FROM (SELECT {t} AS src)))"
    )


def syllables(w: str) -> str:
    core = f"regexp_replace(lower({w}), '(?:[^laeiouy]es|ed|[^laeiouy]e)$', '')"
    core = f"regexp_replace({core}, '^y', '')"
    return (
        f"(CASE WHEN length({w}) <= 3 THEN 1 ELSE "
        f"greatest(len(regexp_extract_all({core}, '[aeiouy]{{1,2}}')), 1) END)"
    )


def hits(lowered: str, words) -> str:
    return "(" + " + ".join(f"contains({lowered}, {q(w)})::INT" for w in words) + ")"


def category(w: str) -> str:
    parts = [f"WHEN {w} IN {word_list(ws)} THEN '{n}'" for n, ws in lexicon.tagging_rules()]
    parts += [
        f"WHEN regexp_matches({w}, '(?:{'|'.join(s)})$') THEN '{n}'" for n, s in lexicon.SUFFIX_GUESSES
    ]
    return "(CASE " + " ".join(parts) + " ELSE 'noun' END)"


# Text relations over {src}(doc_id, text); filled in on demand.
TEXT_CTES: dict[str, str] = {
    "docs": "SELECT doc_id, text FROM documents",
    "sents": f"""
        SELECT doc_id, i - 1 AS sent_idx, list_extract(ss, i) AS sentence FROM (
          SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i
          FROM (SELECT doc_id, {sentences('text')} AS ss FROM docs))""",
    "toks": f"""
        SELECT doc_id, i - 1 AS pos, list_extract(ts, i) AS token FROM (
          SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i
          FROM (SELECT doc_id, {tok('text')} AS ts FROM docs))""",
    "ctoks": f"""
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos, token
        FROM toks WHERE length(token) > 2 AND token NOT IN {word_list(lexicon.stop_words())}""",
    "stems": f"SELECT token, {stem('token')} AS stem FROM (SELECT DISTINCT token FROM toks)",
    "cstems": "SELECT c.doc_id, c.pos, c.token, s.stem FROM ctoks c JOIN stems s USING (token)",
    "tf": "SELECT doc_id, stem, count(*) AS tf FROM cstems GROUP BY doc_id, stem",
    "df": "SELECT stem, count(*) AS df FROM tf GROUP BY stem",
    "tfidf": """
        SELECT doc_id, stem, tf, tf * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1) AS weight
        FROM tf JOIN df USING (stem)""",
    "stoks": f"""
        SELECT doc_id, sent_idx, i - 1 AS pos, list_extract(ts, i) AS token FROM (
          SELECT doc_id, sent_idx, ts, unnest(range(1, len(ts) + 1)) AS i
          FROM (SELECT doc_id, sent_idx, {content('sentence')} AS ts FROM sents))""",
    "sstems": f"""
        SELECT s.doc_id, s.sent_idx, s.pos, v.stem FROM stoks s
        JOIN (SELECT token, {stem('token')} AS stem FROM (SELECT DISTINCT token FROM stoks)) v USING (token)""",
    "stf": "SELECT doc_id, sent_idx, stem, count(*) AS tf FROM sstems GROUP BY doc_id, sent_idx, stem",
}

_WORD = re.compile(r"\b\w+\b")


def sql(body: str, **extra: str) -> str:
    """Prefix body with exactly the named views it (transitively) uses."""
    library = {**{n: _view_sql(n) for n in VIEWS}, **TEXT_CTES, **extra}
    order: list[str] = []

    def need(text: str, seen: tuple[str, ...]) -> None:
        for name in dict.fromkeys(_WORD.findall(text)):
            if name in library and name not in order and name not in seen:
                need(library[name], seen + (name,))
                order.append(name)

    need(body, ())
    if not order:
        return body.strip()
    recursive = [n for n in order if n in _WORD.findall(library[n])]
    heads = ",\n".join(
        f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({library[n]})" for n in order
    )
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}\n{body.strip()}"
