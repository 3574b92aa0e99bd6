"""Quality rules with thresholds that follow each language and source (operator 8).

Only DataFrame functions. One pass over the texts gives narrow counts per document, which
are stored. From them come mergeable quantile sketches: for each language, source and
measure a histogram over buckets of at most 1/32 relative width, whose counts simply add up.
The fence of a measure is its upper quartile plus WIDTH times the spread (the distance of
the quartiles, at least the measure's least spread), its floor likewise below the lower quartile
where the measure has two sides. A group of fewer than LEAST_GROUP documents takes the merged
sketch of its language, a language of fewer that of all documents. The fences are joined back to the
documents. Hot languages or sources cost nothing: histograms are combined before the shuffle,
and the fences are broadcast where they are few and salted where they are many.

Defined results: null or empty text has no words and fails the base rule; null language or
source is a group of its own; ties at a fence are kept; repeated rows each give a row; an
empty table gives an empty result; other columns are ignored. A very long text is judged as a whole,
by rates that do not follow its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import stored

LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
#: Spreads beyond the upper quartile that are still kept.
WIDTH = 3
#: Measures and the least spread of each: in thousandths of the words (symbols, exclamation marks, words equal
#: to the one before) or lines (repeated ones), and the mean length of a word in hundredths of a character.
MEASURES = {"symbol_rate": 40, "exclaim_rate": 60, "adjacent_rate": 40, "dup_line_rate": 150, "word_length": 40}
TWO_SIDED = ("word_length",)
#: Documents that a group needs for a sketch of its own.
LEAST_GROUP = 50
#: Groups up to which the fences are sent to all tasks; beyond that their rows are copied for so many salts.
MOST_GROUPS, SALTS = 20_000, 64
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _counted(text: Column, characters: str) -> Column:
    """How many of these ASCII characters there are."""
    return F.octet_length(text) - F.octet_length(_without(text, characters))


def _shifted(array: str, by: int, over: str) -> Column:
    """A hash of each entry and the one so many places on; entries that reach over the end are meaningless."""
    return F.zip_with(array, F.slice(array, by + 1, F.greatest(F.col(over), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("lang"), F.col("source"))


def measure(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_exclaims, n_adjacent, n_lines, text_key."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flat = text
    for c in SPACES:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES + " "))) > 0)
    first = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.array_remove(F.split(flat, " "), "").alias("words"), lines.alias("lines"),
        F.char_length(F.replace(flat, F.lit(" "), F.lit(""))).cast("long").alias("word_chars"),
        _counted(text, SYMBOLS).cast("long").alias("n_symbols"), _counted(text, "!").cast("long").alias("n_exclaims"), _text_key().alias("text_key"),
    )
    kept = ["doc_id", "lang", "source", "word_chars", "n_symbols", "n_exclaims", "text_key"]
    coded = first.select(
        *kept, F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("codes"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"),
    )
    kept += ["n", "n_dup_lines", "n_lines"]
    next_ones = F.zip_with("codes", F.slice("codes", 2, F.greatest(F.col("n"), F.lit(1))), lambda a, b: a == b)
    same = F.size(F.filter(next_ones, lambda x: x)).cast("long").alias("n_adjacent")
    twos = coded.select(*kept, same, _shifted("codes", 1, "n").alias("twos"))
    kept += ["n_adjacent"]
    fours = twos.select(*kept, _shifted("twos", 2, "n").alias("fours"))
    eights = fours.select(*kept, _shifted("fours", 4, "n").alias("eights"))
    windows = eights.select(*kept, F.slice("eights", 1, F.greatest(F.col("n") - (WINDOW - 1), F.lit(0))).alias("windows"))

    # documents without a repeated window (nearly all) stop here; the others sort theirs
    numbered = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    found = windows.select(*kept, F.when(repeats, numbered).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("numbered"))
    pairs = F.zip_with(
        "numbered", F.slice("numbered", 2, F.greatest(F.size("numbered"), F.lit(1))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    placed = found.select(*kept, F.sort_array(F.array_distinct(F.flatten(pairs))).alias("at"))
    steps = F.zip_with(
        "at", F.slice("at", 2, F.greatest(F.size("at"), F.lit(1))),
        lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))),
    )
    return placed.select(
        "doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"), "n_exclaims",
        "n_adjacent", "n_lines", "text_key",
    )


def bucket(value: Column) -> Column:
    """The upper edge of a non-negative integer's bucket: exact below 64, else six leading bits."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift) + 1, shift) - 1


def _group(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit("")).alias(f"{column}_group")


def sketches(measured: DataFrame) -> DataFrame:
    """Histograms per language, source and measure: lang_group, source_group, measure, value (a bucket's upper edge), n."""
    rows = measured.where("n_words > 0").select(
        _group("lang"), _group("source"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("value")) for m in MEASURES])).alias("x"),
    )
    return rows.groupBy("lang_group", "source_group", "x.measure", "x.value").agg(F.count("*").alias("n"))


def _limits(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n (documents), and for each measure its fence (and floor)."""
    group = Window.partitionBy(*keys, "measure")
    ranked = histograms.groupBy(*keys, "measure", "value").agg(F.sum("n").alias("n")).withColumns({
        "up_to": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group),
    })
    quartiles = ranked.groupBy(*keys, "measure").agg(
        F.min(F.when(F.col("up_to") * 4 >= F.col("total"), F.col("value"))).alias("lower"),
        F.min(F.when(F.col("up_to") * 4 >= F.col("total") * 3, F.col("value"))).alias("upper"),
        F.max("total").alias("total"),
    )
    least = F.create_map(*[F.lit(x) for m in MEASURES.items() for x in m])
    reach = WIDTH * F.greatest(F.col("upper") - F.col("lower"), least[F.col("measure")])
    of = lambda m, limit, name: F.max(F.when(F.col("measure") == m, limit)).alias(f"{name}_{m}")
    return quartiles.groupBy(*keys).agg(
        F.max("total").alias("n"),
        *[of(m, F.col("upper") + reach, "fence") for m in MEASURES], *[of(m, F.col("lower") - reach, "floor") for m in TWO_SIDED],
    )


def fences(histograms: DataFrame) -> DataFrame:
    """What is kept: lang_group, source_group, a fence_<measure> for each measure, and a floor_<measure> where it has two sides."""
    names = [*[f"fence_{m}" for m in MEASURES], *[f"floor_{m}" for m in TWO_SIDED]]
    packed = lambda level: F.struct("n", *names).alias(level)
    every = F.lit(0).alias("every")
    own = _limits(histograms, ["lang_group", "source_group"]).select("lang_group", "source_group", packed("own"), every)
    lang = _limits(histograms, ["lang_group"]).select("lang_group", packed("of_lang"))
    whole = _limits(histograms.withColumn("every", F.lit(0)), ["every"]).select("every", packed("of_all"))
    levels = own.join(lang, "lang_group").join(whole, "every")
    enough = lambda level: F.col(level)["n"] >= LEAST_GROUP
    chosen = F.when(enough("own"), F.col("own")).when(enough("of_lang"), F.col("of_lang")).otherwise(F.col("of_all"))
    return levels.select("lang_group", "source_group", *[chosen[n].alias(n) for n in names])


def _judged(documents: DataFrame) -> DataFrame:
    rate = lambda n, of, by: F.coalesce(F.expr(f"{n} * {by} div nullif({of}, 0)"), F.lit(0))
    rates = {
        "symbol_rate": rate("n_symbols", "n_words", 1000), "exclaim_rate": rate("n_exclaims", "n_words", 1000),
        "adjacent_rate": rate("n_adjacent", "n_words", 1000), "dup_line_rate": rate("n_dup_lines", "n_lines", 1000),
        "word_length": rate("word_chars", "n_words", 100),
    }
    measured = stored(measure(documents).withColumns(rates), "quality-counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    within = [F.col(m) <= F.col(f"fence_{m}") for m in MEASURES] + [F.col(m) >= F.col(f"floor_{m}") for m in TWO_SIDED]
    verdict = ~F.col("base_failed")
    for w in within:
        verdict = verdict & F.coalesce(w, F.lit(True))
    grouped = measured.withColumns({"lang_group": _group("lang"), "source_group": _group("source")})
    limits = stored(fences(sketches(measured)), "quality-fences")
    keys = ["lang_group", "source_group"]
    if limits.count() <= MOST_GROUPS:
        limits = F.broadcast(limits)  # at most MOST_GROUPS rows
    else:  # hot groups are dealt over SALTS tasks
        limits = limits.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        grouped = grouped.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(SALTS)).cast("int"))
        keys.append("salt")
    joined = grouped.join(limits, keys, "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", verdict)


def judge(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, the counts of measure, base_failed, kept, and its measures and fences."""
    return _judged(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        *MEASURES, *[f"fence_{m}" for m in MEASURES], *[f"floor_{m}" for m in TWO_SIDED],
    )


def keep_good(documents: DataFrame) -> DataFrame:
    """The documents that judge keeps, with all their columns."""
    dropped = _judged(documents).where("not kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (_text_key() == F.col("_key"))
    return documents.join(dropped.hint("shuffle_hash"), same, "left_anti")


#: DuckDB's form of the counts, the sketches and the verdict, over a relation docs(rid, doc_id, lang, source, t).
SQL_COUNTS = r"""
split_words AS (SELECT rid, doc_id, lang, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM docs),
starts AS (SELECT rid, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM split_words WHERE len(ws) >= 8)),
repeated AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM starts) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM repeated, range(0, 8) r(j) GROUP BY rid),
counts AS (SELECT w.rid, doc_id, coalesce('=' || lang, '') AS lg, coalesce('=' || source, '') AS sg, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[i + 1])) AS BIGINT) AS n_adjacent,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split_words w LEFT JOIN covered USING (rid)),
rates AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE n_symbols * 1000 // n_words END AS symbol_rate,
  CASE WHEN n_words = 0 THEN 0 ELSE n_exclaims * 1000 // n_words END AS exclaim_rate,
  CASE WHEN n_words = 0 THEN 0 ELSE n_adjacent * 1000 // n_words END AS adjacent_rate,
  CASE WHEN n_lines = 0 THEN 0 ELSE n_dup_lines * 1000 // n_lines END AS dup_line_rate,
  CASE WHEN n_words = 0 THEN 0 ELSE word_chars * 100 // n_words END AS word_length FROM counts),
long AS (SELECT lg, sg, unnest([{'m': 1, 'least': 40, 'v': symbol_rate}, {'m': 2, 'least': 60, 'v': exclaim_rate}, {'m': 3, 'least': 40, 'v': adjacent_rate},
  {'m': 4, 'least': 150, 'v': dup_line_rate}, {'m': 5, 'least': 40, 'v': word_length}]) AS x FROM rates WHERE n_words > 0),
hist AS MATERIALIZED (SELECT lg, sg, m, least, (((v >> s) + 1) << s) - 1 AS v, count(*) AS n
  FROM (SELECT lg, sg, x.m, x.least, x.v, greatest(length(bin(x.v)) - 6, 0) AS s FROM long) GROUP BY ALL),
levels AS (SELECT 1 AS level, lg, sg, m, least, v, n FROM hist UNION ALL SELECT 2, lg, '', m, least, v, sum(n) FROM hist GROUP BY ALL
  UNION ALL SELECT 3, '', '', m, least, v, sum(n) FROM hist GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY level, lg, sg, m ORDER BY v) AS u, sum(n) OVER (PARTITION BY level, lg, sg, m) AS total FROM levels),
quartiles AS (SELECT level, lg, sg, m, least, total, min(v) FILTER (WHERE u * 4 >= total) AS q1, min(v) FILTER (WHERE u * 4 >= total * 3) AS q3
  FROM ranked GROUP BY ALL),
limits AS MATERIALIZED (SELECT level, lg, sg, max(total) AS n, max(f) FILTER (WHERE m = 1) AS f1, max(f) FILTER (WHERE m = 2) AS f2, max(f) FILTER (WHERE m = 3) AS f3,
  max(f) FILTER (WHERE m = 4) AS f4, max(f) FILTER (WHERE m = 5) AS f5, max(q1 + q3 - f) FILTER (WHERE m = 5) AS f6
  FROM (SELECT *, q3 + 3 * greatest(q3 - q1, least) AS f FROM quartiles) GROUP BY ALL),
fences AS (SELECT lg, sg, c.* FROM (SELECT o.lg, o.sg, CASE WHEN o.n >= 50 THEN o.p WHEN l.n >= 50 THEN l.p ELSE a.p END AS c FROM (SELECT lg, sg, n, {'f1': f1, 'f2': f2, 'f3': f3, 'f4': f4, 'f5': f5, 'f6': f6} AS p FROM limits WHERE level = 1) o
  JOIN (SELECT lg, n, {'f1': f1, 'f2': f2, 'f3': f3, 'f4': f4, 'f5': f5, 'f6': f6} AS p FROM limits WHERE level = 2) l ON l.lg = o.lg JOIN (SELECT lg, n, {'f1': f1, 'f2': f2, 'f3': f3, 'f4': f4, 'f5': f5, 'f6': f6} AS p FROM limits WHERE level = 3) a ON true)),
judged AS (SELECT rates.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, f1, f2, f3, f4, f5, f6
  FROM rates LEFT JOIN (SELECT lg, sg, f1, f2, f3, f4, f5, f6 FROM fences) USING (lg, sg))
"""
ORACLE = (
    "WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),"
    + SQL_COUNTS
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT base_failed AND coalesce(symbol_rate <= f1 AND exclaim_rate <= f2 AND adjacent_rate <= f3 AND dup_line_rate <= f4 AND word_length BETWEEN f6 AND f5, true) AS kept,
symbol_rate, exclaim_rate, adjacent_rate, dup_line_rate, word_length, CAST(f1 AS BIGINT) AS fence_symbol_rate, CAST(f2 AS BIGINT) AS fence_exclaim_rate,
CAST(f3 AS BIGINT) AS fence_adjacent_rate, CAST(f4 AS BIGINT) AS fence_dup_line_rate, CAST(f5 AS BIGINT) AS fence_word_length, CAST(f6 AS BIGINT) AS floor_word_length FROM judged"""
)
