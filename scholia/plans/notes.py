"""Queries over texts built from order rows, which hold the patterns that prose rarely does, and over files written from tables.

The expected rows are stated from the columns themselves, so they check the patterns and
not only the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.functions.register import register_functions
from scholia.operators import extraction as ex
from scholia.operators import graph
from scholia.operators import integrity as v
from scholia.operators import structure, text
from scholia.operators import writes as w
from scholia.plans import duck
from scholia.plans.duck import sql
from scholia.plans.registry import register
from scholia.session import work_folder
from scholia.sources import files
from scholia.sources.tables import Catalog

FIELDS = """
SELECT o_orderkey AS doc_id, lower(c_mktsegment) AS segment, concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) AS author,
  o_orderkey % 9 + 1 AS days, o_custkey AS claim, o_orderpriority AS priority, 100 + o_orderkey % 300 AS low, 2000 + o_custkey % 50 AS high,
  1990 + o_orderkey % 30 AS cited, 1 + o_orderkey % 3 AS figure
FROM {orders} JOIN {customer} ON o_custkey = c_custkey
"""
NOTE = """
SELECT doc_id, concat('The ', segment, ' order ', doc_id, ' causes a delay of ', days, ' days.', chr(10), 'Late shipping leads to ticket ', claim, '.', chr(10),
  'Therefore the customer with priority ', priority, ' must wait for a reply.', chr(10),
  'Courses CSC ', low, ' and ECO', high, ' treat the case (', author, ', ', cited, ').', chr(10),
  'Figure ', figure, ': chart of totals for order ', doc_id) AS text
FROM {fields}
"""
CASE = """
SELECT doc_id, concat('If order ', doc_id, ' is late then stock is short, therefore customer ', claim, ' waits longer.', chr(10),
  'Most orders of ', segment, ' ship late, hence stock rises ', days, ' units.', chr(10),
  'The buyer ', claim, ' waits because order ', doc_id, ' is late.') AS text
FROM {fields}
"""
_DUCK_FIELDS = FIELDS.replace("{orders}", "orders").replace("{customer}", "customer")
_DUCK_NOTES = NOTE.replace("{fields}", "fields")


def _notes(t: Catalog) -> DataFrame:
    """A few bytes of an order make a text that keeps a core busy, so the notes are dealt over all cores."""
    fields = t.spark.sql(FIELDS, orders=t.orders, customer=t.customer)
    return text.by_document(t.spark.sql(NOTE, fields=fields))


def _cases(t: Catalog) -> DataFrame:
    return text.by_document(t.spark.sql(CASE, fields=t.spark.sql(FIELDS, orders=t.orders, customer=t.customer)))


def _sql(body: str) -> str:
    return sql(body, fields=_DUCK_FIELDS, docs=_DUCK_NOTES)


@register(
    "argument_sentences_of_orders",
    _sql(f"""SELECT doc_id, CAST(0 AS BIGINT) AS rank, concat('Therefore the customer with priority ', priority, ' must wait for a reply.') AS sentence
             FROM fields WHERE doc_id IN (SELECT doc_id FROM docs WHERE length({duck.strip('text')}) >= 50)"""),
)
def _(t: Catalog):
    return text.argument_sentences(_notes(t)).withColumn("rank", F.col("rank").cast("long"))


@register(
    "course_codes_of_orders",
    _sql("""SELECT doc_id, concat('CSC ', low) AS code, CAST(1 AS BIGINT) AS mentions FROM fields
            UNION ALL SELECT doc_id, concat('ECO', high), 1 FROM fields"""),
)
def _(t: Catalog):
    return ex.course_codes(_notes(t))


@register(
    "course_code_index_of_orders",
    _sql("""SELECT concat('CSC ', low) AS code, count(*) AS n_docs, count(*) AS mentions FROM fields GROUP BY low
            UNION ALL SELECT concat('ECO', high), count(*), count(*) FROM fields GROUP BY high"""),
)
def _(t: Catalog):
    return ex.course_code_index(ex.course_codes(_notes(t)))


@register(
    "figures_of_orders",
    _sql("""SELECT doc_id, CAST(strpos(text, 'Figure') - 1 AS BIGINT) AS start, CAST(figure AS VARCHAR) AS number, concat('chart of totals for order ', doc_id) AS caption,
            'chart' AS type, CAST(0 AS BIGINT) AS n_mentions FROM fields JOIN docs USING (doc_id)"""),
)
def _(t: Catalog):
    found = structure.figures(_notes(t))
    return found.select("doc_id", F.col("start").cast("long"), "number", "caption", "type", F.size("mentions").cast("long").alias("n_mentions"))


@register(
    "references_of_orders",
    _sql("""SELECT doc_id, concat('(', author, ', ', cited, ')') AS raw, 'inline' AS style, 'unknown' AS kind, author AS authors, CAST(NULL AS VARCHAR) AS title,
            CAST(cited AS BIGINT) AS year, CAST(NULL AS VARCHAR) AS source FROM fields"""),
)
def _(t: Catalog):
    return ex.references(_notes(t)).withColumns({"authors": F.array_join("authors", ";"), "year": F.col("year").cast("long")})


@register(
    "citation_counts_of_orders",
    _sql("""SELECT lower(author) AS author, CAST(cited AS BIGINT) AS year, 'unknown' AS kind, count(*) AS citations, count(*) AS n_docs
            FROM fields GROUP BY author, cited"""),
)
def _(t: Catalog):
    return ex.citation_counts(ex.references(_notes(t))).withColumn("year", F.col("year").cast("long"))


@register(
    "causal_relations_of_orders",
    _sql("""SELECT doc_id, CAST(1 AS BIGINT) AS rank, concat('The ', segment, ' order ', doc_id) AS cause, concat('a delay of ', days, ' days') AS effect,
              'strong' AS strength, false AS bidirectional FROM fields
            UNION ALL SELECT doc_id, 2, 'Late shipping', concat('ticket ', claim), 'strong', false FROM fields"""),
)
def _(t: Catalog):
    return ex.causal_relations(_notes(t)).withColumn("rank", F.col("rank").cast("long"))


@register(
    "reasoning_steps_of_orders",
    _sql("""SELECT doc_id, CAST(1 AS BIGINT) AS rank, 'conditional' AS type, concat('order ', doc_id, ' is late') AS premise,
              concat('stock is short, therefore customer ', claim, ' waits longer') AS conclusion, 0.95 AS confidence, CAST(3 AS BIGINT) AS n_evidence, '' AS fallacies FROM fields
            UNION ALL SELECT doc_id, 2, 'causal', 'order', concat(doc_id, ' is late'), 0.85, 3, '' FROM fields
            UNION ALL SELECT doc_id, 3, 'deductive', 'implicit', concat('customer ', claim, ' waits longer'), 0.8, 3, '' FROM fields""").replace("0.95 AS", "0.95::DOUBLE AS"),
)
def _(t: Catalog):
    out = ex.reasoning_steps(_cases(t))
    return out.withColumns({"rank": F.col("rank").cast("long"), "n_evidence": F.col("n_evidence").cast("long"), "fallacies": F.array_join("fallacies", "|")})


@register(
    "inferences_of_orders",
    _sql("""SELECT doc_id, CAST(0 AS BIGINT) AS sent_idx, 'Modus Ponens' AS rule, 'deductive' AS type, concat('order ', doc_id, ' is late|stock is short') AS premises,
              concat('customer ', claim, ' waits longer') AS conclusion FROM fields
            UNION ALL SELECT doc_id, 1, 'Inductive Generalization', 'inductive', concat('Most orders of ', segment, ' ship late,'), concat('stock rises ', days, ' units.') FROM fields
            UNION ALL SELECT doc_id, 2, 'Causal Inference', 'causal', concat('order ', doc_id, ' is late.'), concat('The buyer ', claim, ' waits') FROM fields"""),
)
def _(t: Catalog):
    return ex.inferences(_cases(t)).withColumns({"sent_idx": F.col("sent_idx").cast("long"), "premises": F.array_join("premises", "|")})


@register(
    "answers_of_orders",
    _sql("""SELECT doc_id AS question_id, concat('The ', segment, ' order ', doc_id, ' causes a delay of ', days, ' days') AS answer, 0.8::DOUBLE AS confidence FROM fields"""),
)
def _(t: Catalog):
    notes = _notes(t)
    questions = notes.select(F.col("doc_id").alias("question_id"), "doc_id", F.lit("What did the order bring about?").alias("question"))
    return ex.answers(questions, notes)


LINKED = """
SELECT doc_id, concat('Here Order ', doc_id, ' depends on stock ', days, '.', chr(10), 'Every ', segment, ' claim includes order ', doc_id, '.', chr(10),
  'Assuming knowledge of ', segment, ' pricing, all is said.', chr(10), chr(10), 'Table ', figure, ': Delays of order ', doc_id, chr(10),
  '| item | days |', chr(10), '|---|---|', chr(10), '| ', segment, ' | ', days, ' |') AS text
FROM {fields}
"""


def _fields(t: Catalog) -> DataFrame:
    return t.spark.sql(FIELDS, orders=t.orders, customer=t.customer)


def _edges(t: Catalog) -> DataFrame:
    """Three edges an order: one in the words' order, one against it, one that no words relate."""
    order, stock = F.concat(F.lit("order "), "doc_id"), F.concat(F.lit("Stock "), "days")
    claim = F.concat("segment", F.lit(" claim"))
    pairs = F.array(*[F.struct(a.alias("source_label"), b.alias("target_label")) for a, b in ((order, stock), (order, claim), (claim, stock))])
    named = _fields(t).select("doc_id", F.posexplode(pairs).alias("source", "p"))
    return named.select("doc_id", "source", "p.*")


def _linked(t: Catalog) -> DataFrame:
    return t.spark.sql(LINKED, fields=_fields(t))


@register(
    "edge_relations_of_orders",
    _sql("""SELECT doc_id, CAST(source AS BIGINT) AS source, ['depends_on', 'part_of', 'related_to'][source + 1] AS relation FROM fields, range(0, 3) r(source)"""),
)
def _(t: Catalog):
    found = graph.edge_relations(_edges(t), _linked(t))
    return found.select("doc_id", F.col("source").cast("long"), "relation")


@register(
    "topic_order_of_orders",
    _sql("""SELECT doc_id, concat('Order ', doc_id) AS topic, CAST(2 AS BIGINT) AS n_prerequisites, CAST(2 AS BIGINT) AS position FROM fields
            UNION ALL SELECT doc_id, concat('stock ', days), 0, 0 FROM fields UNION ALL SELECT doc_id, concat(segment, ' claim'), 0, 1 FROM fields"""),
)
def _(t: Catalog):
    """An order needs its stock and its claim, so it comes last although it is ranked first."""
    topics = F.array(F.concat(F.lit("Order "), "doc_id"), F.concat(F.lit("stock "), "days"), F.concat("segment", F.lit(" claim")))
    ranked = _fields(t).select("doc_id", F.posexplode(topics).alias("rank", "topic"))
    out = graph.topic_order(ranked, graph.edge_relations(_edges(t), _linked(t)))
    return out.select("doc_id", "topic", "n_prerequisites", F.col("position").cast("long"))


@register(
    "prerequisites_of_orders",
    _sql("SELECT doc_id, CAST(0 AS BIGINT) AS rank, concat(segment, ' pricing, all is said') AS prerequisite FROM fields"),
)
def _(t: Catalog):
    none = t.spark.sql("SELECT CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS ARRAY<STRING>) AS _topics WHERE false")
    return ex.prerequisites(_linked(t), none).withColumn("rank", F.col("rank").cast("long"))


@register(
    "text_tables_of_orders",
    _sql("""SELECT doc_id, CAST(1 AS BIGINT) AS "table", 'captioned' AS kind, concat('Delays of order ', doc_id) AS title, CAST(r AS BIGINT) AS "row", CAST(c AS BIGINT) AS col,
              CASE WHEN r = 0 THEN ['item', 'days'][c + 1] WHEN c = 0 THEN segment ELSE CAST(days AS VARCHAR) END AS value
            FROM fields, range(0, 2) a(r), range(0, 2) b(c)"""),
)
def _(t: Catalog):
    cells = structure.text_tables(_linked(t)).drop("caption")
    return cells.withColumns({c: F.col(c).cast("long") for c in ("table", "row", "col")})


@register(
    "orphans_of_first_year",
    sql("""SELECT course_code, count(*) AS n_rows FROM materials WHERE course_code NOT IN (SELECT code FROM courses WHERE year = 1 AND code IS NOT NULL)
           GROUP BY course_code"""),
)
def _(t: Catalog):
    """Materials whose course is none of the first year's."""
    return v.orphans(t.materials, "course_code", t.courses.where("year = 1"), "code")


# --- files --------------------------------------------------------------------


@register(
    "text_corpus",
    sql("""SELECT item_id, 'txt' AS extension, text, CASE WHEN length(text) >= 200 THEN 'good' WHEN length(text) >= 20 THEN 'partial' ELSE 'none' END AS quality
           FROM (SELECT item_id, trim(regexp_replace(text, '[ \t]+', ' ', 'g'), ' ' || chr(10)) AS text FROM benchmark)"""),
)
def _(t: Catalog):
    """Benchmark items written as one text file each, and read back as documents."""
    path = work_folder(t.spark, "corpus")
    t.benchmark.select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    read = files.read_text_corpus(t.spark, path)
    return read.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "extension", "text", "quality")


@register(
    "delimited",
    sql("""SELECT CAST(c_custkey AS VARCHAR) AS c0, concat(c_name, ', "', c_mktsegment, '"') AS c1, CAST(c_nationkey AS VARCHAR) AS c2 FROM customer"""),
)
def _(t: Catalog):
    """Customers written as quoted comma-separated lines, and read back as cells."""
    path = work_folder(t.spark, "cells")
    named = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    t.customer.select("c_custkey", named.alias("name"), "c_nationkey").write.option("escape", '"').csv(path)
    return files.read_delimited(t.spark, path)


# --- functions and orderings ----------------------------------------------------


@register(
    "sql_functions",
    sql(f"""SELECT token, {duck.stem('token')} AS stem, CAST({duck.syllables('token')} AS BIGINT) AS syllables, count(*) AS n FROM toks GROUP BY ALL"""),
)
def _(t: Catalog):
    """The registered SQL functions over every token of the documents."""
    register_functions(t.spark)
    return t.spark.sql(
        """SELECT token, study_stem(token) AS stem, CAST(study_syllables(token) AS BIGINT) AS syllables, n
           FROM (SELECT token, count(*) AS n FROM (SELECT explode(found) AS token FROM (SELECT study_tokens(text) AS found FROM {documents})) GROUP BY token)""",
        documents=t.documents,
    )


@register(
    "swap_positions",
    sql("""SELECT id, material_id, CAST(CASE WHEN material_id = 3 AND position = 0 THEN 2 WHEN material_id = 3 AND position = 2 THEN 0 ELSE position END AS BIGINT) AS position
           FROM flashcards"""),
)
def _(t: Catalog):
    moved = w.swap_positions(t.flashcards.select("id", "material_id", "position"), "material_id", 3, 0, 2)
    return moved.withColumn("position", F.col("position").cast("long"))


@register(
    "merge_summaries",
    sql(f"""SELECT doc_id, CASE WHEN max(chunks) = 1 THEN max(lone) ELSE coalesce(string_agg(piece, '. ' ORDER BY chunk, i) FILTER (WHERE n <= 5), '') END AS summary
    FROM (SELECT s.*, p.i, p.piece, CASE WHEN keep THEN row_number() OVER (PARTITION BY s.doc_id, keep ORDER BY s.chunk, p.i) END AS n
      FROM (SELECT doc_id, chunk, summary, count(*) OVER (PARTITION BY doc_id) AS chunks, first_value(summary) OVER (PARTITION BY doc_id ORDER BY chunk) AS lone FROM parts) s
      LEFT JOIN (SELECT doc_id, chunk, i, string_split(summary, '. ')[i] AS piece, length({duck.strip("string_split(summary, '. ')[i]")}) > 20 AS keep
        FROM (SELECT *, unnest(range(1, len(string_split(summary, '. ')) + 1)) AS i FROM parts)) p ON p.doc_id = s.doc_id AND p.chunk = s.chunk)
    GROUP BY doc_id""", parts="SELECT doc_id // 3 AS doc_id, doc_id AS chunk, text AS summary FROM documents"),
)
def _(t: Catalog):
    """Every three neighbouring documents as the chunk summaries of one."""
    parts = t.documents.select(F.floor(F.col("doc_id") / 3).alias("doc_id"), F.col("doc_id").alias("chunk"), F.col("text").alias("summary"))
    return w.merge_summaries(parts, 5)
