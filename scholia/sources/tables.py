"""Table sources: column-pruned scans and the catalogue views built on them.

The view SQL is plain enough to run on Spark and, with two function names
swapped, on the checking engine.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from scholia.session import prepare, spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def read_table(
    spark: SparkSession, folder: str, name: str, cols: Sequence[str] | None = None
) -> DataFrame:
    """Scan one table; only the named columns reach the Parquet reader."""
    frame = prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return frame.select(*cols) if cols else frame


# Tables whose text keeps a core busy for long, with their key.
TEXT_TABLES = {"documents": "doc_id", "conversations": "conv_id"}

# {name} is a table or another view; SPLIT and JSONK differ by engine.
VIEWS: dict[str, str] = {
    "programmes": """
        SELECT n.n_nationkey AS code, n.n_name AS name, r.r_name AS school
        FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey""",
    "courses": """
        SELECT s_suppkey AS code, s_name AS title, s_nationkey AS programme_code,
               CAST(s_suppkey % 5 + 1 AS INT) AS year
        FROM {supplier}""",
    "profiles": """
        SELECT c_custkey AS id, c_name AS full_name, c_nationkey AS programme_code
        FROM {customer}""",
    "user_roles": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'student' END AS role
        FROM {customer}""",
    "materials": """
        SELECT p.p_partkey AS id, p.p_name AS title, p.p_type AS type, p.p_size AS pages,
               SPLIT(p.p_name, ' ') AS tags, l.course_code, l.uploaded_by, l.created_at,
               CASE WHEN p.p_size % 10 = 0 THEN 'failed' WHEN p.p_size % 10 = 1 THEN 'processing'
                    WHEN p.p_size % 10 IN (2, 3) THEN 'catalog_only' ELSE 'ready' END AS status,
               CASE WHEN p.p_size % 7 = 0 THEN NULL ELSE CAST(2005 + p.p_size % 20 AS INT) END AS content_year,
               CAST(coalesce(l.download_count, 0) AS BIGINT) AS download_count,
               CAST(coalesce(l.likes_count, 0) AS BIGINT) AS likes_count
        FROM {part} p LEFT JOIN (
          SELECT l_partkey, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE min(l_suppkey) END AS course_code,
                 min(o_custkey) AS uploaded_by, CAST(min(l_shipdate) AS TIMESTAMP) AS created_at,
                 count(*) AS download_count, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS likes_count
          FROM {lineitem} LEFT JOIN {orders} ON l_orderkey = o_orderkey GROUP BY l_partkey
        ) l ON p.p_partkey = l.l_partkey""",
    "flashcards": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS material_id, turn AS position, text AS question
        FROM {conversations} WHERE role = 'user'""",
    "quiz_questions": """
        SELECT conv_id * 1000 + turn AS id, conv_id AS material_id, turn AS position, text AS question
        FROM {conversations} WHERE role = 'assistant'""",
    "saved_materials": """
        SELECT o_custkey AS profile_id, l_partkey AS material_id,
               CAST(max(o_orderdate) AS TIMESTAMP) AS created_at
        FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
        GROUP BY o_custkey, l_partkey""",
    "material_requests": """
        SELECT o_orderkey AS id, o_custkey AS requested_by, o_orderkey % 100 AS course_code,
               CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' ELSE 'closed' END AS status,
               CAST(o_orderdate AS TIMESTAMP) AS created_at
        FROM {orders}""",
    "study_events": """
        SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
               CASE event_type WHEN 'view' THEN 'session' WHEN 'click' THEN 'like_toggle'
                    WHEN 'purchase' THEN 'download' WHEN 'signup' THEN 'quiz' ELSE 'pipeline_call' END AS kind,
               concat('t', CAST(CAST(JSONK(props, '$.k') AS INT) % 20 AS STRING)) AS topic,
               CAST(JSONK(props, '$.k') AS BIGINT) AS material_id,
               least(value, 100.0) / 100.0 AS ratio, value AS minutes
        FROM {events}""",
    "material_likes": """
        SELECT user_id AS profile_id, material_id, max(ts) AS created_at
        FROM {study_events} WHERE kind = 'like_toggle'
        GROUP BY user_id, material_id HAVING count(*) % 2 = 1""",
    "attempts": """
        SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts,
               concat('t', CAST(CAST(JSONK(props, '$.k') AS INT) % 3 AS STRING)) AS topic,
               CASE WHEN user_id % 3 = 0 THEN least(value, 100.0) / 100.0
                    ELSE greatest(0.0, 1.0 - value / 500.0) END AS ratio,
               CASE WHEN event_id % 3 = 0 THEN 'card' ELSE 'quiz' END AS kind
        FROM {events} WHERE event_type = 'signup'""",
    "material_text": """
        SELECT m.id AS doc_id, m.title, m.course_code, m.type, m.tags, d.text, d.lang
        FROM {materials} m JOIN {documents} d ON d.doc_id = m.id""",
}

_NAME = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A catalogue view, or a plain table, as one lazy DataFrame."""
    if name in TABLES:
        frame = read_table(spark, folder, name)
        return spread(frame, TEXT_TABLES[name]) if name in TEXT_TABLES else frame
    sql = VIEWS[name].replace("SPLIT(", "split(").replace("JSONK(", "get_json_object(")
    parts = {part: view(spark, folder, part) for part in _NAME.findall(sql)}
    return spark.sql(sql, **parts)


class Catalog:
    """Views of one folder by attribute: ``Catalog(spark, folder).materials``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES or name in VIEWS:
            return view(self.spark, self.folder, name)
        raise AttributeError(name)
