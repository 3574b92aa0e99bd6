"""Quiz averages do not depend on how the attempts are dealt over files and tasks."""

import math

import duckdb
from pyspark.sql import functions as F

from scholia.operators import engagement as e
from scholia.plans.registry import ORACLES, QUERIES
from tests.checking import compare


def test_sums_in_event_order(spark):
    n = F.col("id")
    attempts = spark.range(24000).select(
        F.when(n % 1500 > 0, n % 1500).alias("user_id"),
        n.alias("event_id"),
        F.pmod(F.hash(n), F.lit(11)).alias("score"),
        (F.pmod(F.hash(n, F.lit(1)), F.lit(6)) * 2).alias("total"),
    )
    sums, sizes = {}, {}
    for r in sorted(attempts.collect(), key=lambda r: r.event_id):
        sums[r.user_id] = sums.get(r.user_id, 0.0) + (r.score / r.total if r.total else 0.0)
        sizes[r.user_id] = sizes.get(r.user_id, 0) + 1
    want = {u: (sizes[u], math.floor(sums[u] / sizes[u] * 100 + 0.5)) for u in sums}
    assert None in want and len(want) == 1500
    for dealt in (attempts.coalesce(1), attempts.repartition(7), attempts.orderBy(F.desc("event_id"))):
        got = {r.user_id: (r.n_attempts, r.average_pct) for r in e.quiz_average(dealt).collect()}
        assert got == want


def test_odd_events_equal_sql(spark, tmp_path):
    """Negative values, no value, no user, many files: the SQL on one thread."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    (tmp_path / "events.parquet").mkdir()
    for part in range(6):
        con.execute(
            f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i) SECOND AS ts,
                  CASE WHEN i % 400 > 0 THEN i % 400 END AS user_id, 'signup' AS event_type,
                  CASE WHEN i % 97 > 0 THEN (hash(i) % 60000)::DOUBLE / 100 - 50 END AS value, '{{"k": 1}}' AS props
                FROM range({part} * 1000, {part} * 1000 + 1000) t(i))
                TO '{tmp_path}/events.parquet/part{part}.parquet' (FORMAT parquet)"""
        )
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    ok, why, n, *_ = compare(spark, QUERIES["quiz_average"], ORACLES["quiz_average"], str(tmp_path), con)
    assert ok and n == 400, why
