"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from scholia import plans
from scholia.plans.registry import QUERIES
from scholia.session import local_session

HEADLINE = [
    "popular_courses", "related_materials", "materials_enriched", "saved_with_material", "library_stats",
    "study_streaks", "topic_mastery", "study_time_profile", "rate_limit_audit",
    "tokens", "term_frequency", "tfidf", "bigrams", "token_categories", "readability", "language_id",
    "ocr_signals", "document_profile", "keywords", "stream_event_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    plans.load()
    spark = local_session(cpus, "bench", os.environ.get("BENCH_MEMORY", "16g"))
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the engine
    took = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
