"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from claimsift.plans import QUERIES
from claimsift.session import local_session

HEADLINE = [
    "clean_text",
    "corpus_profile",
    "top_terms_by_label",
    "classify_rules",
    "report_with_confidence",
    "classify_embedding",
    "classify_llm",
    "classification_cost",
    "uncached_requests",
    "upsert_documents",
    "answer_requests",
    "few_shot_requests",
    "classify_by_responder",
    "process_documents",
    "stream_ingest",
    "classification_report",
    "stage_time_box",
    "cumulative_stage_time",
    "extract_html_text",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus)
    run(spark, "clean_step_01", sf_dir)  # start the executor threads and page in the file
    seconds = {name: run(spark, name, sf_dir) for name in HEADLINE}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "documents": documents,
                "documents_per_sec": {
                    q: round(documents / seconds[q]) for q in ("clean_text", "classify_rules", "corpus_profile")
                },
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
