"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the sample data (default sf0.1) and ``BENCH_CPUS`` the local cores.  Every query
runs over its whole tables into a sink that reads all rows; the time is the better of two runs, so that
code generation is paid before.  The sample tables are single files; they are first copied, untimed, to tables of as
many files as there are cores, as large tables come.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "complexity_by_repo",
    "smells",
    "style_issues",
    "vulnerabilities",
    "contextual_vulnerabilities",
    "auth_issues",
    "all_issues",
    "exposed_secrets",
    "document_secrets",
    "project_context",
    "validation_coverage",
    "function_purity",
    "function_sizes",
    "doc_coverage",
    "docblock_band_join",
    "api_overview",
    "syntax_counts",
    "repetitive_access",
    "repo_structure",
    "language_distribution",
    "largest_files",
    "insights",
    "kept_files",
    "smells_by_type",
    "action_plan",
    "comments",
    "prompts",
    "path_audit",
    "key_summary",
    "missing_required_keys",
]

# Queries that scan the whole derived corpus, for throughput per family.
TEXT_QUERIES = [
    "complexity_by_repo",
    "smells",
    "style_issues",
    "vulnerabilities",
    "all_issues",
    "exposed_secrets",
    "project_context",
    "function_purity",
    "doc_coverage",
    "syntax_counts",
    "repetitive_access",
    "repo_structure",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE

    from corpus_audit.plans import derived
    from corpus_audit.plans.catalog import QUERIES
    from corpus_audit.session import build_session
    from pyspark.sql import functions as F

    spark = build_session("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    spread = tempfile.mkdtemp(prefix="bench-")
    for name in sorted(os.listdir(sf_dir)):
        spark.read.parquet(f"{sf_dir}/{name}").repartition(int(cpus)).write.parquet(f"{spread}/{name}")
    sf_name, sf_dir = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), spread
    corpus = derived.files(spark, sf_dir).agg(F.count(F.lit(1)), F.sum(F.octet_length("content"))).first()

    times: dict[str, float] = {}
    for name in chosen:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            best = taken if best is None else min(best, taken)
        times[name] = round(best, 3)
    spark.stop()

    total = sum(times.values())
    megabytes = corpus[1] / 1e6
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_name,
                "files": corpus[0],
                "corpus_mb": round(megabytes, 1),
                "mb_per_sec": {n: round(megabytes / times[n], 1) for n in TEXT_QUERIES if n in times},
                "files_per_sec": {n: round(corpus[0] / times[n]) for n in TEXT_QUERIES if n in times},
            }
        )
    )


if __name__ == "__main__":
    main()
