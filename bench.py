"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all cores), BENCH_RUNS
(default 3, the median counts) and BENCH_ONLY (comma-separated names) steer it.

The given tables are one row group each, which only one task can read. The same rows are
therefore laid out in BENCH_FILES files a table first (default 16, not timed; 0 reads the given
files), as a cluster would hold them.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import tempfile
import time

import pyarrow.parquet as pq

from ruleloom.catalog import all_queries
from ruleloom.session import build_session, release_staged

HEADLINE = (
    "files_in_scope",
    "rule_file_scope",
    "regex_hits",
    "import_hits",
    "evidence_totals",
    "top_matches",
    "evidence_records",
    "violations_normalized",
    "severity_summary",
    "report_findings",
    "rule_blocks",
    "rule_findings",
    "config_effective",
    "doctor_findings",
    "audit_prompts",
    "fix_prompts_by_rule",
    "localized_rules",
)


def laid_out(sf_dir: str, files: int) -> str:
    """A copy of the tables, each row once, in ``files`` files a table."""
    target = tempfile.mkdtemp(prefix="bench-")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        rows = pq.read_table(path)
        step = max(1, -(-rows.num_rows // files))
        os.makedirs(folder := f"{target}/{os.path.basename(path)}")
        for at in range(0, max(1, rows.num_rows), step):
            pq.write_table(rows.slice(at, step), f"{folder}/part-{at // step:05d}.parquet")
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    files = int(os.environ.get("BENCH_FILES", "16"))
    source = laid_out(sf_dir, files) if files else sf_dir
    cores = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session("ruleloom-bench", cores=cores, partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            queries[name](spark, source).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
            release_staged(spark)
        times[name] = round(statistics.median(taken), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf, "cores": cores, "files_per_table": files}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
