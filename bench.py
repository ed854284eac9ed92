"""Times the headline queries once each, full result to a no-op sink, and
prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma list,
or 'all') select the data, the parallelism and the queries."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from veritrail.plans.catalog import CATALOG  # noqa: E402
from veritrail.session import SETTINGS, build_session  # noqa: E402

HEADLINE = (
    "keyword_top10", "sentence_list", "claim_extraction", "claim_classes", "claim_queries", "retrieval",
    "paper_ids", "dedup_doi_merge", "dedup_papers", "verification", "evidence_sources",
    "support_scores", "support_top1", "gate_reasons", "greedy_selection", "apa_entries", "bibtex_entries",
    "reference_list", "year_suffixes", "citation_numbers", "latest_verdicts",
    "verdict_findings", "marker_findings", "reference_gaps", "latex_insertions",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOG) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    SETTINGS.update({"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                     "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark = build_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus,
                      "runs": 1, "warm": False}))
    spark.stop()


if __name__ == "__main__":
    main()
