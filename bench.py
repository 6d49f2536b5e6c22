"""Wall time of the headline queries; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from statproof.plans import registry  # noqa: E402
from statproof.session import local_session  # noqa: E402

HEADLINE = ["a08_split_sentences", "a09_insert_new", "b01_extract_quantities", "b05_detect_candidates", "c07_rerank", "c08_candidate_fit", "c11_match_score", "d11_normalize_units",
            "d12_compare_values", "d13_verify_claims", "d17_diff_snapshots", "d18_revision_impact", "d20_compare_snapshot", "d28_evaluate_formulas", "d30_pending_requests", "e03_apply_failures",
            "e11_validate_transitions", "e14_rate_audit", "f03_classification_report", "f13_agreement", "f16_validate_gold", "g03_reviewed_metrics", "g10_shadow_export", "h04_structure_stats", "h06_histogram"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session()
    spark.range(1000).selectExpr("sum(id)").collect()
    queries, times = registry.queries(), {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
