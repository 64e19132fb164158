"""Wall time of headline queries, as one JSON line.

Each query is planned and run to the end with its rows written to the no-op
sink, so no work is pruned away and nothing is collected.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gridwright.plans import QUERIES  # noqa: E402
from gridwright.session import local_session  # noqa: E402

HEADLINE = [
    "filter_gte_lte_lt", "filter_cmp_numeric_first", "fx_arithmetic", "agg_multi", "chained_steps", "pivot_cross_sum",
    "agg_sumif_by_row", "lookup_single_key", "lookup_chained_tables", "lookup_hot_key", "fuzzy_lookup_suppliers", "fuzzy_lookup_parts",
    "key_mapping_best", "zip_tables_by_position", "sort_whole_table", "sort_nulls_last_top_rows", "dedup_first", "dedup_whole_rows",
    "clean_cells", "std_text_documents", "std_numbers", "profile_orders", "audit_findings", "audit_duplicate_events",
    "audit_apply_fixes", "quality_outliers", "quality_rule_product", "check_sort_violations", "diff_row_changes", "csv_round_trip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
