"""Time the headline queries on one machine and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallyframe.queries import REGISTRY  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

HEADLINE = [
    "flagship_revenue", "filter_tokens_numeric", "filter_tokens_date", "filter_words", "sort_filter", "sort_page",
    "calc_fold", "concat_parts", "conditional_last_match", "pattern_findall", "edit_batch", "style_flags",
    "group_agg", "group_agg_stats", "pivot_one", "pivot_multi_header", "merge_inner", "merge_outer", "merge_summary",
    "key_coverage", "union_all_columns", "profile_summary", "profile_types", "date_partial", "typed_strict", "null_fill",
    "pie_topk", "series_long", "fuzzy_join", "reco_exact_left", "reco_exact_right", "reco_one_to_many_left",
    "reco_many_to_many", "reco_closest", "reco_before", "reco_fuzzy", "replay_merge_edit", "replay_reconcile",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    # One query before the clock starts: the session, not the query, pays for JVM and worker start.
    REGISTRY["fuzzy_join"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    only = sys.argv[1:] or HEADLINE
    for name in only:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))


if __name__ == "__main__":
    main()
