"""Wall time of the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.  Every query runs
twice over its whole tables into a no-op sink: ``queries`` holds the second run,
``cold`` the first.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkwell.plans import QUERIES  # noqa: E402
from inkwell.session import local_session  # noqa: E402

HEADLINE = (
    "effect_size", "describe_by", "flag_rates", "na_profile", "value_share", "style_features_16",
    "style_features_18", "clean_strict", "dedup_text", "drop_cross_group_dupes", "time_stratified_split",
    "temporal_split", "rolling_folds", "stratified_split", "event_shift", "topic_mix_by_month",
    "calendar_spine", "spearman_trend", "lexicon_sentiment", "entity_counts", "tfidf",
    "distinctive_terms", "char_wb_ngrams", "page_fields", "jsonld_entities", "class_report",
    "logistic_baseline", "topics_from_vectors", "n_distinct", "resolve_fields", "overlap_matrix",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "inkwell-bench")
    cold, warm = {}, {}
    for name in names:
        cold[name] = run(spark, name, sf_dir)
        warm[name] = run(spark, name, sf_dir)
        print(f"{name} cold {cold[name]} warm {warm[name]}", file=sys.stderr, flush=True)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec",
                "queries": warm, "cold": cold, "sf": float(found.group(1)) if found else None, "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
