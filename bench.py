"""Queries of the reference's operators at one scale on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from usetrail.queries import QUERIES  # noqa: E402
from usetrail.session import build  # noqa: E402

#: One or more of every family; `bench.py all` runs every query.
HEADLINE = [
    "scan_corpus", "latest_by_key", "code_nodes", "code_graph", "locate_by_lines", "line_col_tokens", "pair_spans", "parents", "locate",
    "outermost_enclosing", "contained", "classify_context", "nearest_ancestor", "ancestors",
    "has_descendant", "first_descendant", "value_copy", "extract_decls", "resolve_timeline",
    "resolve_scoped", "resolve_asof", "resolve_by_name", "merge_objects", "symbol_at",
    "lock_depth", "held_at", "in_atomic", "is_synchronized_block", "severity_counts",
    "in_concurrent", "is_field_decl", "race_rollup", "read_before_write", "retention",
    "emit_findings", "hover_text", "top_kind", "build_graph", "bad_types", "refreshing_hit",
    "asof_hit", "debounce", "drop_repeats", "stream_latest", "stream_debounce",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1].split(",") if len(sys.argv) > 1 else HEADLINE
    names = list(QUERIES) if names == ["all"] else names
    spark = build(f"local[{cpus}]", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not a query
    took = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(took.values()), 3),
                "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
