"""Headline timings: each query once cold and once warm, printed as one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from thicket.catalog import ENTRIES
from thicket.session import get_session

HEADLINE = [
    "heading_paths", "line_definitions", "note_attribution", "document_languages",
    "minted_identifiers", "definition_triples", "graph_statistics", "graph_edges", "graph_nodes",
    "node_degrees", "relation_panels", "revised_graph", "question_keyword_lists",
    "document_keyword_search", "nearest_vectors", "document_context", "concept_keyword_search",
    "graph_contexts", "thresholds_by_country", "hybrid_retrieval",
]


def timed(spark, run, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(cores, shuffle_partitions=int(cores))
    first, warm, failed = {}, {}, {}
    for name in names:
        try:
            first[name] = round(timed(spark, ENTRIES[name].run, sf_dir), 3)
            warm[name] = round(timed(spark, ENTRIES[name].run, sf_dir), 3)
            print(name, first[name], warm[name], file=sys.stderr, flush=True)
        except Exception as error:  # report and go on: one line has to come out
            failed[name] = str(error).splitlines()[0][:200]
    out = {
        "metric": "sum of warm runs",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "first_run": first,
        "failed": failed,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
        "cores": int(cores),
        "spark": spark.version,
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
