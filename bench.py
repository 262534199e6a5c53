"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores. The index is built
first and timed as ``build_index``; the queries after it read the stored tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from catalog import base  # noqa: E402
from lodeweave.session import build_session  # noqa: E402

HEADLINE = [
    "exact_dedup",
    "near_dedup",
    "chunk_tokens",
    "tokenize",
    "gazetteer_mentions",
    "cooccurrence_edges",
    "table_triples",
    "triple_pattern",
    "connected_components",
    "label_propagation",
    "pagerank",
    "triangle_count",
    "bm25_topk",
    "tfidf_cosine_topk",
    "vector_topk",
    "local_graph_search",
    "ppr_graph_search",
    "global_graph_search",
    "pack_context",
    "as_of_memory",
    "passage_truth",
    "event_windows",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)

    def build() -> None:
        index = base.index(spark, sf)
        for table in ("chunks", "postings", "rarity", "stats", "norms", "mentions", "weights", "edges", "adjacency", "members", "terms", "reports"):
            timed(f"index_{table}", lambda t=table: index[t])

    build()
    times["build_index"] = round(sum(times.values()), 3)
    for name in wanted:
        timed(name, lambda n=name: catalog.QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save())
    total = round(sum(t for n, t in times.items() if not n.startswith("index_")), 3)
    print(
        json.dumps(
            {"metric": "headline_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
        )
    )


if __name__ == "__main__":
    main()
