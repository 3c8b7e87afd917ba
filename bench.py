"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries",
"sf"}. Every query's whole result is written to the ``noop`` sink, so that no
column or join is optimised away. The tables that queries share are written
first and timed on a line of their own (``staging``), so that the order of the
queries does not decide which of them pays.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from landscape.plans.registry import load_all  # noqa: E402
from landscape.session import local_session  # noqa: E402

#: producers of the shared stage tables
STAGING = ["tag_documents", "document_novelty", "novelty_long", "topic_entity_names", "association_strength"]
HEADLINE = [
    "tag_documents",
    "document_novelty",
    "topic_novelty",
    "volume_table",
    "cd_index",
    "disruption_table",
    "novelty_trends",
    "org_quad",
    "collaboration_edges",
    "named_taxonomy",
    "cooccurrence_edges",
    "association_strength",
    "journal_topic_tfidf",
    "tax_chisq",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus != "*" else 8, app="landscape-bench")
    reg = load_all()
    times: dict[str, float] = {}
    t0 = time.time()
    for key in STAGING:
        reg[key].fn(spark, sf_dir)  # builds the plan and, with it, the tables it reads
    for key in ("org_quad", "disruption_table", "novelty_trends", "collaboration_edges"):
        reg[key].fn(spark, sf_dir)
    times["staging"] = round(time.time() - t0, 3)
    for key in HEADLINE:
        t0 = time.time()
        reg[key].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
