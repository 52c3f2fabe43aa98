"""Runs the headline queries and prints one JSON line with their seconds."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from lodestone import session  # noqa: E402
from lodestone.plans import registry  # noqa: E402

HEADLINE = (
    "Q_gap_report", "I1_desalination_methods", "I3_experiments_publications", "I5_compare_ru_foreign", "I6_gap_matrix", "I8_geography_themes",
    "I9_subgraph_edges", "I11_recommendation_adjacent", "I12_contradiction_pairs", "K1_vector_search", "K4_quota_merge", "E6_entity_dedup",
    "D11_E8_relations", "B7_upsert_entities", "B8_upsert_relations", "C11_chunks", "C16_constraints", "C23_geography", "C24_topic_hits",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session.prepare(session.local_session(int(os.environ.get("BENCH_CPUS", "8")), **{"spark.sql.warehouse.dir": tempfile.mkdtemp()}))
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp())
    registered, seconds = registry.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    for name in HEADLINE:
        start = time.time()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
