"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verdigris.operators import retrieval  # noqa: E402
from verdigris.plans import batch, catalog_core, registry  # noqa: E402
from verdigris.session import get_session, shared_dir  # noqa: E402

HEADLINE = [
    "ghg_scope1", "ghg_scope2", "ghg_scope3_financed", "ghg_summary_annual", "pcaf_by_sector",
    "scope1_top_facilities", "yoy_by_measure", "gates_scope1", "gates_agg", "dq_ranges", "dq_profile",
    "sector_top10", "hr_yoy", "waterfall", "run_log_rollup", "run_log_latest",
    "audit_outcome", "doc_numeric_claims", "doc_prohibited_hits", "doc_chunks", "bm25_index", "bm25_top5",
    "vector_top5", "vector_ids_top5", "bm25_chunks_top5", "tolerance_anti", "hybrid_top5", "retrieval_with_fallback", "retrieval_stats", "context_pack", "context_text", "indicator_table",
]
#: Timed a second time over the zones that the batch refresh has written, as a dashboard reads them.
SERVED = ["summary_for_year", "prior_year_summary", "sector_top10", "facility_top10", "hr_yoy"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session()
    qs = registry.queries()
    names = [n for n in HEADLINE if n in qs or n == "bm25_index"]
    if os.environ.get("BENCH_ALL"):
        names = list(qs)
    times: dict[str, float] = {}
    # warm-up: JVM, parquet footers
    run(qs["energy_clean"](spark, sf_dir))
    for n in names:
        t0 = time.time()
        if n == "bm25_index":  # the stored index that the retrieval queries read
            docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
            retrieval.write_index(docs, retrieval.index_path(docs))
        else:
            run(qs[n](spark, sf_dir))
        times[n] = round(time.time() - t0, 3)
    # the shared folder named by spark.checkpoint.dir (a fresh /tmp folder only when unset)
    root = f"{shared_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex}"
    t0 = time.time()
    res = batch.refresh(spark, sf_dir, root)
    times["batch_refresh"] = round(time.time() - t0, 3)
    spark.conf.set(catalog_core.ZONES, root)
    for n in SERVED:
        t0 = time.time()
        run(qs[n](spark, sf_dir))
        times[f"served_{n}"] = round(time.time() - t0, 3)
    spark.conf.unset(catalog_core.ZONES)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                      "batch_stage_seconds": {k: round(v, 3) for k, v in res["seconds"].items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
