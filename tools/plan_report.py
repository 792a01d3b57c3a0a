"""Summarise the physical plans of the registered queries (after execution, AQE final plans).

usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verdigris.plans import registry  # noqa: E402
from verdigris.session import get_session  # noqa: E402

HEADLINE = ["ghg_scope1", "ghg_scope2", "ghg_scope3_financed", "ghg_summary_annual", "pcaf_by_sector",
            "scope1_top_facilities", "gates_agg", "dq_ranges", "sector_top10", "audit_outcome",
            "doc_prohibited_hits", "bm25_top5", "retrieval_with_fallback", "vector_top5", "score_what_if", "indicator_table"]


def shape(plan: str) -> dict:
    count = lambda pat: len(re.findall(pat, plan))
    return {
        "shuffles": count(r"\bExchange hashpartitioning|\bExchange rangepartitioning|\bExchange SinglePartition"),
        "broadcast joins": count(r"BroadcastHashJoin"),
        "sort-merge joins": count(r"SortMergeJoin"),
        "shuffled hash joins": count(r"ShuffledHashJoin"),
        "reused exchanges": count(r"ReusedExchange"),
        "partial top-k": count(r"WindowGroupLimit"),
        "take-ordered": count(r"TakeOrderedAndProject"),
        "scans": count(r"Scan parquet|FileScan parquet"),
        "python udf": count(r"BatchEvalPython|ArrowEvalPython"),
        "cartesian/NLJ": count(r"CartesianProduct|BroadcastNestedLoopJoin"),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session()
    qs = registry.queries()
    cols = list(shape("").keys())
    print(f"# Physical plan shapes ({os.path.basename(sf_dir)}, AQE final plans)\n")
    print("Generated by `tools/plan_report.py` after running each query through the noop sink.\n")
    print("| query | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for n in HEADLINE:
        df = qs[n](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        s = shape(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {n} | " + " | ".join(str(s[c]) for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
