"""Summarise the physical plans of the headline queries (cluster shape).

Scans appear as they do on many-split
inputs, then records per query: exchanges, broadcast joins, sort-merge joins,
Python (Arrow) evaluations, whole-stage-codegen spans, and each parquet scan's
ReadSchema / PushedFilters. Writes docs/PLANS.md.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from tidecorpus.plans.registry import load_all  # noqa: E402
from tidecorpus.session import local_session  # noqa: E402

EXTRA = ["e5_token_to_id", "e15_batches_across_files", "a2_mean_std", "j2_unnest_comments", "t15_normalise_deacc", "e4_bpe_encode"]


def summarise(name: str, plan: str) -> list[str]:
    phys = plan.split("\n\n")[0]
    if "== Final Plan ==" in phys:
        phys = phys.split("== Initial Plan ==")[0]
    count = lambda pat: len(re.findall(pat, phys))
    lines = [f"### {name}", ""]
    ex, reused = count(r"\bExchange \("), count(r"ReusedExchange")
    bhj, smj = count(r"BroadcastHashJoin"), count(r"SortMergeJoin")
    py, cg = count(r"ArrowEvalPython|BatchEvalPython|MapInPandas"), count(r"\* ")
    lines.append(
        f"- exchanges: {ex} (reused: {reused}), broadcast joins: {bhj}, sort-merge joins: {smj}, "
        f"Python evals: {py}, operators in whole-stage codegen: {cg}"
    )
    for m in re.finditer(r"\(\d+\) Scan parquet[^\n]*\n(?:[^\n]+\n)*?(?=\n)", plan):
        block = m.group(0)
        loc = re.search(r"Location: \w+ \[([^\]]+)\]", block)
        rs = re.search(r"ReadSchema: ([^\n]+)", block)
        pf = re.search(r"PushedFilters: ([^\n]+)", block)
        lines.append(
            f"- scan `{os.path.basename(loc.group(1)) if loc else '?'}`: ReadSchema `{rs.group(1) if rs else '-'}`"
            + (f", PushedFilters `{pf.group(1)}`" if pf else "")
        )
    lines.append("")
    return lines


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 16)
    reg = load_all()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/explain_plans.py` on `{sf_dir}`; counts are taken from the final adaptive plan after the query ran.", ""]
    for name in HEADLINE + EXTRA:
        df = reg[name].fn(spark, sf_dir)
        df.collect()  # run it, so the adaptive plan shown is the final one
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        out.extend(summarise(name, plan))
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as f:
        f.write("\n".join(out))
    print("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
