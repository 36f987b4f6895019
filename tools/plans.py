"""Write PLANS.md: the physical plan tree, pushed filters and read schemas of key queries.

Usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import io
import os
import sys
from contextlib import redirect_stdout

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from almanac import catalog  # noqa: E402
from almanac.session import local_session  # noqa: E402

KEY = ["q_date_range_filter", "q_lags", "q_lags_global", "q_lags_global_blocked", "q_ffill_global_blocked",
       "q_lags_hot_key", "q_fill_group_mean", "q_engineer_features", "q_standardize_panel", "q_corr_matrix",
       "q_linear_fit_panel", "q_boxplot_year", "q_kde", "q_decompose_additive"]


def plan_text(df) -> str:
    buf = io.StringIO()
    with redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree, _, details = text.partition("\n\n\n")
    keep = [ln.strip() for ln in details.splitlines() if ln.strip().startswith(("PushedFilters", "ReadSchema"))]
    exchanges = []
    for block in details.split("\n\n"):
        lines = [ln.strip() for ln in block.strip().splitlines()]
        if lines and " Exchange" in lines[0] and "Broadcast" not in lines[0]:
            args = next((ln for ln in lines if ln.startswith("Arguments:")), "")
            exchanges.append(f"{lines[0]}: {args.replace('Arguments: ', '').split(', ENSURE')[0]}")
    return tree.strip() + "\n\n" + "\n".join(exchanges + sorted(set(keep)))


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    out = ["# Physical plans of key queries", "",
           f"Generated by `python tools/plans.py {sf}` (`explain('formatted')`, adaptive plans before execution; "
           "AQE may still turn a shuffle join into a broadcast join at run time).", ""]
    for name in KEY:
        df = catalog.QUERIES[name](spark, sf)
        out += [f"## {name}", "", "```", plan_text(df), "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
