"""Write PLANS.md: the physical plan of every benchmarked operator over the
stored tables (sf given as argument, default sf0.1), with each scan's pushed
and partition filters.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from bench import build_plans
    from tallyspark.session import local_session
    spark = local_session(8, shuffle_partitions=16, app_name="tallyspark-plans")
    root = tempfile.mkdtemp(prefix="tallyspark-plans-", dir=os.environ.get("TMPDIR", "/tmp"))
    _, plans = build_plans(spark, sf_dir, root)
    notes_path = os.path.join(HERE, "tools", "scale_notes.md")
    notes = open(notes_path).read().splitlines() if os.path.exists(notes_path) else []
    out = ["# Physical plans", ""] + notes + ["## Plans at sf0.1", "",
           f"Generated by `tools/plan_report.py` on `{sf_dir}` over the stored tables "
           "(sales partitioned by month, tables clustered by key), Spark "
           f"{spark.version}, AQE on. Each plan is the final adaptive plan after one run "
           "(so broadcasts chosen at run time from measured sizes show as such). Scan "
           "lines list what reached the Parquet reader.", ""]
    for name, build in plans.items():
        df = build()
        # Run this very DataFrame (a local tool: results are small here), so
        # explain() then shows the final adaptive plan.
        df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("formatted")
        text = buf.getvalue()
        tree = text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")
        scans = []
        for block in text.split("\n\n"):
            if re.match(r"^\(\d+\) Scan parquet", block.strip()):
                keep = [ln for ln in block.strip().splitlines()
                        if ln.startswith(("(", "PushedFilters", "PartitionFilters", "ReadSchema"))]
                scans.append("\n".join(keep))
        out += [f"## {name}", "", "```", tree.strip(), "```", ""]
        if scans:
            out += ["```", "\n\n".join(scans), "```", ""]
    with open(os.path.join(HERE, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
