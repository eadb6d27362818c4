"""Summarise the physical plan of every query of the library's own as it would run at scale.

Size-based broadcasts are switched off (as for fact tables of billions of rows), so the
plans show where data is shuffled; explicit broadcasts of bounded sides stay.  Each query
is executed once so that the counts come from the final adaptive plan, where repeated
subplans appear as reused exchanges.  Writes a markdown table to stdout.  Usage: python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = [
    ("hash exch", r"Exchange hashpartitioning"),
    ("range exch", r"Exchange rangepartitioning"),
    ("single exch", r"Exchange SinglePartition"),
    ("bcast", r"BroadcastExchange"),
    ("SMJ", r"SortMergeJoin"),
    ("BHJ", r"BroadcastHashJoin"),
    ("top-k", r"TakeOrderedAndProject"),
    ("agg", r"(?:HashAggregate|SortAggregate|ObjectHashAggregate)\("),
    ("reused exch", r"ReusedExchange"),
    ("window", r"\bWindow\b"),
    ("python", r"(?:BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas)"),
]


def main() -> None:
    from callqc.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, 8, app="callqc-plans")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    from callqc import registry

    print("| query | " + " | ".join(n for n, _ in NODES) + " |")
    print("| --- |" + " --- |" * len(NODES))
    for key, fn in registry.queries().items():
        df = fn(spark, sf)
        df.collect()  # run this plan object: its final adaptive plan shows the reuse
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain("simple")
        text = buf.getvalue().split("== Initial Plan ==")[0]
        counts = [len(re.findall(rx, text)) for _, rx in NODES]
        print(f"| {key} | " + " | ".join(str(c) for c in counts) + " |")


if __name__ == "__main__":
    main()
