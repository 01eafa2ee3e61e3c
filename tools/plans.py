"""List physical-plan nodes that do not scale: ``python tools/plans.py sf_dir [prefix ...]``."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from contrasieve import plans  # noqa: E402
from contrasieve.session import build_session  # noqa: E402

WATCH = ("CartesianProduct", "BroadcastNestedLoopJoin", "Exchange SinglePartition", "BatchEvalPython")


def main() -> None:
    spark = build_session("plans", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in plans.load().items():
        if len(sys.argv) > 2 and not name.startswith(tuple(sys.argv[2:])):
            continue
        plan = fn(spark, sys.argv[1])._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("Subqueries")[0]
        found = {w: len(re.findall(w, plan)) for w in WATCH if w in plan}
        if found:
            print("plan", name, found, flush=True)


if __name__ == "__main__":
    main()
