"""Run queries against their checking SQL: ``check_queries.py [sf_dir] [name-prefix ...]``."""

from __future__ import annotations

import importlib
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from originlens.plans import check, registry
from originlens.session import build_session


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    modules = sorted(p.stem for p in (Path(registry.__file__).parent).glob("q_*.py"))
    for m in modules:
        importlib.import_module(f"originlens.plans.{m}")
    spark = build_session("check", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con = check.connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            if name in registry.ORACLES:
                problems = check.compare(df, con, registry.ORACLES[name])
                state = "same" if not problems else "DIFF"
            else:
                problems, state = [], f"rows {df.count()}"
        except Exception as e:  # report and go on with the next query
            problems, state = [repr(e)[:1500]], "FAIL"
            if len(prefixes) == 1:
                traceback.print_exc()
        bad += state in ("DIFF", "FAIL")
        print(f"{name:34s} {state:12s} {time.time() - start:6.2f}s", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
