"""python tests/check_queries.py [sf] [name-part ...]: compare registered queries with their SQL."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import difference, duck  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from mnemoframe.plans.session import local_session  # noqa: E402


def main() -> None:
    folder = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    parts = sys.argv[2:]
    spark = local_session(8)
    con = duck(folder)
    queries, checks = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in checks:
                text = difference(df, con, checks[name])
            else:
                text = "" if df.count() else "EMPTY"
        except Exception as e:  # report and go on with the next query
            text = "ERROR " + str(e).split("JVM stacktrace")[0][:1500]
        bad += bool(text)
        print(f"{'ok  ' if not text else 'BAD '} {name} {time.time() - start:.1f}s {text}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
