"""Run registered queries against their check SQL: python tests/run_checks.py [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tests.oracle import compare, connect  # noqa: E402

from ratewell.session import local_session  # noqa: E402


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    folder = os.environ.get("CHECK_SF", "/root/testdata/sf0.01")
    spark = local_session(cores=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    wanted = sys.argv[1:]
    failed = 0
    for name, build in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = build(spark, folder)
            sql = oracle_sql().get(name)
            problems = compare(df, con, sql) if sql else [] if df.count() else ["no rows"]
        except Exception as e:  # noqa: BLE001
            problems = [f"{type(e).__name__}: {str(e)[:700]}"]
        took = time.time() - start
        print(f"{'ok  ' if not problems else 'FAIL'} {name} {took:.1f}s", flush=True)
        for p in problems:
            print("     ", p, flush=True)
        failed += bool(problems)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
