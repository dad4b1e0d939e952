"""Check all registered queries against their SQL: ``python tests/check_queries.py sf_dir [name ...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from hourcast.session import local_session  # noqa: E402


def main() -> int:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(8), connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        start = time.monotonic()
        try:
            if name in sql:
                problems = compare(spark, con, queries[name], sql[name], sf_dir)
            else:
                problems = [] if queries[name](spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:1200]}"]
        bad += bool(problems)
        mark = "FAIL" if problems else "ok  " if name in sql else "rows"
        print(f"{mark} {name} {time.monotonic() - start:.2f}s {' | '.join(problems)}", flush=True)
    print(f"{bad} of {len(names or queries)} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
