"""Run registered queries against their SQL twins: python tests/run_catalog.py [folder] [name-prefix ...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.oracle import connect, difference, spark_rows  # noqa: E402
from tidemark.catalog.library import ENTRIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("catalog", 8)
    con = connect(folder)
    failed, slow = [], []
    for name, entry in ENTRIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = entry.run(spark, folder)
            if entry.sql is None:
                names, rows = spark_rows(df)
                problem, note = None, f"rows-only {len(rows)}"
            else:
                problem, note = difference(df, con, entry.sql), "match"
        except Exception as error:  # noqa: BLE001
            text = str(error) if os.environ.get("TRACE") is None else traceback.format_exc()
            problem = f"{type(error).__name__}: {text[:700]}"
        took = time.time() - start
        slow.append((took, name))
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.2f}s {problem or note}", flush=True)
        if problem:
            failed.append(name)
    print(len(slow), "queries,", len(failed), "failed:", failed)
    print("slowest:", [(n, round(t, 1)) for t, n in sorted(slow, reverse=True)[:12]])


if __name__ == "__main__":
    main()
