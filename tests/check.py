"""Compare registered queries with their check statements: python tests/check.py [sf] [key ...]"""

import os
import sys
import time
import traceback

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from harness import compare, connect  # noqa: E402
from session import local_session  # noqa: E402

import __spark_entry__ as e  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = sys.argv[2:]
    sf_dir = sf if sf.startswith("/") else f"/root/testdata/sf{sf}"
    spark, con = local_session(), connect(sf_dir)
    queries, oracle = e.queries(), e.oracle_sql()
    bad = 0
    for key, fn in queries.items():
        if only and not any(key == o or (o.endswith("*") and key.startswith(o[:-1])) for o in only):
            continue
        t, planned, spent = time.time(), 0.0, 0.0
        try:
            df = fn(spark, sf_dir)
            planned = time.time() - t
            df.write.format("noop").mode("overwrite").save()
            spent = time.time() - t
            if key in oracle:
                result = compare(df, con, oracle[key])
            else:
                result = None if df.collect() else "no rows"
            kind = "sql" if key in oracle else "rows"
        except Exception as ex:  # report and go on with the next query
            result, kind = f"{type(ex).__name__}: {str(ex)[:600]}", "error"
            if only:
                traceback.print_exc()
        bad += result is not None
        print(f"{'FAIL' if result else 'ok  '} {kind:5} {planned:6.2f} {spent:6.2f}s {key} {result or ''}",
              flush=True)
    for key in set(oracle) - set(queries):
        bad += 1
        print("FAIL no query for", key)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
