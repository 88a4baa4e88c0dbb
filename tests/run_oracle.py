"""``python tests/run_oracle.py [sf_dir] [name ...]``: compare registered queries with their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import oracle  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from veilwright.session import build_session  # noqa: E402

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = build_session(
    "oracle", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
    spark__driver__memory="8g",
)
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(sf_dir)
queries, sql = entry.queries(), entry.oracle_sql()
bad = 0
for name, fn in queries.items():
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in sql:
            problem = oracle.difference(df, con, sql[name])
            state = "ok" if problem is None else f"DIFFERENT {problem}"
        else:
            state = f"rows only: {len(df.collect())}"
    except Exception as error:  # report and go on with the other queries
        state = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
    bad += state.startswith(("DIFF", "FAIL"))
    print(f"{name:32s} {time.time() - start:6.2f}s  {state}", flush=True)
print("problems:", bad)
