"""Compare named queries (all by default) with their SQL twins: python tests/check.py [sf] [names...]"""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402
from wattloom.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
names = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf_dir)
oracles = entry.oracle_sql()
failed = 0
for name, fn in entry.queries().items():
    if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
        continue
    t0 = time.time()
    try:
        df = fn(spark, sf_dir)
        if name in oracles:
            verdict = compare(df, con, oracles[name])
        else:
            n = len(df.collect())
            verdict = None if n else "no rows"
            name += " (rows only)"
    except Exception as e:  # report and go on
        verdict = "ERROR " + (str(e)[:1500] if os.environ.get("FULL") else str(e).split("JVM stacktrace")[0][:700])
        if os.environ.get("FULL"):
            traceback.print_exc()
    failed += verdict is not None
    print(f"{'ok  ' if verdict is None else 'FAIL'} {name:28s} {time.time() - t0:5.1f}s {verdict or ''}", flush=True)
print(f"{failed} failed")
