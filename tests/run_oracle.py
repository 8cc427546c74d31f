"""Compare every registered query with its oracle at one scale factor.

usage: python tests/run_oracle.py [sf_dir] [name ...]
"""

import sys
import time

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

from oracle_harness import compare, duck  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from dispatchlens.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
names = sys.argv[2:]
spark = local_session(8)
con = duck(sf)
qs, orc = E.queries(), E.oracle_sql()
bad = 0
for name, fn in qs.items():
    if names and name not in names:
        continue
    t = time.time()
    try:
        df = fn(spark, sf)
        if name in orc:
            probs = compare(df, con, orc[name])
            status = "OK " if not probs else "BAD"
            bad += bool(probs)
        else:
            n = df.count()
            probs, status = [f"rows={n}"], "ROW"
    except Exception as e:  # noqa: BLE001
        probs, status = [repr(e)[:800]], "ERR"
        bad += 1
    print(f"{status} {name:32s} {time.time() - t:6.1f}s {' | '.join(probs)[:1500]}", flush=True)
print("failures:", bad)
