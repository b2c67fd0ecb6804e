"""Run registered queries against their SQL: ``check.py [sf] [name …]``."""

import sys
import time

from litspark.queries import ORACLE, QUERIES
from litspark.session import build_session
from tests.oracle import connect, difference

if __name__ == "__main__":
    sf, *names = sys.argv[1:] or ["0.001"]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            result = difference(df, con, ORACLE[name]) if name in ORACLE else f"rows only: {df.count()}"
        except Exception as error:
            result = "ERROR " + str(error)[:1500]
        ok = result is None or result.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {'' if result is None else result[:1500]}", flush=True)
    print("bad:", bad)
    sys.exit(bool(bad))
