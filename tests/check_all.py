"""Command line check: python tests/check_all.py <sf_dir> [key prefix ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from trajgraph.catalog import load  # noqa: E402
from trajgraph.session import build_session  # noqa: E402


def main():
    sf_dir = sys.argv[1]
    prefixes = sys.argv[2:]
    spark = build_session("check", cores=8)
    con = connect(sf_dir)
    bad = 0
    for key, item in load().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            df = item.run(spark, sf_dir)
            if item.sql:
                ok, note = compare(df, item.sql, con)
            else:
                ok, note = True, f"{len(df.collect())} rows, no SQL"
        except Exception as e:  # report and go on with the next key
            ok, note = False, "".join(traceback.format_exception_only(e))[:900]
        bad += not ok
        if not ok or "-v" in os.environ.get("CHECK", "") or time.time() - start > 4 or note.startswith("0 rows"):
            print(f"{'ok  ' if ok else 'FAIL'} {key} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{bad} failed")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
