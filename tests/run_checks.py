"""Run registered queries against their checking SQL: python -m tests.run_checks [sf] [names or prefix*]."""

from __future__ import annotations

import sys
import traceback

from scholia import plans
from scholia.plans.registry import ORACLES, QUERIES
from scholia.session import local_session
from tests.checking import compare, connect


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    plans.load()
    names = [n for n in QUERIES if not sys.argv[2:] or n in sys.argv[2:]]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = connect(folder)
    bad = 0
    for name in names:
        try:
            if name in ORACLES:
                ok, why, n, a, b = compare(spark, QUERIES[name], ORACLES[name], folder, con)
            else:
                import time

                t0 = time.time()
                n = QUERIES[name](spark, folder).count()
                ok, why, a, b = True, "no oracle", time.time() - t0, 0.0
        except Exception as exc:  # noqa: BLE001
            ok, why, n, a, b = False, f"{type(exc).__name__}: {str(exc)[:700]}", -1, 0.0, 0.0
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:32s} rows={n:<8d} spark={a:6.2f}s duck={b:6.2f}s {why}", flush=True)
    print(f"{len(names) - bad}/{len(names)} fine", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
