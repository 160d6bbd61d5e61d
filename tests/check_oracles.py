"""Run registered queries against their SQL twins: ``python tests/check_oracles.py sf_dir [name ...]``."""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from compare import connect, fingerprint  # noqa: E402

from emberframe.catalog import load_all  # noqa: E402
from emberframe.session import build_session  # noqa: E402


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = load_all()
    spark = build_session(**{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name, fn in queries.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            t = time.time()
            got = fn(spark, sf_dir).toPandas()
            spent = time.time() - t
            if name not in oracles:
                print(f"rows  {name} n={len(got)} {spent:.1f}s", flush=True)
                continue
            t = time.time()
            want = con.execute(oracles[name]).df()
            a, b = fingerprint(got), fingerprint(want)
            ok = a == b
            bad += not ok
            print(f"{'ok   ' if ok else 'FAIL '} {name} n={a[0]}/{b[0]} {spent:.1f}s sql={time.time() - t:.1f}s", flush=True)
            if not ok:
                print("   ", a[1], "\n   ", b[1])
                cols = sorted(got.columns)
                if cols == sorted(want.columns):
                    x = set(map(repr, got[cols].astype(object).itertuples(index=False, name=None)))
                    y = set(map(repr, want[cols].astype(object).itertuples(index=False, name=None)))
                    print("   spark only", len(x - y), sorted(x - y)[:3], "\n   sql only", len(y - x), sorted(y - x)[:3])
        except Exception as e:  # report and go on
            bad += 1
            print(f"ERROR {name}: {type(e).__name__} {str(e)[:1500]}", flush=True)
    print("bad:", bad)
    spark.stop()


main()
