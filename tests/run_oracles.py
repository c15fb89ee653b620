"""Compare registered queries with their SQL: `python tests/run_oracles.py 0.01 [name ...]`."""
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from tests.oracle_check import connect, differences  # noqa: E402
from textroute.session import build_session  # noqa: E402
import __spark_entry__ as entry  # noqa: E402


def main() -> int:
    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles, bad = connect(sf_dir), entry.queries(), entry.oracle_sql(), []
    for name, fn in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            if name in oracles:
                out = differences(fn(spark, sf_dir), con, oracles[name])
            else:
                out = []
                print(f"  rows only: {fn(spark, sf_dir).count()}")
        except Exception as e:
            out = [str(e)[:1500]]
            if names:
                traceback.print_exc()
        print(f"{'ok  ' if not out else 'FAIL'} {name} {time.time() - start:.1f}s", *out, flush=True)
        bad += [name] if out else []
    print(len(bad), "failed:", bad)
    return len(bad)


if __name__ == "__main__":
    sys.exit(main())
