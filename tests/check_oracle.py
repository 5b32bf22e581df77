"""Compares registered queries with their oracle: ``check_oracle.py SF_DIR [NAME_PREFIX...]``."""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from booklog.session import local_session  # noqa: E402
from tests.comparison import differences, oracle_connection  # noqa: E402


def main(sf_dir: str, *prefixes: str) -> int:
    spark = local_session("booklog-oracle-check")
    oracles, connection, failed = entry.oracle_sql(), oracle_connection(sf_dir), 0
    unknown = set(oracles) - set(entry.queries())
    assert not unknown, unknown
    for name, build in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.perf_counter()
        try:
            df = build(spark, sf_dir)
            if name in oracles:
                problem = differences(df, connection, oracles[name])
                verdict = "ok" if problem is None else f"DIFFERS {problem[:1500]}"
            else:
                problem, verdict = None, f"rows only ({df.count()})"
        except Exception as error:  # report every query before failing
            problem, verdict = error, f"ERROR {str(error)[:1500]}"
        failed += problem is not None
        print(f"{time.perf_counter() - started:6.2f}s {name}: {verdict}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
