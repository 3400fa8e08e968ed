"""Compare registered queries with their twins: python -m tests.check [sf] [name part ...]"""

import sys
import time

from buylens.plans.registry import queries
from buylens.session import local_session
from oracle.registry import oracle_sql
from tests.compare import compare, connect


def main(sf: str, parts: list[str]) -> int:
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con, twins, bad = local_session(8), connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            note = compare(df, con, twins[name]) if name in twins else f"no twin, {df.count()} rows"
        except Exception as error:  # report and go on with the next query
            text = str(error)
            cause = text.rfind("Caused by")
            note = f"ERROR {type(error).__name__} {text[:500]} ... {text[cause:cause + 600] if cause > 0 else ''}"
        bad += bool(note) and not str(note).startswith("no twin")
        print(f"{'ok  ' if not note else '    '}{name} {time.time() - start:.1f}s {note or ''}", flush=True)
    print("differences:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "0.001", sys.argv[2:]) > 0)
