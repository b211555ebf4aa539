"""Command-line check: python tests/check.py [name-prefix ...] [--sf 0.01]."""

import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tidemark.session import get_session  # noqa: E402


def main(args: list[str]) -> None:
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at:at + 2]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session(master="local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8",
                        spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(spark, con, sf_dir, fn, sqls[name])
            else:
                frame = fn(spark, sf_dir)
                problem = None if frame.count() else "no rows"
        except Exception as exc:  # report and go on with the next query
            problem = "".join(traceback.format_exception_only(exc))[:1500]
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s "
              f"{'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
