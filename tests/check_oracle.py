"""Compare every registered query with its SQL: python tests/check_oracle.py [sf_dir] [name...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from ledgerline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return str(v)

    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = build_session(
        "check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles, bad = oracle_sql(), 0
    for name, run in queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            df = run(spark, sf_dir)
            columns, ours = rows_of(df.columns, [tuple(x) for x in df.collect()])
            took = time.time() - began
            if name not in oracles:
                print(f"ROWS  {name}: {len(ours)} rows, {took:.1f}s", flush=True)
                continue
            cur = con.execute(oracles[name])
            theirs_columns, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
            if columns != theirs_columns or ours != theirs:
                bad += 1
                print(f"DIFF  {name}: {len(ours)} vs {len(theirs)} rows, {took:.1f}s", flush=True)
                if columns != theirs_columns:
                    print("   ", columns, theirs_columns)
                else:
                    print("   ", columns)
                    print("    ours  ", list(sorted(set(ours) - set(theirs)))[:3])
                    print("    theirs", list(sorted(set(theirs) - set(ours)))[:3])
            else:
                print(f"OK    {name}: {len(ours)} rows, {took:.1f}s", flush=True)
        except Exception as problem:
            bad += 1
            print(f"FAIL  {name}: {type(problem).__name__} {str(problem)[:1500]}", flush=True)
            if names:
                traceback.print_exc()
    print("mismatches:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
