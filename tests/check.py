"""Compare registered queries with their SQL on one folder of tables.

python tests/check.py [folder] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str, folder: str) -> str:
    """Empty when both sides agree, otherwise what differs."""
    df = fn(spark, folder)
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = canonical(cursor.fetchall(), names)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if mine != theirs:
        a, b = set(mine), set(theirs)
        return (f"rows {len(mine)} vs {len(theirs)}; only here {sorted(a - b)[:2]}; "
                f"only expected {sorted(b - a)[:2]}")
    return "" if mine else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from millrace.session import build

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(folder), entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        started = time.time()
        try:
            out = compare(spark, con, fn, sqls[name], folder) if name in sqls else \
                f"(no SQL) {fn(spark, folder).count()} rows"
        except Exception as e:  # noqa: BLE001 - report and go on
            out = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(out) and not out.startswith("(no SQL)")
        print(f"{name:32s} {time.time() - started:6.2f}s {out or 'ok'}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
