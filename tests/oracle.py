"""Side-by-side run of a query and its SQL twin. ``python tests/oracle.py [name ...]`` prints a report."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return ("f", round(value, 6) + 0.0)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    return value if value is None or isinstance(value, str) else str(value)


def rows_of(names: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when names and rows agree, else what differs."""
    names, ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    theirs_names, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if names != theirs_names:
        return f"columns {names} != {theirs_names}"
    if ours == theirs:
        return None
    extra, lost = ours - theirs, theirs - ours
    def key(item):
        return str(item[0])
    return (
        f"rows {sum(ours.values())} / {sum(theirs.values())}, only ours {sum(extra.values())}: "
        f"{sorted(extra.items(), key=key)[:2]}, only oracle {sum(lost.values())}: {sorted(lost.items(), key=key)[:2]}"
    )


def main(names: list[str], sf_dir: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as entry
    from reqlens.session import build_session

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
                           "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            verdict = compare(df, con, sqls[name]) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as exc:
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {verdict or ''}"[:1500], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
