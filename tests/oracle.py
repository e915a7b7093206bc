"""Run queries on Spark and their SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return f"{type(v).__name__}:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    left, lcols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    right, rcols = rows_of([d[0] for d in rel.description], rel.fetchall())
    if lcols != rcols:
        return f"columns {lcols} != {rcols}"
    if left != right:
        a, b = [x for x in left if x not in set(right)][:3], [x for x in right if x not in set(left)][:3]
        return f"rows {len(left)} / {len(right)}; only spark {a}; only sql {b}"
    return None if left else "EMPTY"


def main(sf: str, names: list[str]) -> None:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e
    from clipledger.session import get_session

    spark = get_session(master="local[8]", shuffle_partitions=8, **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sqls = connect(sf), e.queries(), e.oracle_sql()
    for name, q in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            if name in sqls:
                out = compare(spark, con, q, sqls[name], sf)
            else:
                out = f"no SQL, rows {q(spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            out = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name:32s} {time.time() - t:6.2f}s  {out or 'ok'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
