"""Runs registered queries beside their SQL in DuckDB and compares rows as multisets.

``python tests/oracle.py [folder] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return str(v)


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    names = sorted(df.columns)
    left = [tuple(cell(x) for x in r) for r in df.select(*names).collect()]
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    rows = rel.fetchall()
    if sorted(cols) != names:
        return f"columns differ: spark {names} / sql {sorted(cols)}"
    pick = [cols.index(n) for n in names]
    right = [tuple(cell(r[i]) for i in pick) for r in rows]
    kinds = dict(zip(cols, [str(d[1]) for d in rel.description], strict=True))
    odd = [n for n, k in kinds.items() if k.upper() in ("HUGEINT", "UHUGEINT") or k.upper().startswith("DECIMAL")]
    if odd:
        return f"sql types to cast: {odd}"
    a, b = Counter(left), Counter(right)
    if a != b:
        return (f"rows differ: spark {len(left)} / sql {len(right)}; columns {names}; "
                f"only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}")
    return ""


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for name in chosen:
        t = time.time()
        try:
            if name in sqls:
                verdict = compare(spark, con, queries[name], sqls[name], folder)
                n = ""
            else:
                n, verdict = f" rows={queries[name](spark, folder).count()} (no sql)", ""
        except Exception as e:  # report and go on with the next query
            n, verdict = "", f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(verdict)
        print(f"{'ok ' if not verdict else 'BAD'} {name} {time.time() - t:.2f}s{n} {verdict}", flush=True)
    print(f"{len(chosen)} queries, {bad} bad")
    spark.stop()
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
