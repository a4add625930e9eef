"""Run queries and their SQL twins side by side: python -m tests.compare [sf] [name ...]."""

from __future__ import annotations

import math
import sys


def table(rows: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v + 0.0, 6) or 0.0
        return float(v) if v.__class__.__name__ == "Decimal" else v

    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(a: list[tuple], b: list[tuple], tolerance: float = 2e-6) -> str:
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            close = isinstance(u, int | float) and isinstance(v, int | float) and not isinstance(u, bool) and abs(u - v) <= tolerance * max(1, abs(v))
            if u != v and not close:
                return f"{x} against {y}"
    return ""


def main(sf: str, only: list[str]) -> int:
    import time

    import duckdb

    import __spark_entry__ as entry
    from haplomesh.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    base, bad = f"/root/testdata/{sf}", 0
    for name, f in entry.queries().items():
        sql = entry.oracle_sql().get(name)
        if only and name not in only or sql is None and not only:
            continue
        began = time.time()
        try:
            df = f(spark, base)
            mine = table([tuple(r) for r in df.collect()], df.columns)
            con = duckdb.connect()
            for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
                con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{base}/{t}.parquet')")
            if sql is None:
                print(f"rows {name} {len(mine)} {time.time() - began:.1f}s")
                continue
            res = con.sql(sql)
            theirs = table(res.fetchall(), res.columns)
            why = ("columns" if sorted(res.columns) != sorted(df.columns) else "") or same(mine, theirs)
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:300]}"
            mine = []
        bad += bool(why)
        print("FAIL" if why else "ok  ", name, len(mine), f"{time.time() - began:.1f}s", why[:400], flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "sf0.001", sys.argv[2:]))
