"""Run a registered query in Spark and its oracle SQL in DuckDB on the same
parquet tables; compare row count, column names and an order-insensitive
hash of the values (doubles rounded to 6 decimals).  Strict mode also
requires the same kind of number (integer vs floating) per column.

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time
from decimal import Decimal

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return ("f", round(v, 6) + 0.0)
    if isinstance(v, Decimal):
        return ("f", round(float(v), 6) + 0.0)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, int):
        return ("i", v)
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return ("s", str(v))


def _loose(v):
    if isinstance(v, tuple) and len(v) == 2 and v[0] in ("i", "f"):
        return ("n", float(v[1]))
    if isinstance(v, tuple) and len(v) == 2 and v[0] == "l":
        return ("l", tuple(_loose(x) for x in v[1]))
    return v


def _digest(rows):
    keys = sorted(repr(r) for r in rows)
    h = hashlib.sha256()
    for k in keys:
        h.update(k.encode())
    return h.hexdigest()


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(_norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    data = cur.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    cols = [names[i] for i in order]
    rows = [tuple(_norm(r[i]) for i in order) for r in data]
    return cols, rows


def duck_connection(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, query, sql, sf_dir):
    out = {"name": name}
    t0 = time.time()
    s_cols, s_rows = spark_rows(query(spark, sf_dir))
    out["spark_sec"] = round(time.time() - t0, 2)
    out["rows"] = len(s_rows)
    if sql is None:
        out["status"] = "rows-only"
        return out
    t0 = time.time()
    d_cols, d_rows = duck_rows(con, sql)
    out["duck_sec"] = round(time.time() - t0, 2)
    out["duck_rows"] = len(d_rows)
    out["cols_equal"] = s_cols == d_cols
    out["strict"] = _digest(s_rows) == _digest(d_rows)
    out["loose"] = _digest([tuple(_loose(v) for v in r) for r in s_rows]) == \
        _digest([tuple(_loose(v) for v in r) for r in d_rows])
    ok = out["cols_equal"] and out["strict"] and len(s_rows) == len(d_rows)
    out["status"] = "match" if ok else "MISMATCH"
    if not ok:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
        sset, dset = set(map(repr, s_rows)), set(map(repr, d_rows))
        out["only_spark"] = sorted(sset - dset)[:3]
        out["only_duck"] = sorted(dset - sset)[:3]
    return out


def main(argv):
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry
    from precis.session import local_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:]
    spark = local_session(8)
    con = duck_connection(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            res = compare(spark, con, name, q, oracle.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            res = {"name": name, "status": "ERROR", "error": f"{type(exc).__name__}: {str(exc)[:600]}"}
        if res["status"] not in ("match", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"done: {bad} not matching", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
