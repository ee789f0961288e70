"""Run queries() against oracle_sql() on one scale factor and report matches.

    python tests/oracle_check.py [sf_dir] [name ...]

Mirrors the verification the driver performs: row count, column names and
types, and an order-insensitive comparison of values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
    "float": "FLOAT", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "array<double>": "DOUBLE[]", "array<string>": "VARCHAR[]", "array<bigint>": "BIGINT[]",
}


def duck_conn(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute(f"SET temp_directory = '{tempfile.mkdtemp(prefix='oracle-')}'; SET max_temp_directory_size = '4GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(round(v, 9))          # by representation: -0.0 is not 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, sf_dir, name, qfn, sql):
    t0 = time.time()
    sdf = qfn(spark, sf_dir)
    scols = sdf.columns
    stypes = [f.dataType.simpleString() for f in sdf.schema.fields]
    srows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(ts, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    dtypes = [str(d[1]) for d in rel.description]
    res["oracle_rows"] = len(drows)
    problems = []
    if sorted(scols) != sorted(dcols):
        problems.append(f"columns spark={sorted(scols)} oracle={sorted(dcols)}")
    else:
        dmap = dict(zip(dcols, dtypes))
        for c, t in zip(scols, stypes):
            want = SPARK_TO_DUCK.get(t, t)
            if want != dmap[c]:
                problems.append(f"type {c}: spark={t} oracle={dmap[c]}")
    if len(srows) != len(drows):
        problems.append("row count")
    if not problems or all(p.startswith("type") for p in problems):
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        if a != b:
            diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
            problems.append(f"values differ e.g. {diff}")
    res["status"] = "ok" if not problems else "FAIL"
    res["problems"] = problems
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    import __spark_entry__ as entry
    from pulso.session import build_session
    spark = build_session()
    con = duck_conn(sf_dir)
    qs, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        try:
            r = compare(spark, con, sf_dir, name, fn, oracle.get(name))
        except Exception as exc:  # report and go on
            r = {"name": name, "status": "ERROR", "problems": [f"{type(exc).__name__}: {str(exc)[:1500]}"]}
        bad += r["status"] in ("FAIL", "ERROR")
        print(r, flush=True)
    print(f"{bad} failing of {len([n for n in qs if not only or n in only])}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
