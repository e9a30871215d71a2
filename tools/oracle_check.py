"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Mirrors the driver's check: row count, column names, order-insensitive value
hash (columns sorted by name; floats rounded). Usage:

    python tools/oracle_check.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidecorpus.plans.registry import load_all  # noqa: E402
from tidecorpus.session import TABLES, local_session  # noqa: E402


def _norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, bool):
        return str(int(v))
    return str(v)


def spark_type(t) -> str:
    from pyspark.sql import types as T

    simple = {
        T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.ShortType: "SMALLINT", T.ByteType: "TINYINT",
        T.DoubleType: "DOUBLE", T.FloatType: "FLOAT", T.StringType: "VARCHAR", T.BooleanType: "BOOLEAN",
        T.DateType: "DATE", T.TimestampType: "TIMESTAMP WITH TIME ZONE", T.TimestampNTZType: "TIMESTAMP",
    }
    for k, v in simple.items():
        if isinstance(t, k):
            return v
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    if isinstance(t, T.ArrayType):
        return spark_type(t.elementType) + "[]"
    return t.simpleString()


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    pats = [a for a in args if not os.path.isdir(a)]
    spark = local_session(8, shuffle_partitions=int(os.environ.get("TIDE_SHUFFLE_PARTITIONS", "8")))
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    reg = load_all()
    ok = bad = skipped = 0
    for name, q in sorted(reg.items()):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sdf = q.fn(spark, sf_dir)
            scols = sdf.columns
            stypes = {f.name: spark_type(f.dataType) for f in sdf.schema.fields}
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if not q.sql:
            print(f"ROWS {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            skipped += 1
            continue
        try:
            rel = con.sql(q.sql)
            dcols = rel.columns
            dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            drows = rel.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        if sorted(scols) != sorted(dcols) or len(srows) != len(drows) or hs != hd:
            bad += 1
            print(f"FAIL {name}: cols {sorted(scols)} vs {sorted(dcols)}; rows {len(srows)} vs {len(drows)}")
            diff_s = [x for x in ls if x not in set(ld)][:3]
            diff_d = [x for x in ld if x not in set(ls)][:3]
            print("   spark-only:", [d[:200] for d in diff_s])
            print("   duck-only: ", [d[:200] for d in diff_d])
        else:
            ok += 1
            tdiff = {c: (stypes.get(c), dtypes.get(c)) for c in scols if stypes.get(c) != dtypes.get(c)}
            print(f"OK   {name}: {len(srows)} rows {ts:.1f}s" + (f"  TYPES {tdiff}" if tdiff else ""))
    print(f"ok={ok} bad={bad} rows-only={skipped}")
    spark.stop()


if __name__ == "__main__":
    main()
