"""Run registered queries and their SQL side by side: python tools/check.py [sf] [key ...]"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from riskloom.plans import catalog  # noqa: E402
from riskloom.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def cell(x):
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if isinstance(x, int):
        return str(x)
    return str(x)


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted("\x1f".join(cell(r[i]) for i in order) for r in rows)


def family(kind: str) -> str:
    k = kind.lower()
    for name, marks in {"int": ("int", "long"), "float": ("double", "float"), "str": ("varchar", "string"),
                        "bool": ("bool",), "dec": ("decimal",)}.items():
        if any(m in k for m in marks):
            return name
    return k


def compare(spark, con, key, sf_dir):
    start = time.time()
    df = catalog.QUERIES[key](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if key not in catalog.CHECKS:
        return "rows", f"{len(rows)} rows", took
    rel = con.execute(catalog.CHECKS[key])
    want_cols, want_types = [d[0] for d in rel.description], [str(d[1]) for d in rel.description]
    want = rel.fetchall()
    cols, a = canon(df.columns, rows)
    wcols, b = canon(want_cols, want)
    if cols != wcols:
        return "FAIL", f"columns {cols} != {wcols}", took
    types = {c: family(t) for c, t in df.dtypes}
    wtypes = {c: family(t) for c, t in zip(want_cols, want_types)}
    bad = {c: (types[c], wtypes[c]) for c in types
           if types[c] != wtypes[c] and not (wtypes[c] == "number" and types[c] in ("int", "float"))}
    if len(a) != len(b):
        return "FAIL", f"rows {len(a)} != {len(b)}", took
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y]
        return "FAIL", f"{len(diff)} rows differ, e.g.\n   spark {diff[0][0][:600]}\n   sql   {diff[0][1][:600]}", took
    if not a:
        return "EMPTY", "no rows", took
    return "ok", f"{len(a)} rows" + (f" TYPES {bad}" if bad else ""), took


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    keys = sys.argv[2:] or list(catalog.QUERIES)
    spark = local_session("check")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for key in keys:
        try:
            state, note, took = compare(spark, con, key, sf_dir)
        except Exception as e:  # noqa: BLE001
            state, note, took = "ERROR", str(e)[:1500], 0.0
        bad += state in ("FAIL", "ERROR", "EMPTY")
        print(f"{state:5} {key:28} {took:6.2f}s {note}", flush=True)
    print(f"{len(keys)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
