"""Runs registered queries against their SQL and reports what differs (also usable as a script)."""

from __future__ import annotations

import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    # Strict: -0.0 is not 0.0 and NaN is not null.
    if v is None:
        return "~"
    return repr(v) if isinstance(v, float) else str(v)


def compare(spark, con, name, fn, sql, sf_dir):
    """Empty text when equal, else a reason."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    got = sorted(tuple(_cell(v) for v in r) for r in df.select(*cols).collect())
    if sql is None:
        return "" if df.columns else "no columns"
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"columns {cols} != {sorted(rel.columns)}"
    want_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    bad = {c: (got_types[c], want_types[c]) for c in cols if KINDS.get(got_types[c]) != want_types[c]}
    if bad:
        return f"types {bad}"
    names = ", ".join('"%s"' % c for c in cols)
    want = sorted(tuple(_cell(v) for v in r) for r in con.sql(f"SELECT {names} FROM ({sql})").fetchall())
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first got {got[:2]} want {want[:2]}"
    if not got:
        return "EMPTY"
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(diff)} of {len(got)} rows differ, first {diff[0]}" if diff else ""


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from __spark_entry__ import oracle_sql, queries
    from harborline.session import build_session

    spark = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    sf = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    if wanted and wanted[0].startswith("/"):
        sf = wanted.pop(0)
    con, sqls, bad = connect(sf), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            why = compare(spark, con, name, fn, sqls.get(name), sf)
        except Exception as e:
            why = "ERROR " + str(e)[:700]
        bad += bool(why)
        print(f"{'BAD ' if why else 'ok  '} {name} {time.time() - t0:.2f}s {'' if name in sqls else '(no sql)'} {why[:900]}", flush=True)
    print("bad:", bad)
