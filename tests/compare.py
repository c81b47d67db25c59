"""Run registered queries next to their SQL: python tests/compare.py [sf_dir] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if hasattr(value, "__float__"):
        number = float(value)
        return "nan" if math.isnan(number) else number
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([canonical(r[i]) for i in order] for r in rows), key=repr)


def differences(spark, con, name, query, sql, sf_dir):
    """Text that describes the first difference, or None; and the row count and times."""
    start = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    spark_s = time.time() - start
    if sql is None:
        return None, len(rows), spark_s, 0.0
    start = time.time()
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    wanted = cursor.fetchall()
    duck_s = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(rows), spark_s, duck_s
    got, right = sorted_rows(df.columns, rows), sorted_rows(names, wanted)
    if got != right:
        only = [r for r in got if r not in right][:3] if len(got) < 5000 else got[:2]
        other = [r for r in right if r not in got][:3] if len(got) < 5000 else right[:2]
        text = f"{len(got)} vs {len(right)} rows; {sorted(names)}\n   got  {only}\n   want {other}"
        return text, len(rows), spark_s, duck_s
    return None, len(rows), spark_s, duck_s


def main():
    import __spark_entry__ as entry
    from shelfseek.session import local_session
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        try:
            text, n, spark_s, duck_s = differences(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001 - a report
            text, n, spark_s, duck_s = f"{type(error).__name__}: {str(error)[:600]}", 0, 0, 0
        bad += text is not None
        kind = "rows " if name not in sql else ""
        print(f"{'FAIL' if text else 'ok'} {kind}{name} rows={n} spark={spark_s:.2f} "
              f"duckdb={duck_s:.2f} {text or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
