"""Compare a Spark result with its oracle SQL result (row count, column names,
order-insensitive value hash with floats rounded to 9 places)."""
from __future__ import annotations

import hashlib
import math
import os

# ORACLE_STRICT=1 compares floats exactly (repr) instead of rounded to 9 places.
STRICT = os.environ.get("ORACLE_STRICT") == "1"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck_connection(d: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def norm(v) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (repr(v) if STRICT else repr(round(v, 9)))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return repr(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark_df, con, sql: str) -> tuple[bool, str]:
    srows = [tuple(r) for r in spark_df.collect()]
    scols = spark_df.columns
    cur = con.execute(sql)
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    if sorted(scols) != sorted(dcols):
        return False, f"columns spark={scols} duck={dcols}"
    hs, ls = digest(scols, srows)
    hd, ld = digest(dcols, drows)
    if len(srows) != len(drows) or hs != hd:
        only_s = sorted(set(ls) - set(ld))[:2]
        only_d = sorted(set(ld) - set(ls))[:2]
        return False, f"rows spark={len(srows)} duck={len(drows)} spark-only={only_s} duck-only={only_d}"
    return True, f"{len(srows)} rows"


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
                 "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT",
                 "tinyint": "TINYINT", "date": "DATE"}


def spark_type_name(t: str) -> str:
    if t.startswith("array<") and t.endswith(">"):
        return spark_type_name(t[6:-1]) + "[]"
    return SPARK_TO_DUCK.get(t, t.upper())


def type_mismatches(spark_df, con, sql: str) -> list[str]:
    """Columns whose Spark type and oracle type differ (naive timestamps are equal)."""
    rel = con.sql(sql)
    duck = dict(zip(rel.columns, [str(t) for t in rel.types]))
    out = []
    for f in spark_df.schema.fields:
        s = spark_type_name(f.dataType.simpleString())
        if duck.get(f.name) != s:
            out.append(f"{f.name}: spark={s} oracle={duck.get(f.name)}")
    return out
