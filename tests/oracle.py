"""Compare a Spark result with SQL run by DuckDB on the same tables."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def assert_same(df, sql: str, sf_dir: str) -> int:
    """Same columns and the same rows, bit for bit, in any order."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(f"CREATE TABLE want AS {sql}")
    con.register("got", df.toArrow())
    names = [row[0] for row in con.execute("DESCRIBE want").fetchall()]
    assert sorted(df.columns) == sorted(names)

    columns = ", ".join(names)
    got, want = (f"SELECT {columns} FROM {side}" for side in ("got", "want"))
    for left, right in ((got, want), (want, got)):
        assert con.execute(f"{left} EXCEPT ALL {right} LIMIT 5").fetchall() == []
    return con.execute("SELECT count(*) FROM want").fetchall()[0][0]


def plan_of(df) -> str:
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode)
