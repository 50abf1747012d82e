"""Where queries are registered: their functions, (spark, sf_dir) -> DataFrame, and the SQL that must give the same rows."""

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    """Rounded for comparison; adding 0 makes -0.0 plain."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 0.0, digits)


def integral(f: str, lo: str, hi: str, n: int = 400) -> str:
    """Simpson's rule in SQL; f is an expression of t."""
    return f"(SELECT sum(CASE WHEN g IN (0, {n}) THEN 1 WHEN g % 2 = 1 THEN 4 ELSE 2 END * ({f.replace('$t', f'(({lo}) + (({hi}) - ({lo})) * g / {n}.0)')})) * (({hi}) - ({lo})) / {3 * n} FROM range({n + 1}) u(g))"
