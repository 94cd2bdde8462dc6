"""Named queries with the SQL that states their expected result."""

QUERIES = {}
SQL = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame``; ``sql`` is its check."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark, folder):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def ints(*columns: str):
    """Columns the SQL of a query must give as 32-bit integers, as Spark does."""
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in columns)

    def narrow(run):
        SQL[run.__name__] = f"SELECT * REPLACE ({casts}) FROM ({SQL[run.__name__]})"
        return run

    return narrow
