"""Registration of a query together with its SQL."""

QUERIES = {}
SQL = {}


def query(sql: str | None = None, name: str | None = None):
    """Register the decorated function (spark, folder) -> DataFrame, by default under its own name."""
    def register(fn):
        QUERIES[name or fn.__name__] = fn
        if sql is not None:
            SQL[name or fn.__name__] = sql
        return fn

    return register
