"""Registered queries over the given tables, each with its check in SQL."""


def registered():
    """All queries and their SQL by key."""
    from . import forecasting, scoring, shaping, splitting, storing, tuning
    queries, sql = {}, {}
    for part in (shaping, splitting, forecasting, tuning, storing, scoring):
        queries.update(part.QUERIES)
        sql.update(part.SQL)
    return queries, sql
