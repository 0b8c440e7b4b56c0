"""Queries over the driver's tables, each with the SQL that must give the same rows."""


def registered():
    """All queries and the SQL of those that have one."""
    from checks import bindings, functions, inputs, planning, reviews, streams, views, writes  # noqa: F401

    return bindings.QUERIES, bindings.ORACLE
