"""Rows of the hand-made tables, and helpers that read results."""

RATING_ROWS = [
    (1, 10, 4.0, 100), (1, 11, 3.5, 200), (1, 11, 5.0, 300), (1, 99, 2.0, 50),
    (2, 12, None, 400), (2, 13, 4.5, 500), (3, 14, 1.0, 600),
    (None, 10, 5.0, 1), (4, None, 5.0, 2), (5, 12, None, 700),
]
MOVIE_ROWS = [
    (10, "a", "Action|Comedy"), (11, "b", "Comedy"), (12, "c", "(no genres listed)"),
    (13, "d", "Drama|"), (14, "e", None),
]


def rows(df, *order):
    """Rows as a sorted list of tuples, nulls first."""
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()
