"""Rows of a frame in a fixed order."""


def values(df, *order):
    """Rows as tuples, sorted by the given columns or by all."""
    rows = [tuple(r) for r in df.collect()]
    if not order:
        return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))
    at = [df.columns.index(c) for c in order]
    return sorted(rows, key=lambda r: tuple((r[i] is None, r[i]) for i in at))
