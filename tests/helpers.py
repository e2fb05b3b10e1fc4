from strataframe.sources.dimensions import Intervals


def rows(df, *order):
    """Collected rows as plain tuples, sorted for comparison."""
    out = [tuple(r) for r in (df.select(*order) if order else df).collect()]
    return sorted(out, key=lambda r: tuple((v is not None, v) for v in r))


# Four stages, oldest first: bottoms 40, 30, 20, 10 and tops 30, 20, 10, 0.
FOUR = Intervals.from_rows([
    (1, "Old", "Lower", 40.0, 30.0, 35.0, 10.0),
    (2, "Old", "Lower", 30.0, 20.0, 25.0, 10.0),
    (3, "Mid", "Upper", 20.0, 10.0, 15.0, 10.0),
    (4, "New", "Upper", 10.0, 0.0, 5.0, 10.0),
])
