"""What several test modules share."""

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    """Rows as sorted text, columns by name, floats to six digits."""
    columns = sorted(frame.columns)

    def plain(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6f}"
        if x is None or str(x) in ("<NA>", "NaT"):
            return "null"
        return str([plain(v) for v in x]) if hasattr(x, "tolist") and getattr(x, "ndim", 0) else str(x)

    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))
