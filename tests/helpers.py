def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())
