"""What tests share beyond fixtures."""


def rows(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
