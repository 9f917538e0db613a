"""Column names that an input does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores more as it takes to differ from all columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
