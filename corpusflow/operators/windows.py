"""Running sums that do not gather a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions per block: one task sorts at most this many distinct positions of a key.
BLOCK = 10_000


def running_sums(
    df: DataFrame, keys: list[str], position: str, values: dict[str, Column], block: int = BLOCK
) -> DataFrame:
    """Add columns with the sum of each value over all rows of a key up to this position.

    Positions are ordinals. Blocks of positions are summed first; the running
    total over blocks is small and is joined back, so that the ordered window
    spans one block of a key, however long the key is.
    """
    names = list(values)
    rows = df.withColumns({"__block": F.floor(F.col(position) / block), **{f"__{n}": v for n, v in values.items()}})
    sums = rows.groupBy(*keys, "__block").agg(*[F.sum(f"__{n}").alias(n) for n in names])
    over_blocks = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "__block", *[F.coalesce(F.sum(n).over(over_blocks), F.lit(0)).alias(f"__before_{n}") for n in names]
    )
    within = Window.partitionBy(*keys, "__block").orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(offsets, [*keys, "__block"])
        .withColumns({n: F.col(f"__before_{n}") + F.sum(f"__{n}").over(within) for n in names})
        .drop("__block", *[f"__{n}" for n in names], *[f"__before_{n}" for n in names])
    )
