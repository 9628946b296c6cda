"""Look-ups of one row a key that do not put a hot key's rows into one task.

At most ``PARTS`` keys can hold more than a ``PARTS``-th of all rows each, so the looked-up
rows of those keys are broadcast, whatever the tables' sizes; the rows of all
other keys meet in an ordinary join, where no key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = 1000


def hot_keys(df: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Keys that hold more than one ``parts``-th of the rows (fewer than ``parts`` of them), from one partial aggregation."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hk_n"))
    total = sizes.agg(F.sum("_hk_n"))
    return sizes.where(F.col("_hk_n") * parts > total.scalar()).select(*keys)


def lookup(df: DataFrame, table: DataFrame, keys: list[str] | str, how: str = "left", parts: int = PARTS) -> DataFrame:
    """``df`` with the columns of ``table``, which has one row a key; ``how`` is left or inner. Null keys find nothing."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    new = [c for c in table.columns if c not in keys]
    hot = F.broadcast(hot_keys(df, keys, parts))
    flagged = df.join(hot.withColumn("_hk", F.lit(True)), keys, "left")
    many = flagged.where("_hk").drop("_hk").join(F.broadcast(table.join(hot, keys, "left_semi")), keys, how)
    few = flagged.where("_hk IS NULL").drop("_hk").join(table, keys, how)
    return many.select(*df.columns, *new).unionByName(few.select(*df.columns, *new))
