"""Joins whose keys may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fewer keys than this can hold more than 1 / HEAVY of the rows each, which bounds what is broadcast.
HEAVY = 20_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], count: str, total: int, heavy: int | None = None) -> DataFrame:
    """`rows` joined with `counted`, which has one row for each key.

    `count` is a column of `counted`: how many rows the key has (or a bound of it), and `total` is the sum of that column.
    Keys of more than total / heavy rows, of which there are fewer than `heavy` (HEAVY by default), are broadcast, so that their rows stay
    where they are; the others are shuffled, and none of them brings a task more than total / heavy rows. (Adaptive
    execution doesn't split a join with an aggregate, as the aggregate stands between the shuffle and the join.)
    Rows with a null in a key are dropped, as by any inner join.
    """
    bound = total // (heavy or HEAVY)
    most, rest = counted.where(F.col(count) > bound), counted.where(F.col(count) <= bound)
    others = rows.join(F.broadcast(most.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(most), keys).unionByName(others.join(rest, keys))
