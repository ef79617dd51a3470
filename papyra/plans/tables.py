"""Tables as queries read them."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows of a part: what a row is made into may take some kilobytes and milliseconds. Parts a core, so that short ones fill up.
PART_ROWS, PARTS_A_CORE = 10_000, 4


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """rows, narrow ones whose columns much work follows from, dealt evenly over parts that grow in number with them, by columns
    if they are named.

    A file of one row group is read by one task whatever its size, and so is everything that is worked out in the same stage.
    The count reads no column.
    """
    parts = max(PARTS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, *by)
