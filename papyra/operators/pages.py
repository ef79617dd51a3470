"""The best page of a case, and what was tried."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_page(pages: DataFrame, case: str, page: str, score: str, carry: list[str]) -> DataFrame:
    """One row for each case: the page with the highest score, of equal ones the first, and all attempts in page order.

    One aggregation that combines before its shuffle. Pages of a case are few (MAX_PAGES by default), so its list is short.
    """
    first = F.struct(F.col(score), -F.col(page))
    grouped = pages.groupBy(case).agg(F.max_by(F.struct(page, score, *carry), first).alias("best"), F.array_sort(F.collect_list(F.struct(F.col(page).alias("pageNumber"), F.col(score).alias("score")))).alias("attempts"))
    return grouped.select(case, F.col(f"best.{page}").alias(page), F.col(f"best.{score}").alias(score), *[F.col(f"best.{c}").alias(c) for c in carry], "attempts")
