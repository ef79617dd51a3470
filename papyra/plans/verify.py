"""Pages of both documents of each case to one verdict for each case."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.classify import RULES, Rule
from papyra.operators.compare import compare_documents
from papyra.operators.primary import read_primary
from papyra.operators.secondary import read_secondary


def run(pages: DataFrame, as_of: dt.date, rules: tuple[Rule, ...] = RULES) -> dict[str, DataFrame]:
    """primary, secondary and verdicts of pages (case_id, role, page_number, full_text, mrz_text).

    Everything is decided within a row but for a case's best page, one aggregation by case_id, whose partitioning the join of
    both documents uses again. Cases without both documents have no verdict.
    """
    primary = read_primary(pages.where(F.col("role") == "primary"), as_of)
    secondary = read_secondary(pages.where(F.col("role") == "secondary"), rules)
    verdicts = compare_documents(primary.drop("attempts"), secondary.drop("attempts"), as_of)
    return {"primary": primary, "secondary": secondary, "verdicts": verdicts}
