"""Records as people and other systems read them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ABSENT = "Not detected"
NO_ALERTS = "No alerts."


def label(name: str) -> str:
    """camelCase as words, the first letter large."""
    spaced = re.sub("([A-Z])", r" \1", name)
    return spaced[:1].upper() + spaced[1:]


def label_column(name: Column) -> Column:
    spaced = F.regexp_replace(name, "([A-Z])", " $1")
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.substr(spaced, F.lit(2)))


def shown(c: Column, kind: T.DataType) -> Column:
    """A value as text: lists joined by " | ", structures as JSON, absent ones named as such."""
    if isinstance(kind, T.ArrayType):
        text = F.array_join(F.transform(c, lambda x: x.cast("string")), " | ") if not isinstance(kind.elementType, (T.StructType, T.ArrayType, T.MapType)) else F.to_json(c)
    else:
        text = F.to_json(c) if isinstance(kind, (T.StructType, T.MapType)) else c.cast("string")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(ABSENT))


def data_table(records: DataFrame, key: str) -> DataFrame:
    """One row for each field of each record: key, field_ord, label, value."""
    cells = [F.struct(F.lit(i).alias("field_ord"), F.lit(label(f.name)).alias("label"), shown(F.col(f.name), f.dataType).alias("value")) for i, f in enumerate(x for x in records.schema if x.name != key)]
    return records.select(key, F.explode(F.array(*cells)).alias("c")).select(key, "c.*")


def comparison_table(rows: DataFrame) -> DataFrame:
    """Five columns of a comparison, absent values named as such."""
    text = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(ABSENT))
    return rows.select(*[c for c in rows.columns if c in ("case_id", "field_ord")], "label", text("primaryValue").alias("primaryValue"), text("secondaryValue").alias("secondaryValue"), "status", text("note").alias("note"))


def decision_table(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    return verdicts.select(key, "decision", "riskLevel", F.concat(F.col("score").cast("string"), F.lit("%")).alias("score"), "reason")


def alert_rows(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    listed = F.when(F.size("alerts") > 0, F.col("alerts")).otherwise(F.array(F.lit(NO_ALERTS)))
    return verdicts.select(key, F.posexplode(listed).alias("alert_ord", "alert"))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def as_json(*cols: str) -> Column:
    return F.to_json(F.struct(*cols), {"pretty": "true"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
