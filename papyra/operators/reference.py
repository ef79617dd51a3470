"""Reference tables that change over time: names of codes by date, and records with known and unknown codes.

A table has rows (code, name, valid_from, valid_to): a name holds from the first date up to, not including, the second; a null
date is open. Where versions overlap the one that begins last holds. Each code becomes one row with its versions in order, so that
a join never makes more rows than the records have, whatever their dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.countries import country_table, normal_code

SCHEMA = "code string, name string, valid_from date, valid_to date"
#: Codes up to which a table is sent to all executors; larger ones are joined by a shuffle.
BROADCAST_CODES = 100_000


def default_table(spark: SparkSession) -> DataFrame:
    """The countries that the library knows, valid at all times."""
    return country_table(spark).select("code", "name", F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))


def versions(table: DataFrame) -> DataFrame:
    """(code, versions): one row for each code, versions by the date they begin, open ones first. Rows without a code are left
    out; of two that begin at once the greater name comes last and so holds."""
    code = normal_code(F.col("code"))
    each = F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")).alias("begins"), F.col("name").alias("name"), F.coalesce("valid_to", F.lit(dt.date(9999, 12, 31))).alias("ends"))
    return table.where(code != "").groupBy(code.alias("code")).agg(F.array_sort(F.collect_set(each)).alias("versions"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_CODES else df


def _on(on: Column | dt.date) -> Column:
    return F.lit(on) if isinstance(on, dt.date) else on


def with_name(records: DataFrame, code_col: str, table: DataFrame, on: Column | dt.date, out: str) -> DataFrame:
    """records with the column `out`: the name of a code at a date; the code itself where the table has none then.

    Codes are compared in capitals without anything but letters. A null code or date has no name and gives the code ('' if null).
    """
    known = _sized(versions(table).withColumnsRenamed({"code": "__code", "versions": "__versions"}))
    code = normal_code(F.col(code_col))
    found = records.withColumns({"__own": code, "__on": _on(on)}).join(known, F.col("__own") == F.col("__code"), "left")
    valid = F.filter("__versions", lambda v: (v["begins"] <= F.col("__on")) & (F.col("__on") < v["ends"]))
    return found.withColumn(out, F.coalesce(F.try_element_at(valid, F.lit(-1))["name"], F.col("__own"))).drop("__own", "__on", "__code", "__versions")


def with_known_code(records: DataFrame, code_col: str, table: DataFrame) -> DataFrame:
    """The records whose code the table has at any time."""
    return _matched(records, code_col, table, "left_semi")


def with_unknown_code(records: DataFrame, code_col: str, table: DataFrame) -> DataFrame:
    """The records whose code the table never has; null codes among them."""
    return _matched(records, code_col, table, "left_anti")


def _matched(records: DataFrame, code_col: str, table: DataFrame, how: str) -> DataFrame:
    known = _sized(table.select(normal_code(F.col("code")).alias("__code")).where("__code <> ''").distinct())
    return records.join(known, normal_code(records[code_col]) == known["__code"], how)
