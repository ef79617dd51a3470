"""Queries in SQL text by the functions of the catalogue, over a reference table that changes, and over files, with the same in
DuckDB SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from papyra.operators.reference import with_known_code, with_name, with_unknown_code
from papyra.sources.files import fitted_scale, pages_to_render
from papyra.sources.pdf import pdf_pages

from .catalogue import register
from .zone_queries import AS_OF, digit_sql, keys

_ZONES_IN_SQL = """
WITH c AS (
  SELECT c_custkey AS k, concat('A', lpad(c_custkey * 7919 % 100000000, 8, '0')) AS number, concat(lpad(30 + c_custkey % 60, 2, '0'), lpad(1 + c_custkey % 12, 2, '0'), lpad(1 + c_custkey % 28, 2, '0')) AS birth,
    concat(lpad(27 + c_custkey % 9, 2, '0'), lpad(1 + c_custkey % 12, 2, '0'), lpad(1 + c_custkey % 28, 2, '0')) AS expiry FROM {keys}),
d AS (SELECT *, concat(number, papyra_check_digit(number)) AS a, concat(birth, papyra_check_digit(birth)) AS b, concat(expiry, papyra_check_digit(expiry)) AS e FROM c),
z AS (SELECT *, concat('some print', chr(10), 'p<utowater«‹anna', repeat('<', 28), chr(10), a, 'UTO', b, if(k % 2 = 0, 'M', 'F'), e, repeat('<', 15), papyra_check_digit(concat(a, b, e, repeat('<', 15)))) AS text FROM d),
m AS (SELECT *, papyra_zone(text) AS zone FROM z)
SELECT m.k AS c_custkey, l.line_no, l.line, r.reading AS first_reading, m.zone.format, m.zone.score, m.zone.valid_checks, m.zone.composite, papyra_date(m.birth, 'birth') AS birth, papyra_date(m.expiry, 'expiry') AS expiry,
  papyra_country(substr(m.zone.lines[0], 3, 3)) AS issuer, papyra_is_valid(m.number, substr(m.a, 10, 1)) AS sound
FROM m, LATERAL papyra_lines(m.text) l, LATERAL papyra_readings(l.line, 'TD3', l.line_no + 1) r WHERE r.reading_no = 0
"""


def zones_in_sql(spark, sf):
    """Zones made and read by SQL text alone."""
    register(spark, AS_OF)
    return spark.sql(_ZONES_IN_SQL, keys=keys(spark, sf))


ZONES_IN_SQL = f"""
WITH c AS (SELECT c_custkey AS k, 'A' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS n, lpad(CAST(30 + c_custkey % 60 AS VARCHAR), 2, '0') AS y, lpad(CAST(27 + c_custkey % 9 AS VARCHAR), 2, '0') AS x,
  lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') AS mo, lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS da FROM customer),
d AS (SELECT *, n || CAST({digit_sql("n", 9)} AS VARCHAR) AS a, y || mo || da || CAST({digit_sql("(y || mo || da)", 6)} AS VARCHAR) AS b, x || mo || da || CAST({digit_sql("(x || mo || da)", 6)} AS VARCHAR) AS e FROM c),
z AS (SELECT *, a || b || e || repeat('<', 15) AS all_of FROM d),
l AS (SELECT *, 0 AS line_no, 'P<UTOWATER<<ANNA' || repeat('<', 28) AS line FROM z UNION ALL
  SELECT *, 1, a || 'UTO' || b || CASE WHEN k % 2 = 0 THEN 'M' ELSE 'F' END || e || repeat('<', 15) || CAST({digit_sql("all_of", 39)} AS VARCHAR) FROM z)
SELECT k AS c_custkey, line_no, line, line AS first_reading, 'TD3' AS format, 200 AS score, 4 AS valid_checks, true AS composite, CASE WHEN CAST(y AS INTEGER) > 26 THEN '19' ELSE '20' END || y || '-' || mo || '-' || da AS birth,
  '20' || x || '-' || mo || '-' || da AS expiry, 'Utopia' AS issuer, true AS sound FROM l
"""

_CHANGE = dt.date(1998, 1, 1)


def _code(key: str):
    return F.translate(F.lpad(F.col(key).cast("string"), 3, "0"), "0123456789", "ABCDEFGHIJ")


def reference_versions(spark, sf):
    """Orders with the name that their nation's code had on their day, by a table that replaces the countries: each fifth nation
    is missing from it, and the even ones changed their names."""
    n = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey % 5 <> 0")
    name = lambda by, lo, hi: n.select(_code("n_nationkey").alias("code"), F.concat("n_name", F.lit(by)).alias("name"), F.lit(lo).cast("date").alias("valid_from"), F.lit(hi).cast("date").alias("valid_to"), "n_nationkey")
    table = name(" I", None, _CHANGE).unionByName(name(" II", _CHANGE, None).where("n_nationkey % 2 = 0")).drop("n_nationkey")
    o = spark.read.parquet(f"{sf}/orders.parquet").join(spark.read.parquet(f"{sf}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select("o_orderkey", F.concat(F.lower(_code("c_nationkey")), F.lit("<")).alias("code"), F.col("o_orderdate").cast("date").alias("day"))
    both = with_known_code(o, "code", table).withColumn("known", F.lit(True)).unionByName(with_unknown_code(o, "code", table).withColumn("known", F.lit(False)))
    return with_name(both, "code", table, F.col("day"), "nation").drop("day")


REFERENCE_VERSIONS = f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, c_nationkey AS k, translate(lpad(CAST(c_nationkey AS VARCHAR), 3, '0'), '0123456789', 'ABCDEFGHIJ') AS code FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, lower(o.code) || '<' AS code, k % 5 <> 0 AS known, CASE WHEN k % 5 = 0 THEN o.code WHEN day < DATE '{_CHANGE}' THEN n_name || ' I' WHEN k % 2 = 0 THEN n_name || ' II' ELSE o.code END AS nation FROM o JOIN nation ON n_nationkey = k
"""



# pages of PDF files that are made from customers


def _files(spark, sf):
    """(c_custkey, content): files of one to four pages, every second turned; each tenth breaks off after its first object."""
    k = F.col("c_custkey")
    n = (k % 4 + 1).cast("int")
    numbers = F.sequence(F.lit(1), n)
    kids = F.array_join(F.transform(numbers, lambda i: F.concat((i + 2).cast("string"), F.lit(" 0 R"))), " ")
    pages = F.array_join(F.transform(numbers, lambda i: F.concat((i + 2).cast("string"), F.lit(" 0 obj\n<< /Type /Page /Parent 2 0 R"), F.when(i % 2 == 0, " /Rotate 90").otherwise(""), F.lit(" >>\nendobj\n"))), "")
    box = F.concat(F.lit("[0 0 "), (400 + k % 4000).cast("string"), F.lit(" "), (600 + k % 3000).cast("string"), F.lit("]"))
    text = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n"), F.when(k % 10 != 0, F.concat(F.lit("2 0 obj\n<< /Type /Pages /Kids ["), kids, F.lit("] /MediaBox "), box, F.lit(" >>\nendobj\n"), pages, F.lit("trailer\n<< /Root 1 0 R >>\n"))).otherwise(""))
    return keys(spark, sf).select(k, text.cast("binary").alias("content"))


def pdf_page_sizes(spark, sf):
    """Pages of files with their sizes, as they are turned, and the scale that each is drawn at; the first three pages of a file."""
    p = _files(spark, sf).select("c_custkey", pdf_pages(F.col("content")).alias("pages"))
    wanted = F.filter("pages", lambda x: F.array_contains(pages_to_render(F.size("pages"), None, 3), x["page"]))
    p = p.select("c_custkey", F.coalesce(F.size("pages"), F.lit(0)).alias("n_pages"), F.explode_outer(wanted).alias("p"))
    return p.select("c_custkey", "n_pages", "p.*", F.round(fitted_scale(F.col("p.width"), F.col("p.height")), 6).alias("scale"))


PDF_PAGE_SIZES = """
WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE c_custkey % 4 + 1 END AS n, 400.0::DOUBLE + c_custkey % 4000 AS w, 600.0::DOUBLE + c_custkey % 3000 AS h FROM customer),
p AS (SELECT c.*, i AS page, CASE WHEN i % 2 = 0 THEN h ELSE w END AS width, CASE WHEN i % 2 = 0 THEN w ELSE h END AS height FROM c LEFT JOIN (SELECT unnest(range(1, 4)) AS i) r ON i <= n)
SELECT c_custkey, CAST(n AS INTEGER) AS n_pages, CAST(page AS INTEGER) AS page, CASE WHEN page IS NOT NULL THEN width END AS width, CASE WHEN page IS NOT NULL THEN height END AS height, CAST(CASE WHEN page IS NOT NULL THEN (page + 1) % 2 * 90 END AS INTEGER) AS rotate,
  CASE WHEN page IS NULL THEN 2.5 ELSE round(CASE WHEN w * 2.5 * h * 2.5 > 25000000 THEN 2.5 * sqrt(25000000.0::DOUBLE / (w * 2.5 * h * 2.5)) ELSE 2.5 END, 6) END AS scale FROM p
"""

QUERIES = {
    "pdf_page_sizes": (pdf_page_sizes, PDF_PAGE_SIZES),
    "zones_in_sql": (zones_in_sql, ZONES_IN_SQL),
    "reference_versions": (reference_versions, REFERENCE_VERSIONS),
}
