"""Queries over the driver's tables, one or more for each family of operators, and the same in DuckDB SQL.

The tables hold no travel documents, so queries make them up from the columns at hand, in Spark and in SQL alike.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import checkdigit as cd
from papyra.functions import dates
from papyra.functions.countries import country_table, normal_code
from papyra.functions.text import strip_accents
from papyra.operators import compare, fields, mrz
from papyra.operators.classify import Rule, Rules, classify, normalize
from papyra.operators.pages import best_page
from papyra.operators.primary import read_primary
from papyra.operators.secondary import read_secondary
from papyra.sources import files, sinks

from . import sql_queries, view_queries, zone_queries
from .tables import spread

AS_OF = dt.date(2026, 11, 26)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_digit_sql = zone_queries.digit_sql


# check digits

def _number(key: Column) -> Column:
    return F.upper(F.lpad(F.hex(key), 9, "0"))


def check_digit(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", _number(F.col("c_custkey")).alias("number"))
    return c.select("c_custkey", "number", cd.check_digit(F.col("number"), 9).cast("long").alias("digit"), cd.validate(F.col("number"), F.lit("7"), 9).alias("is_seven"))


CHECK_DIGIT = f"""
WITH c AS (SELECT c_custkey, upper(lpad(hex(c_custkey), 9, '0')) AS number FROM customer)
SELECT c_custkey, number, CAST({_digit_sql("number", 9)} AS BIGINT) AS digit, {_digit_sql("number", 9)} = 7 AS is_seven FROM c
"""


def check_digit_correct(spark, sf):
    c = zone_queries.keys(spark, sf).select("c_custkey", _number(F.col("c_custkey")).alias("number"))
    c = c.select("c_custkey", F.translate("number", "08", "OB").alias("read"), cd.check_digit(F.col("number"), 9).cast("string").alias("digit"))
    fixed = cd.correct_with_check_digit(F.col("read"), F.col("digit"), "document")
    return c.withColumn("f", fixed).select("c_custkey", "read", "digit", F.col("f.value").alias("value"), F.col("f.valid").alias("valid"), F.col("f.corrections").alias("corrections"))


CHECK_DIGIT_CORRECT = f"""
WITH c AS (SELECT c_custkey, upper(lpad(hex(c_custkey), 9, '0')) AS number FROM customer),
r AS (SELECT c_custkey, translate(number, '08', 'OB') AS read, CAST({_digit_sql("number", 9)} AS VARCHAR) AS digit FROM c),
p AS (SELECT *, list_filter(range(1, 10), lambda i: instr('{cd.NUMBER_FROM}', substr(read, i, 1)) > 0) AS pos FROM r),
v AS (SELECT c_custkey, read, digit, pos, len(pos) AS m, unnest(range(0, least(CAST(pow(2, len(pos)) AS BIGINT), 30))) AS k FROM p),
w AS (SELECT c_custkey, read, digit, k, bit_count(k) AS n, array_to_string(list_transform(range(1, 10), lambda i: CASE WHEN list_contains(pos, i) AND ((k >> CAST(m - list_position(pos, i) AS INTEGER)) & 1) = 1
  THEN translate(substr(read, i, 1), '{cd.NUMBER_FROM}', '{cd.NUMBER_TO}') ELSE substr(read, i, 1) END), '') AS value FROM v),
ok AS (SELECT *, CAST({_digit_sql("value", 9)} AS VARCHAR) = digit AS good FROM w),
one AS (SELECT c_custkey, min(k) AS k FROM ok WHERE good GROUP BY c_custkey)
SELECT r.c_custkey, r.read, r.digit, coalesce(ok.value, r.read) AS value, CASE WHEN one.k = 0 THEN true WHEN one.k IS NULL THEN false END AS valid, CAST(coalesce(ok.n, 0) AS INTEGER) AS corrections
FROM r LEFT JOIN one USING (c_custkey) LEFT JOIN ok ON ok.c_custkey = one.c_custkey AND ok.k = one.k
"""


# machine-readable zones made from customers

def _zone(keys: DataFrame) -> DataFrame:
    """The lines of a zone for each key, with keys' columns."""
    k = F.col("c_custkey")
    c = keys.select(
        "*",
        F.concat(F.lit("WATER"), F.translate(F.lpad((k % 1000).cast("string"), 3, "0"), "0123456789", "ABDEFGHJMN")).alias("surname"),
        F.concat(F.lpad((30 + k % 60).cast("string"), 2, "0"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("birth"),
        F.concat(F.lpad((27 + k % 9).cast("string"), 2, "0"), F.lpad((1 + k % 12).cast("string"), 2, "0"), F.lpad((1 + k % 28).cast("string"), 2, "0")).alias("expiry"),
        F.concat(F.lit("A"), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0")).alias("number"),
        F.when(k % 2 == 0, "M").otherwise("F").alias("sex"),
    )
    one = F.rpad(F.concat(F.lit("P<UTO"), F.col("surname"), F.lit("<<ANNA<MARIA")), 44, "<")
    digit = lambda x, n: cd.check_digit(x, n).cast("string")
    c = c.withColumn("line1", one).withColumn("a", F.concat("number", digit(F.col("number"), 9))).withColumn("b", F.concat("birth", digit(F.col("birth"), 6))).withColumn("e", F.concat("expiry", digit(F.col("expiry"), 6)))
    two = F.concat(F.col("a"), F.lit("UTO"), F.col("b"), F.col("sex"), F.col("e"), F.lit("<" * 15))
    return c.withColumn("line2", F.concat(two, digit(F.concat("a", "b", "e", F.lit("<" * 15)), 39)))


_ZONE_SQL = """
SELECT c_custkey, 'WATER' || translate(lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '0123456789', 'ABDEFGHJMN') AS surname,
  CASE WHEN 30 + c_custkey % 60 > 26 THEN '19' ELSE '20' END || lpad(CAST(30 + c_custkey % 60 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS birth,
  '20' || lpad(CAST(27 + c_custkey % 9 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS expiry,
  'A' || lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS number, c_custkey % 2 = 0 AS male
FROM customer
"""


def mrz_td3_parse(spark, sf):
    z = _zone(zone_queries.keys(spark, sf)).select("c_custkey", F.concat_ws("\n", F.lit("some print"), "line1", "line2").alias("text"))
    m = F.col("mrz")
    return mrz.parse_mrz(z, "text", AS_OF).select(
        "c_custkey", m["mrzFormat"].alias("format"), m["documentType"].alias("document_type"), m["surname"].alias("surname"), m["givenNames"].alias("given_names"), m["documentNumber"].alias("number"), m["nationality"].alias("nationality"),
        m["dateOfBirth"].alias("birth"), m["gender"].alias("gender"), m["expiryDate"].alias("expiry"), m["expiryStatus"]["status"].alias("status"), m["expiryStatus"]["daysUntilExpiry"].alias("days_left"), m["checkDigits"]["allValid"].alias("all_valid"),
        m["candidateScore"].alias("candidate_score"), m["confidence"]["score"].alias("confidence"), F.array_join(m["warnings"], "|").alias("warnings"),
    )


MRZ_TD3_PARSE = f"""
WITH z AS ({_ZONE_SQL})
SELECT c_custkey, 'TD3' AS format, 'PASSPORT' AS document_type, surname, 'ANNA MARIA' AS given_names, number, 'Utopia' AS nationality, birth, CASE WHEN male THEN 'MALE' ELSE 'FEMALE' END AS gender, expiry,
  CASE WHEN date_diff('day', DATE '{AS_OF}', CAST(expiry AS DATE)) <= 30 THEN 'EXPIRING_SOON' ELSE 'VALID' END AS status, CAST(date_diff('day', DATE '{AS_OF}', CAST(expiry AS DATE)) AS INTEGER) AS days_left, true AS all_valid,
  200 AS candidate_score, CASE WHEN date_diff('day', DATE '{AS_OF}', CAST(expiry AS DATE)) <= 30 THEN 85 ELSE 100 END AS confidence,
  CASE WHEN date_diff('day', DATE '{AS_OF}', CAST(expiry AS DATE)) <= 30 THEN 'Document expires within 30 days.' ELSE '' END AS warnings
FROM z
"""


def mrz_lines(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", mrz.mrz_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("lines_md5"))


_LIKELY = "(contains(l, '<') AND length(l) >= 20) OR (regexp_matches(l, '^[A-Z][A-Z0-9<][A-Z0-9<]{3}') AND length(l) >= 25) OR regexp_matches(l, '[0-9OBISZGL]{7}[MFX<][0-9OBISZGL]{6}')"
MRZ_LINES = f"""
WITH d AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(upper(replace(text, 'ß', 'SS')), '\\r?\\n'), lambda l: regexp_replace(regexp_replace(regexp_replace(l, '\\s+', '', 'g'), '[«‹≤{{}}\\[\\]()|¦!/\\\\]', '<', 'g'), '[^A-Z0-9<]', '', 'g')),
  lambda l: length(l) >= 20 AND ({_LIKELY})) AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_md5 FROM d
"""


def clean_lines(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", fields.clean_lines(F.col("text")).alias("lines"))
    return d.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("lines_md5"))


CLEAN_LINES = """
WITH d AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), ''), chr(10)), lambda l: trim(regexp_replace(translate(upper(replace(strip_accents(l), 'ß', 'SS')), '|“”', 'I""'), '\\s+', ' ', 'g'))), lambda l: l <> '') AS lines FROM documents)
SELECT doc_id, CAST(len(lines) AS INTEGER) AS n_lines, md5(array_to_string(lines, chr(10))) AS lines_md5 FROM d
"""


# classification by keywords that the documents at hand hold

TEXT_RULES = (
    Rule("English", "Prose", "a", ("THE", "AND", "WITH", "FROM THE", "THAT THE ENDNT")),
    Rule("German", "Prose", "b", ("DER", "DIE", "UND", "NICHT", "EINUNG", "VEREINBARUNG")),
    Rule("French", "Prose", "c", ("LES", "DANS", "QUE", "POUR")),
    Rule("License", "Notice", "d", ("LICENSED UNDER THE APACHE LICENSE", "VERSION 2.0", "COPYRIGHT")),
)


def classify_keywords(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", normalize(F.col("text")).alias("n"))
    c = d.select("doc_id", classify(F.col("n"), TEXT_RULES).alias("c"))
    flat = F.array_join(F.transform("c.alternatives", lambda a: F.concat(a["type"], F.lit(":"), a["confidence"].cast("string"))), "|")
    return c.select("doc_id", F.col("c.type").alias("type"), F.col("c.category").alias("category"), F.col("c.route").alias("route"), F.col("c.confidence").alias("confidence"), F.array_join("c.matchedKeywords", "|").alias("matched"), flat.alias("alternatives"))


def _rule_sql(i: int, rule: Rule) -> str:
    found = "list_filter([" + ", ".join(f"CASE WHEN contains(n, '{k}') THEN '{k}' END" for k in rule.keywords) + "], lambda x: x IS NOT NULL)"
    points = " + ".join(f"CASE WHEN contains(n, '{k}') THEN {18 if len(k) > 14 else 10} ELSE 0 END" for k in rule.keywords)
    return f"SELECT doc_id, {i} AS i, '{rule.type}' AS type, '{rule.category}' AS category, '{rule.route}' AS route, {found} AS f, {points} + CASE WHEN len({found}) >= 3 THEN 20 ELSE 0 END + CASE WHEN len({found}) >= 5 THEN 25 ELSE 0 END AS s FROM d"


CLASSIFY_KEYWORDS = f"""
WITH d AS (SELECT doc_id, trim(regexp_replace(upper(replace(strip_accents(text), 'ß', 'SS')), '\\s+', ' ', 'g')) AS n FROM documents),
r AS ({" UNION ALL ".join(_rule_sql(i, r) for i, r in enumerate(TEXT_RULES))}),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, i) AS rn FROM r)
SELECT doc_id, max(CASE WHEN rn = 1 THEN CASE WHEN s > 0 THEN type ELSE 'Unknown Travel / Immigration Document' END END) AS type, max(CASE WHEN rn = 1 THEN CASE WHEN s > 0 THEN category ELSE 'Other' END END) AS category,
  max(CASE WHEN rn = 1 THEN route END) AS route, CAST(max(CASE WHEN rn = 1 THEN least(99, s) END) AS INTEGER) AS confidence, max(CASE WHEN rn = 1 THEN array_to_string(f, '|') END) AS matched,
  string_agg(CASE WHEN rn > 1 THEN type || ':' || CAST(least(99, s) AS VARCHAR) END, '|' ORDER BY rn) AS alternatives
FROM k GROUP BY doc_id
"""


# rules from a table: a rule for ten documents each, whose keywords are cuts of their texts

def _cuts(spark, sf) -> DataFrame:
    """(rule_ord, type, category, route, keyword, keyword_ord)"""
    d = spread(_t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalize(F.col("text")).alias("n"))
    keyword = F.substr("n", (1 + F.col("doc_id") % 50).cast("int"), (6 + F.col("doc_id") % 12).cast("int"))
    rule = (F.col("doc_id") / 10).cast("int")
    d = d.select(rule.alias("rule_ord"), F.concat(F.lit("rule "), rule.cast("string")).alias("type"), F.lit("Cuts").alias("category"), F.concat(F.lit("r"), (rule % 7).cast("string")).alias("route"), F.trim(keyword).alias("keyword"), (F.col("doc_id") % 10).cast("int").alias("keyword_ord"))
    return d.where(F.length("keyword") >= 4)


def classify_table(spark, sf):
    """Documents by rules that come as a table, one keyword a document; found by one automaton or, beyond its size, by windows."""
    rules = Rules.of(_cuts(spark, sf))
    d = spread(_t(spark, sf, "documents").select("doc_id", "text")).select("doc_id", normalize(F.col("text")).alias("n"))
    c = d.select("doc_id", classify(F.col("n"), rules).alias("c"))
    flat = F.array_join(F.transform("c.alternatives", lambda a: F.concat(a["type"], F.lit(":"), a["confidence"].cast("string"))), "|")
    return c.select("doc_id", F.col("c.type").alias("type"), F.col("c.route").alias("route"), F.col("c.confidence").alias("confidence"), F.md5(F.array_join("c.matchedKeywords", "|").cast("binary")).alias("matched_md5"), flat.alias("alternatives"))


CLASSIFY_TABLE = """
WITH d AS (SELECT doc_id, trim(regexp_replace(upper(replace(strip_accents(text), 'ß', 'SS')), '\\s+', ' ', 'g')) AS n FROM documents),
k AS (SELECT doc_id // 10 AS rule, doc_id % 10 AS o, trim(substr(n, CAST(1 + doc_id % 50 AS BIGINT), CAST(6 + doc_id % 12 AS BIGINT))) AS k FROM d),
hit AS (SELECT d.doc_id, rule, o, k FROM d JOIN k ON length(k) >= 4 AND contains(n, k)),
s AS (SELECT doc_id, rule, sum(CASE WHEN length(k) > 14 THEN 18 ELSE 10 END) + CASE WHEN count(*) >= 3 THEN 20 ELSE 0 END + CASE WHEN count(*) >= 5 THEN 25 ELSE 0 END AS s, string_agg(k, '|' ORDER BY o) AS f FROM hit GROUP BY doc_id, rule),
-- without a hit only the first rules matter
z AS (SELECT doc_id, rule, 0 AS s, '' AS f FROM d, (SELECT DISTINCT rule FROM k WHERE length(k) >= 4 ORDER BY rule LIMIT 8) ),
a AS (SELECT * FROM s UNION ALL SELECT z.* FROM z LEFT JOIN s ON s.doc_id = z.doc_id AND s.rule = z.rule WHERE s.rule IS NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, rule) AS rn FROM a)
SELECT doc_id, max(CASE WHEN rn = 1 THEN CASE WHEN s > 0 THEN 'rule ' || rule ELSE 'Unknown Travel / Immigration Document' END END) AS type, max(CASE WHEN rn = 1 THEN 'r' || rule % 7 END) AS route, CAST(max(CASE WHEN rn = 1 THEN least(99, s) END) AS INTEGER) AS confidence,
  md5(max(CASE WHEN rn = 1 THEN f END)) AS matched_md5, string_agg(CASE WHEN rn BETWEEN 2 AND 4 THEN 'rule ' || rule || ':' || CAST(CAST(least(99, s) AS INTEGER) AS VARCHAR) END, '|' ORDER BY rn) AS alternatives
FROM r WHERE rn <= 4 GROUP BY doc_id
"""


# labelled fields in forms made from customers and their orders

def label_values(spark, sf):
    c = spread(_t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")).join(F.broadcast(_t(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    text = F.concat_ws("\n", F.lit("Holder information"), F.when(k % 2 == 0, F.concat(F.lit("Surname: "), F.col("c_mktsegment"))).otherwise(F.concat(F.lit("SURNAME\n"), F.col("c_mktsegment"))), F.concat(F.lit("Nationality - "), F.col("n_name")), F.lit("Entries"), F.lit("Sex: m"), F.concat(F.lit("Document No: "), _number(k)))
    c = c.select(k, fields.clean_lines(text).alias("lines"))
    v = lambda *x: fields.labelled_value(F.col("lines"), *x)
    return c.select("c_custkey", v("FAMILY NAME", "SURNAME").alias("surname"), v("NATIONALITY").alias("nationality"), fields.sex(v("SEX", "GENDER")).alias("sex"), v("ENTRIES").alias("entries"), fields.document_number(F.col("lines"), F.array_join("lines", "\n")).alias("number"))


LABEL_VALUES = """
SELECT c_custkey, trim(upper(c_mktsegment)) AS surname, trim(regexp_replace(upper(n_name), '[^A-Z ]+', ' ', 'g')) AS nationality, 'M' AS sex, '' AS entries, upper(lpad(hex(c_custkey), 9, '0')) AS number
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def date_extract(spark, sf):
    o = _t(spark, sf, "orders")
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = F.when(k == 0, F.date_format(day, "yyyy/MM/dd")).when(k == 1, F.date_format(day, "d.M.yyyy")).when(k == 2, F.concat(F.lit("on "), F.date_format(day, "dd MMM yyyy"))).otherwise(F.date_format(day, "dd-MM-yy"))
    return o.select("o_orderkey", dates.secondary_date(text).alias("secondary"), dates.primary_date(text).alias("primary_text"), dates.visa_date(text).alias("visa"), dates.residence_date(text).alias("residence"))


DATE_EXTRACT = """
WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders)
SELECT o_orderkey, iso AS secondary, CASE WHEN k = 1 THEN '' ELSE iso END AS primary_text, CASE WHEN k IN (1, 3) THEN iso WHEN k = 0 THEN '20' || substr(iso, 9, 2) || '-' || substr(iso, 6, 2) || '-' || substr(iso, 3, 2) ELSE '' END AS visa, CASE WHEN k = 2 THEN '' ELSE iso END AS residence FROM o
"""


def mrz_date_pivot(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MMdd")).alias("v"))
    o = o.withColumns({"birth": dates.mrz_date(F.col("v"), "birth", AS_OF), "expiry": dates.mrz_date(F.col("v"), "expiry", AS_OF)})
    s = dates.expiry_status(F.col("expiry"), AS_OF)
    return o.select("o_orderkey", "birth", "expiry", dates.is_date(F.col("birth"), "birth", AS_OF).alias("birth_ok"), dates.is_date(F.col("expiry"), "expiry", AS_OF).alias("expiry_ok"), s["status"].alias("status"), s["daysUntilExpiry"].alias("days_left"), s["daysExpired"].alias("days_gone"))


MRZ_DATE_PIVOT = f"""
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS yy, strftime(o_orderdate, '-%m-%d') AS md FROM orders),
y AS (SELECT o_orderkey, CAST(CASE WHEN yy > 26 THEN 1900 + yy ELSE 2000 + yy END AS VARCHAR) || md AS birth, CAST(CASE WHEN 2000 + yy < 2021 THEN 2100 + yy ELSE 2000 + yy END AS VARCHAR) || md AS expiry FROM o),
d AS (SELECT *, date_diff('day', DATE '{AS_OF}', TRY_CAST(expiry AS DATE)) AS n FROM y)
SELECT o_orderkey, birth, expiry, TRY_CAST(birth AS DATE) IS NOT NULL AS birth_ok, coalesce(TRY_CAST(expiry AS DATE) IS NOT NULL AND CAST(substr(expiry, 1, 4) AS INTEGER) BETWEEN 1996 AND 2056, false) AS expiry_ok,
  CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n < 0 THEN 'EXPIRED' WHEN n <= 30 THEN 'EXPIRING_SOON' ELSE 'VALID' END AS status, CAST(CASE WHEN n >= 0 THEN n END AS INTEGER) AS days_left, CAST(CASE WHEN n < 0 THEN -n END AS INTEGER) AS days_gone
FROM d
"""


def name_similarity(spark, sf):
    p = _t(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("a"), F.upper("p_type").alias("b"))
    split = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    return p.select("p_partkey", F.round(compare.similarity(F.col("a"), F.col("b")), 6).alias("similarity"), F.round(compare.token_overlap(split(F.concat_ws(" ", "a", "b")), split(F.col("b"))), 6).alias("overlap"))


NAME_SIMILARITY = """
WITH p AS (SELECT p_partkey, upper(p_name) AS a, upper(p_type) AS b FROM part),
t AS (SELECT *, list_distinct(list_filter(string_split(a || ' ' || b, ' '), lambda x: x <> '')) AS x, list_distinct(list_filter(string_split(b, ' '), lambda y: y <> '')) AS y FROM p)
SELECT p_partkey, round(CAST(greatest(length(a), length(b)) - levenshtein(a, b) AS DOUBLE) / greatest(length(a), length(b)), 6) AS similarity,
  round(CAST(len(list_filter(x, lambda s: len(list_filter(y, lambda u: s = u OR CAST(greatest(length(s), length(u)) - levenshtein(s, u) AS DOUBLE) / greatest(length(s), length(u)) >= 0.84)) > 0)) AS DOUBLE) / greatest(len(x), len(y)), 6) AS overlap
FROM t
"""

_CODES = ("AFG", "D<<", "utx", "UTO", "GBR", "QQQ", "CIV", "USA", "XXA", "VNM", "", "TUR", "KOR")


def country_lookup(spark, sf):
    """Codes of nations with their names: a left join with the dimension, which has under 300 rows by nature."""
    codes = F.array(*[F.lit(c) for c in _CODES])
    n = _t(spark, sf, "nation").select("n_nationkey", normal_code(F.get(codes, (F.col("n_nationkey") % len(_CODES)).cast("int"))).alias("code"))
    j = n.join(F.broadcast(country_table(spark)), "code", "left")
    return j.select("n_nationkey", "code", F.coalesce("name", "code").alias("country"), F.col("name").isNotNull().alias("known"))


COUNTRY_LOOKUP = f"""
WITH n AS (SELECT n_nationkey, regexp_replace(upper(list_extract([{", ".join(f"'{c}'" for c in _CODES)}], CAST(n_nationkey % {len(_CODES)} + 1 AS INTEGER))), '[^A-Z]', '', 'g') AS code FROM nation),
c AS (SELECT * FROM (VALUES ('AFG', 'Afghanistan'), ('D', 'Germany'), ('UTO', 'Utopia'), ('GBR', 'United Kingdom'), ('CIV', 'Côte d''Ivoire'), ('USA', 'United States of America'), ('XXA', 'Stateless person'), ('VNM', 'Viet Nam'), ('TUR', 'Türkiye'), ('KOR', 'Korea, Republic of')) v(code, name))
SELECT n_nationkey, n.code, coalesce(c.name, n.code) AS country, c.name IS NOT NULL AS known FROM n LEFT JOIN c ON n.code = c.code
"""


# reconciliation of customers (primary) with their first orders (secondary)

def _pairs(spark, sf) -> DataFrame:
    first = _t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    c = _t(spark, sf, "customer").join(first, "c_custkey")
    k, o = F.col("c_custkey"), F.col("o")
    born = F.date_format(F.date_add(F.lit(dt.date(1960, 1, 1)), (k % 9000).cast("int")), "yyyy-MM-dd")
    other = F.date_format(F.date_add(F.lit(dt.date(1960, 1, 1)), (k % 9000).cast("int") + 1), "yyyy-MM-dd")
    p = F.struct(F.lit("").alias("fullName"), F.lit("ANNA").alias("givenNames"), F.col("c_mktsegment").alias("surname"), born.alias("dateOfBirth"), F.when(k % 2 == 0, "M").otherwise("X").alias("gender"), F.lit("").alias("holderNumber"), _number(k).alias("documentNumber"),
                 F.lit("UTO").alias("nationality"), F.lit("ARE").alias("issuingCountry"), F.lit("2030-01-01").alias("expiryDate"), F.when(k % 7 == 0, "").otherwise("P<UTO").alias("mrzRawData"))
    s = F.struct(F.when(o % 5 == 0, "JOHN SMITHSON").when(o % 5 == 1, F.concat(F.col("c_mktsegment"), F.lit(" ANNA"))).otherwise(F.concat(F.lit("Anna "), F.col("c_mktsegment"))).alias("fullName"), F.lit("").alias("givenNames"), F.lit("").alias("surname"),
                 F.when(o % 3 == 0, other).otherwise(born).alias("dateOfBirth"), F.lit("MALE").alias("gender"), F.when(o % 4 == 0, "").when(o % 4 == 1, F.translate(_number(k), "0", "O")).when(o % 4 == 2, F.lit("QQQQQ")).otherwise(_number(k)).alias("holderNumber"),
                 F.when(o % 2 == 0, "UTO").otherwise("").alias("nationality"), F.when(o % 6 == 1, "UTOPIA").otherwise("").alias("citizenship"), F.when(o % 3 == 1, "United Arab Emirates").otherwise("").alias("issuingCountry"),
                 F.when(k % 5 == 0, "2020-01-01").when(k % 5 == 1, "2025-13-40").when(k % 5 == 2, "").otherwise("2027-01-01").alias("expiryDate"), F.lit("Visa").alias("documentType"))
    return c.select("c_custkey", p.alias("primary"), s.alias("secondary"))


def compare_verdict(spark, sf):
    return compare.compare_records(_pairs(spark, sf), AS_OF).select("c_custkey", "score", "decision", F.col("riskLevel").alias("risk"), "reason")


def compare_fields(spark, sf):
    v = compare.compare_records(_pairs(spark, sf), AS_OF)
    return compare.comparison_rows(v, "c_custkey").select("c_custkey", F.col("field_ord").cast("int").alias("field_ord"), "label", "status", F.col("statusClass").alias("status_class"), "score", "weight", "critical")


def alerts_concat(spark, sf):
    v = compare.compare_records(_pairs(spark, sf), AS_OF)
    return v.select("c_custkey", F.size("alerts").alias("n_alerts"), F.array_join("alerts", "\n").alias("alerts"))


_FIELDS_SQL = """
WITH c AS (SELECT c_custkey, c_mktsegment, upper(lpad(hex(c_custkey), 9, '0')) AS num, min(o_orderkey) AS o FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
f AS (
  SELECT c_custkey AS k, 0 AS field_ord, 'Full Name' AS label, CASE WHEN o % 5 = 0 THEN 'Mismatch' WHEN o % 5 = 1 THEN 'Partial Match' ELSE 'Exact Match' END AS status, CASE WHEN o % 5 = 0 THEN 0 WHEN o % 5 = 1 THEN 92 ELSE 100 END AS score, 25 AS weight, false AS critical,
    CASE WHEN o % 5 = 0 THEN 'Names do not match.' ELSE 'Same name tokens detected, but order is different.' END AS note FROM c
  UNION ALL SELECT c_custkey, 1, 'Date of Birth', CASE WHEN o % 3 = 0 THEN 'Mismatch' ELSE 'Exact Match' END, CASE WHEN o % 3 = 0 THEN 0 ELSE 100 END, 25, false, 'Values are different.' FROM c
  UNION ALL SELECT c_custkey, 2, 'Gender', CASE WHEN c_custkey % 2 = 0 THEN 'Exact Match' ELSE 'Missing' END, CASE WHEN c_custkey % 2 = 0 THEN 100 ELSE 65 END, 10, false, 'Gender could not be confidently normalized.' FROM c
  UNION ALL SELECT c_custkey, 3, 'Passport Number', CASE WHEN o % 4 = 0 THEN 'Not Available' WHEN o % 4 = 2 THEN 'Mismatch' WHEN o % 4 = 3 OR NOT contains(num, '0') THEN 'Exact Match' ELSE 'Partial Match' END,
    CASE WHEN o % 4 = 0 THEN 75 WHEN o % 4 = 2 THEN 0 WHEN o % 4 = 3 OR NOT contains(num, '0') THEN 100 ELSE 90 END, 15, o % 4 <> 0,
    CASE WHEN o % 4 = 0 THEN 'Secondary document does not show a passport number. This is acceptable for some document types.' WHEN o % 4 = 2 THEN 'Values are different.' ELSE 'Values match after OCR confusion correction.' END FROM c
  UNION ALL SELECT c_custkey, 4, CASE WHEN o % 2 = 0 THEN 'Nationality' ELSE 'Nationality / Citizenship' END, CASE WHEN o % 2 = 0 THEN 'Exact Match' WHEN o % 6 = 1 THEN 'Information Only' ELSE 'Missing' END, CASE WHEN o % 2 = 0 THEN 100 WHEN o % 6 = 1 THEN 85 ELSE 65 END, 10, false,
    CASE WHEN o % 6 = 1 THEN 'Secondary document shows citizenship. Citizenship may differ from issuing country or travel document nationality.' ELSE 'Secondary document nationality/citizenship was not detected.' END FROM c
  UNION ALL SELECT c_custkey, 5, 'Issuing Country', CASE WHEN o % 3 = 1 THEN 'Exact Match' ELSE 'Not Available' END, CASE WHEN o % 3 = 1 THEN 100 ELSE 75 END, 5, false, 'Secondary document issuing country was not detected.' FROM c
  UNION ALL SELECT c_custkey, 6, 'Primary Document Expiry', 'Valid', 100, 5, false, '' FROM c
  UNION ALL SELECT c_custkey, 7, 'Secondary Document Expiry', CASE c_custkey % 5 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Invalid Date' WHEN 2 THEN 'Missing' ELSE 'Valid' END, CASE c_custkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 70 ELSE 100 END, 5, c_custkey % 5 = 0,
    CASE c_custkey % 5 WHEN 1 THEN 'Date format could not be validated.' ELSE 'Expiry date was not detected.' END FROM c)
"""
COMPARE_FIELDS = _FIELDS_SQL + """
SELECT k AS c_custkey, field_ord, label, status, CASE WHEN status IN ('Exact Match', 'Valid') THEN 'match' WHEN status IN ('Mismatch', 'Expired') THEN 'mismatch' ELSE 'partial' END AS status_class, score, weight, critical FROM f
"""
COMPARE_VERDICT = _FIELDS_SQL + """
, a AS (SELECT k, CAST(floor(CAST(sum(score * weight) AS DOUBLE) / sum(weight) + 0.5) AS INTEGER) AS score, bool_or(critical AND status IN ('Expired', 'Mismatch')) OR count(*) FILTER (status = 'Mismatch' AND field_ord < 2) = 2 AS bad,
  count(*) FILTER (status IN ('Partial Match', 'Missing', 'Not Available', 'Invalid Date')) AS warned, string_agg(CASE WHEN critical AND status IN ('Expired', 'Mismatch') THEN label END, ', ' ORDER BY field_ord) AS why FROM f GROUP BY k),
d AS (SELECT *, CASE WHEN bad THEN 'REJECTED' WHEN score >= 92 THEN 'VERIFIED' WHEN score >= 78 THEN 'VERIFIED WITH WARNINGS' ELSE 'MANUAL REVIEW REQUIRED' END AS decision FROM a)
SELECT k AS c_custkey, score, decision, CASE decision WHEN 'VERIFIED' THEN 'LOW' WHEN 'VERIFIED WITH WARNINGS' THEN 'MEDIUM' WHEN 'REJECTED' THEN 'HIGH' ELSE CASE WHEN score >= 70 THEN 'MEDIUM' ELSE 'HIGH' END END AS risk,
  CASE decision WHEN 'VERIFIED' THEN 'All critical identity fields are valid and matched.' WHEN 'VERIFIED WITH WARNINGS' THEN 'Identity appears acceptable, but ' || CAST(warned AS VARCHAR) || ' field(s) require attention.'
    WHEN 'REJECTED' THEN 'Critical issue detected: ' || coalesce(why, 'identity mismatch') || '.' ELSE 'Document data could not be verified confidently and requires manual review.' END AS reason
FROM d
"""
ALERTS_CONCAT = _FIELDS_SQL + """
, l AS (SELECT k, field_ord, CASE status WHEN 'Mismatch' THEN '❌ ' || label || ': ' || note WHEN 'Expired' THEN '❌ ' || label || ': document is expired.' WHEN 'Information Only' THEN 'ℹ ' || label || ': ' || note ELSE '⚠ ' || label || ': ' || note END AS t FROM f WHERE status NOT IN ('Exact Match', 'Valid')
  UNION ALL SELECT k, 8, '⚠ Primary document MRZ was not detected clearly.' FROM f WHERE field_ord = 0 AND k % 7 = 0 UNION ALL SELECT k, 9, 'ℹ Secondary document detected as: Visa.' FROM f WHERE field_ord = 0)
SELECT k AS c_custkey, CAST(count(*) AS INTEGER) AS n_alerts, string_agg(t, chr(10) ORDER BY field_ord) AS alerts FROM l GROUP BY k
"""


# sinks and sources

def unpivot_record(spark, sf):
    c = _t(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("fullName"), F.col("c_nationkey").alias("nationCode"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("marketSegment"))
    return sinks.data_table(c, "c_custkey")


UNPIVOT_RECORD = """
SELECT c_custkey, 0 AS field_ord, 'Full Name' AS label, c_name AS value FROM customer
UNION ALL SELECT c_custkey, 1, 'Nation Code', CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 2, 'Market Segment', CASE WHEN c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL THEN 'Not detected' ELSE c_mktsegment END FROM customer
"""


def best_attempt(spark, sf):
    e = _t(spark, sf, "events").select("user_id", "event_id", F.floor("value").cast("int").alias("score"), "event_type")
    b = best_page(e, "user_id", "event_id", "score", ["event_type"])
    return b.select("user_id", "event_id", "score", "event_type", F.size("attempts").alias("n_attempts"))


BEST_ATTEMPT = """
WITH e AS (SELECT user_id, event_id, CAST(floor(value) AS INTEGER) AS score, event_type, row_number() OVER (PARTITION BY user_id ORDER BY floor(value) DESC, event_id) AS rn, CAST(count(*) OVER (PARTITION BY user_id) AS INTEGER) AS n_attempts FROM events)
SELECT user_id, event_id, score, event_type, n_attempts FROM e WHERE rn = 1
"""


def file_checks(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 6
    head = F.when(k == 0, F.lit("%PDF-1.7")).when(k == 1, F.lit("GIF89a")).when(k == 2, F.lit("RIFF1234WEBP")).when(k == 3, F.lit("%PDXXXXX")).otherwise(F.lit("plain text"))
    d = d.select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).cast("binary").alias("content"), F.concat(F.lit("/in/x."), F.element_at(F.array(*[F.lit(x) for x in ("pdf", "gif", "webp", "pdf", "txt", "PNG")]), (k + 1).cast("int"))).alias("path"))
    d = d.withColumn("mime", files.media_type(F.col("path"))).withColumn("length", F.when(k == 5, 16 * 1024 * 1024).otherwise(F.octet_length("content")).cast("long"))
    return files.check_files(d).select("doc_id", "mime", files.image_kind(F.col("content")).alias("kind"), "error", F.substring(files.data_url(F.col("mime"), files.header(F.col("content"), 6)), 1, 60).alias("url"))


FILE_CHECKS = """
WITH d AS (SELECT doc_id, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/webp' WHEN 3 THEN 'application/pdf' WHEN 4 THEN 'application/octet-stream' ELSE 'image/png' END AS mime, CASE k WHEN 1 THEN 'gif' WHEN 2 THEN 'webp' END AS kind,
  CASE k WHEN 3 THEN 'File is not a PDF.' WHEN 4 THEN 'Unsupported file type.' WHEN 5 THEN 'File exceeds the maximum size.' END AS error,
  CASE k WHEN 0 THEN 'data:application/pdf;base64,JVBERi0x' WHEN 1 THEN 'data:image/gif;base64,R0lGODlh' WHEN 2 THEN 'data:image/webp;base64,UklGRjEy' WHEN 3 THEN 'data:application/pdf;base64,JVBEWFhY' WHEN 4 THEN 'data:application/octet-stream;base64,cGxhaW4g' ELSE 'data:image/png;base64,cGxhaW4g' END AS url
FROM d
"""


def page_numbers(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 8).cast("int").alias("total"), F.array(*[((F.col("o_custkey") + i * 3) % 9 - 1).cast("int") for i in range(6)]).alias("wanted"))
    show = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    t, w = F.col("total"), F.col("wanted")
    return o.select("o_orderkey", show(files.pages_to_render(t)).alias("first_pages"), show(files.pages_to_render(t, w)).alias("wanted_pages"), show(files.sorted_pages(t, w)).alias("sorted_pages"), files.preview_page(F.get(w, F.lit(0)), t).alias("preview"))


PAGE_NUMBERS = """
WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 8 AS INTEGER) AS total, list_transform(range(0, 6), lambda i: CAST((o_custkey + i * 3) % 9 - 1 AS INTEGER)) AS wanted FROM orders)
SELECT o_orderkey, array_to_string(range(1, least(total, 5) + 1), ',') AS first_pages, array_to_string(list_filter(wanted, lambda p: p BETWEEN 1 AND total)[1:5], ',') AS wanted_pages,
  array_to_string(list_sort(list_distinct(list_filter(wanted, lambda p: p BETWEEN 1 AND least(total, 5)))), ',') AS sorted_pages, least(greatest(wanted[1], 1), total) AS preview FROM o
"""


def escape_html(spark, sf):
    d = _t(spark, sf, "pages")
    return d.select("page_id", F.md5(sinks.escape_html(F.col("html")).cast("binary")).alias("escaped_md5"))


ESCAPE_HTML = "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;')) AS escaped_md5 FROM pages"


def accents(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(strip_accents(F.col("text")).cast("binary")).alias("plain_md5"))


ACCENTS = "SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents"


# the whole plan

def _case_pages(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    # dealt by case before anything is made, so that no record is shuffled
    z = _zone(spread(_t(spark, sf, "customer").select(k, k.cast("string").alias("case_id")), "case_id"))
    zone = F.concat_ws("\n", "line1", "line2")
    visa = F.concat_ws("\n", F.lit("RESIDENCE VISA"), F.concat(F.lit("PASSPORT NO: "), F.when(k % 4 == 0, "ZZZZ99999").otherwise(F.col("number"))), F.concat(F.lit("SURNAME: "), F.col("surname")), F.lit("GIVEN NAMES: ANNA MARIA"), F.lit("NATIONALITY: UTO"),
                       F.concat(F.lit("DATE OF BIRTH: 19"), F.substring("birth", 1, 2), F.lit("-"), F.substring("birth", 3, 2), F.lit("-"), F.substring("birth", 5, 2)), F.concat(F.lit("SEX: "), F.col("sex")), F.lit("VALID UNTIL: 2027-01-01"))
    page = lambda role, n, full, mrz_text: F.struct(F.lit(role).alias("role"), F.lit(n).alias("page_number"), full.alias("full_text"), mrz_text.alias("mrz_text"))
    none = F.lit(None).cast("string")
    pages = F.array(page("primary", 1, F.lit("cover"), none), page("primary", 2, F.lit("PASSPORT"), zone), page("secondary", 1, visa, none), page("secondary", 2, F.lit("back"), none))
    return z.select("case_id", F.explode(pages).alias("p")).select("case_id", "p.*")


def verify_cases(spark, sf):
    from papyra.plans.verify import run

    v = run(_case_pages(spark, sf), AS_OF)["verdicts"]
    return v.select("case_id", "decision", F.col("riskLevel").alias("risk"), "score", "reason")


VERIFY_CASES = """
SELECT CAST(c_custkey AS VARCHAR) AS case_id, CASE WHEN c_custkey % 4 = 0 THEN 'REJECTED' ELSE 'VERIFIED' END AS decision, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' ELSE 'LOW' END AS risk, CASE WHEN c_custkey % 4 = 0 THEN 84 ELSE 99 END AS score,
  CASE WHEN c_custkey % 4 = 0 THEN 'Critical issue detected: Passport Number.' ELSE 'All critical identity fields are valid and matched.' END AS reason
FROM customer
"""


def primary_records(spark, sf):
    p = _case_pages(spark, sf).where("role = 'primary'")
    return read_primary(p, AS_OF).select("case_id", F.col("documentType").alias("document_type"), F.col("holderNumber").alias("number"), "surname", F.col("givenNames").alias("given_names"), F.col("dateOfBirth").alias("birth"), "gender", F.col("checkAllValid").alias("checks"), F.col("selectedPage").alias("page"), F.col("processingScore").alias("score"))


PRIMARY_RECORDS = f"""
WITH z AS ({_ZONE_SQL})
SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'Passport' AS document_type, number, surname, 'ANNA MARIA' AS given_names, birth, CASE WHEN male THEN 'M' ELSE 'F' END AS gender, 'PASS' AS checks, 2 AS page, 100 AS score FROM z
"""


def secondary_records(spark, sf):
    s = _case_pages(spark, sf).where("role = 'secondary'")
    return read_secondary(s).select("case_id", F.col("documentType").alias("document_type"), F.col("holderNumber").alias("number"), "surname", F.col("fullName").alias("full_name"), F.col("dateOfBirth").alias("birth"), "gender", F.col("expiryDate").alias("expiry"), F.col("selectedPage").alias("page"))


SECONDARY_RECORDS = f"""
WITH z AS ({_ZONE_SQL})
SELECT CAST(c_custkey AS VARCHAR) AS case_id, 'Visa' AS document_type, CASE WHEN c_custkey % 4 = 0 THEN 'ZZZZ99999' ELSE number END AS number, surname, 'ANNA MARIA ' || surname AS full_name, birth, CASE WHEN male THEN 'M' ELSE 'F' END AS gender, '2027-01-01' AS expiry, 1 AS page FROM z
"""

QUERIES = {
    "check_digit": (check_digit, CHECK_DIGIT),
    "check_digit_correct": (check_digit_correct, CHECK_DIGIT_CORRECT),
    "mrz_td3_parse": (mrz_td3_parse, MRZ_TD3_PARSE),
    "mrz_lines": (mrz_lines, MRZ_LINES),
    "clean_lines": (clean_lines, CLEAN_LINES),
    "classify_keywords": (classify_keywords, CLASSIFY_KEYWORDS),
    "classify_table": (classify_table, CLASSIFY_TABLE),
    "label_values": (label_values, LABEL_VALUES),
    "date_extract": (date_extract, DATE_EXTRACT),
    "mrz_date_pivot": (mrz_date_pivot, MRZ_DATE_PIVOT),
    "name_similarity": (name_similarity, NAME_SIMILARITY),
    "country_lookup": (country_lookup, COUNTRY_LOOKUP),
    "compare_fields": (compare_fields, COMPARE_FIELDS),
    "compare_verdict": (compare_verdict, COMPARE_VERDICT),
    "alerts_concat": (alerts_concat, ALERTS_CONCAT),
    "unpivot_record": (unpivot_record, UNPIVOT_RECORD),
    "best_attempt": (best_attempt, BEST_ATTEMPT),
    "file_checks": (file_checks, FILE_CHECKS),
    "page_numbers": (page_numbers, PAGE_NUMBERS),
    "escape_html": (escape_html, ESCAPE_HTML),
    "accents": (accents, ACCENTS),
    "primary_records": (primary_records, PRIMARY_RECORDS),
    "secondary_records": (secondary_records, SECONDARY_RECORDS),
    "verify_cases": (verify_cases, VERIFY_CASES),
} | zone_queries.QUERIES | sql_queries.QUERIES | view_queries.QUERIES
_SINK_SQL = view_queries.sink_sql(COMPARE_VERDICT, ALERTS_CONCAT, COMPARE_FIELDS)
QUERIES |= {name: (query, _SINK_SQL[name]) for name, query in view_queries.SINKS.items()}
