"""Queries over zones of all formats, sound and misread, and over the readers of visible text, with the same in DuckDB SQL.

Texts are made from customers; the SQL works out check digits, scores and fields from the same columns in its own way.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions import checkdigit as cd
from papyra.functions.names import parse_name
from papyra.operators import mrz, variants
from papyra.operators.primary import read_visible
from papyra.operators.specialised import read_schengen, read_uae

from .tables import spread

AS_OF = dt.date(2026, 11, 26)

def _k() -> Column:
    return F.col("c_custkey")


def keys(spark, sf) -> DataFrame:
    """The customers' keys, from which all texts follow."""
    return spread(spark.read.parquet(f"{sf}/customer.parquet").select(_k()))


def digit_sql(x: str, n: int) -> str:
    return f"(list_sum(list_transform(range(1, {n + 1}), lambda i: greatest(instr('{cd.ALPHABET}', substr({x}, i, 1)) - 1, 0) * list_extract([7, 3, 1], CAST((i - 1) % 3 + 1 AS INTEGER)))) % 10)"


def _digit(x: Column, n: int) -> Column:
    return cd.check_digit(x, n).cast("string")


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _of(values: tuple[str, ...], n: int | None = None) -> Column:
    """The value that a customer's key points at."""
    return F.get(F.array(*[F.lit(v) for v in values]), (_k() % (n or len(values))).cast("int"))


def _of_sql(values: tuple[str, ...], n: int | None = None) -> str:
    return "list_extract([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"], CAST(k % {n or len(values)} + 1 AS INTEGER))"


def _surname() -> Column:
    return F.concat(F.lit("WATER"), F.translate(F.lpad((_k() % 1000).cast("string"), 3, "0"), "0123456789", "ABDEFGHJMN"))


_SURNAME_SQL = "'WATER' || translate(lpad(CAST(k % 1000 AS VARCHAR), 3, '0'), '0123456789', 'ABDEFGHJMN')"
_NUMBER_SQL = "'A' || lpad(CAST(k * 7919 % 100000000 AS VARCHAR), 8, '0')"
_MD_SQL = "lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0')"


def _base(spark, sf, first_year: int, years: int) -> DataFrame:
    md = F.concat(_two(1 + _k() % 12), _two(1 + _k() % 28))
    number = F.concat(F.lit("A"), F.lpad((_k() * 7919 % 100000000).cast("string"), 8, "0"))
    return keys(spark, sf).select(_k(), _surname().alias("surname"), F.concat(_two(30 + _k() % 60), md).alias("birth"), F.concat(_two(first_year + _k() % years), md).alias("expiry"), number.alias("number"))


# zones of the three formats

CODES3, CODES12 = ("P<", "PD", "PS", "PO", "PT", "PR", "PN"), ("I<", "ID", "C<", "A<", "IP", "V<", "I<")
_SEXES, _ISSUERS = ("M", "F", "X", "<"), ("UTO", "GBR", "USA", "D<<")


def mrz_formats(spark, sf):
    """Sound zones in three formats, with seven codes, known and unknown countries, and dates that are past, near and ahead.

    Lines whose country has fewer than three letters open no zone.
    """
    c = _base(spark, sf, 22, 14)
    issuer = F.when(_k() % 11 == 0, "QQQ").otherwise(_of(_ISSUERS))
    c = c.withColumns({"issuer": issuer, "nation": F.when(_k() % 5 == 0, "FRA").otherwise(issuer), "sex": _of(_SEXES), "code": F.when(_k() % 3 == 0, _of(CODES3)).otherwise(_of(CODES12))})
    c = c.withColumns({"n": F.concat("number", _digit(F.col("number"), 9)), "b": F.concat("birth", _digit(F.col("birth"), 6)), "e": F.concat("expiry", _digit(F.col("expiry"), 6)), "more": F.when(_k() % 2 == 1, F.concat(F.lit("Z"), F.lpad((_k() % 10000).cast("string"), 4, "0"))).otherwise("")})
    name = F.concat("code", "issuer", "surname", F.lit("<<ANNA<MARIA"))
    td3 = F.concat_ws("\n", F.rpad(name, 44, "<"), F.concat("n", "nation", "b", "sex", "e", F.rpad("more", 15, "<"), _digit(F.concat("n", "b", "e", F.rpad("more", 15, "<")), 39)))
    td2 = F.concat_ws("\n", F.rpad(name, 36, "<"), F.concat("n", "nation", "b", "sex", "e", F.rpad("more", 7, "<"), _digit(F.concat("n", "b", "e", F.rpad("more", 7, "<")), 31)))
    one = F.concat("code", "issuer", "n", F.rpad("more", 15, "<"))
    td1 = F.concat_ws("\n", one, F.concat("b", "sex", "e", "nation", F.lit("<" * 11), _digit(F.concat(F.substr(one, F.lit(6)), "b", "e", F.lit("<" * 11)), 50)), F.rpad(F.concat("surname", F.lit("<<ANNA<MARIA")), 30, "<"))
    m = F.col("mrz")
    text = F.when(_k() % 3 == 0, td3).when(_k() % 3 == 1, td2).otherwise(td1)
    return mrz.parse_mrz(c.select("c_custkey", text.alias("text")), "text", AS_OF).select(
        "c_custkey", m["mrzFormat"].alias("format"), m["documentType"].alias("type"), m["documentSubtype"].alias("subtype"), m["surname"].alias("surname"), m["givenNames"].alias("given_names"), m["documentNumber"].alias("number"), m["nationality"].alias("nationality"),
        m["nationalityCode"].alias("nation_code"), m["issuingCountryCode"].alias("issuer_code"), m["dateOfBirth"].alias("birth"), m["gender"].alias("gender"), m["expiryDate"].alias("expiry"), m["expiryStatus"]["status"].alias("status"),
        m["checkDigits"]["composite"].alias("composite"), m["checkDigits"]["allValid"].alias("all_valid"), m["candidateScore"].alias("candidate_score"), m["confidence"]["score"].alias("confidence"), m["confidence"]["grade"].alias("grade"), F.array_join(m["warnings"], "|").alias("warnings"),
    )


_NAMES_SQL = "CASE {} WHEN 'UTO' THEN 'Utopia' WHEN 'GBR' THEN 'United Kingdom' WHEN 'USA' THEN 'United States of America' WHEN 'D' THEN 'Germany' WHEN 'FRA' THEN 'France' ELSE {} END"
MRZ_FORMATS = f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
p AS (SELECT k, {_SURNAME_SQL} AS surname, {_NUMBER_SQL} AS number, CAST(30 + k % 60 AS VARCHAR) || {_MD_SQL} AS birth, CAST(22 + k % 14 AS VARCHAR) || {_MD_SQL} AS expiry, CASE WHEN k % 11 = 0 THEN 'QQQ' ELSE {_of_sql(_ISSUERS)} END AS issuer,
  {_of_sql(_SEXES)} AS sex, replace(CASE WHEN k % 3 = 0 THEN {_of_sql(CODES3)} ELSE {_of_sql(CODES12)} END, '<', '') AS code, rpad(CASE WHEN k % 2 = 1 THEN 'Z' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') ELSE '' END, 7, '<') AS more FROM c),
q AS (SELECT *, CASE WHEN k % 5 = 0 THEN 'FRA' ELSE issuer END AS nation, number || CAST({digit_sql("number", 9)} AS VARCHAR) || birth || CAST({digit_sql("birth", 6)} AS VARCHAR) || expiry || CAST({digit_sql("expiry", 6)} AS VARCHAR) || more AS whole FROM p),
f AS (SELECT *, replace(issuer, '<', '') AS i3, replace(nation, '<', '') AS n3, whole || CAST({digit_sql("whole", 31)} AS VARCHAR) || '<<<<<<<' AS as_td3 FROM q),
g AS (SELECT *, CASE WHEN i3 = 'D' THEN 'NONE' WHEN k % 3 = 0 OR (k % 3 = 1 AND {digit_sql("as_td3", 39)} = 0) THEN 'TD3' WHEN k % 3 = 1 THEN 'TD2' WHEN i3 = 'QQQ' THEN 'NONE' ELSE 'TD1' END AS format, CAST('20' || substr(expiry, 1, 2) || '-' || substr(expiry, 3, 2) || '-' || substr(expiry, 5, 2) AS DATE) AS ends FROM f),
h AS (SELECT *, format <> 'NONE' AS ok, CASE WHEN ends < DATE '{AS_OF}' THEN 'EXPIRED' WHEN ends <= DATE '{AS_OF}' + 30 THEN 'EXPIRING_SOON' ELSE 'VALID' END AS state FROM g),
s AS (SELECT *, 75 + CASE WHEN state = 'VALID' THEN 15 ELSE 0 END + CASE WHEN n3 <> 'QQQ' THEN 10 ELSE 0 END AS trust FROM h)
SELECT k AS c_custkey, format, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN code IN ('PT', 'PR') THEN 'TRAVEL_DOCUMENT' WHEN code LIKE 'P%' THEN 'PASSPORT' WHEN code LIKE 'V%' THEN 'VISA' ELSE 'IDENTITY_CARD' END AS type,
  CASE WHEN NOT ok THEN 'UNKNOWN' WHEN code = 'PD' THEN 'DIPLOMATIC' WHEN code = 'PS' THEN 'SERVICE' WHEN code = 'PO' THEN 'OFFICIAL' WHEN code = 'PT' THEN 'TRAVEL_DOCUMENT' WHEN code = 'PR' THEN 'REFUGEE' WHEN code = 'IP' THEN 'PASSPORT_CARD' ELSE 'STANDARD' END AS subtype,
  CASE WHEN ok THEN surname ELSE '' END AS surname, CASE WHEN ok THEN 'ANNA MARIA' ELSE '' END AS given_names, CASE WHEN ok THEN number ELSE '' END AS number, CASE WHEN ok THEN {_NAMES_SQL.format("n3", "n3")} ELSE '' END AS nationality,
  CASE WHEN ok THEN n3 ELSE '' END AS nation_code, CASE WHEN ok THEN i3 ELSE '' END AS issuer_code, CASE WHEN ok THEN '19' || substr(birth, 1, 2) || '-' || substr(birth, 3, 2) || '-' || substr(birth, 5, 2) ELSE '' END AS birth,
  CASE WHEN ok AND sex = 'M' THEN 'MALE' WHEN ok AND sex = 'F' THEN 'FEMALE' ELSE 'UNSPECIFIED' END AS gender, CASE WHEN ok THEN CAST(ends AS VARCHAR) ELSE '' END AS expiry, CASE WHEN ok THEN state ELSE 'UNKNOWN' END AS status, ok AS composite, ok AS all_valid,
  CAST(CASE format WHEN 'TD3' THEN 150 WHEN 'TD2' THEN 130 WHEN 'TD1' THEN 125 END + CASE WHEN format <> 'TD1' AND i3 = n3 THEN 30 ELSE 0 END + CASE WHEN i3 <> 'QQQ' THEN 10 ELSE 0 END + CASE WHEN n3 <> 'QQQ' THEN 10 ELSE 0 END AS INTEGER) AS candidate_score,
  CASE WHEN ok THEN trust ELSE 0 END AS confidence, CASE WHEN NOT ok THEN 'LOW' WHEN trust >= 85 THEN 'HIGH' ELSE 'MEDIUM' END AS grade,
  CASE WHEN NOT ok THEN '{mrz.NOT_FOUND}' ELSE concat_ws('|', CASE WHEN n3 = 'QQQ' THEN 'Nationality code is not recognized.' END, CASE WHEN i3 = 'QQQ' THEN 'Issuing country code is not recognized.' END, CASE state WHEN 'EXPIRED' THEN 'Document is expired.' WHEN 'EXPIRING_SOON' THEN 'Document expires within 30 days.' END) END AS warnings
FROM s
"""


# zones misread in eight ways

def mrz_candidates(spark, sf):
    """Zones that are sound, have a letter for a digit or one too many, wrong digits or dates, fillers read as letters, or print
    within: what is accepted, by which score, and what is corrected."""
    z = _base(spark, sf, 27, 9)
    case = _k() % 8
    z = z.withColumns({"nd": _digit(F.col("number"), 9), "bd": _digit(F.col("birth"), 6), "ed": _digit(F.col("expiry"), 6)})
    z = z.withColumn("whole", _digit(F.concat("number", "nd", "birth", "bd", "expiry", "ed", F.lit("<" * 15)), 39))
    up = lambda c, n: ((F.col(c).cast("int") + n) % 10).cast("string")
    letters = lambda c, n: F.when(case == n, F.translate(c, "0", "O")).otherwise(F.col(c))
    z = z.withColumns({"number": letters("number", 1), "birth": letters("birth", 4), "expiry": F.when(case == 2, "990231").otherwise(letters("expiry", 4)), "nd": F.when(case == 7, up("nd", 1)).otherwise(F.col("nd")), "bd": F.when(case == 6, up("bd", 1)).when(case == 7, up("bd", 2)).otherwise(F.col("bd"))})
    two = F.concat("number", "nd", F.lit("UTO"), F.when(case == 3, "X").otherwise(""), "birth", "bd", F.lit("F"), "expiry", "ed", F.lit("<" * 15), "whole")
    one = F.when(case == 5, F.rpad(F.concat(F.lit("P<UTO"), "surname", F.lit("<CANNA<MARIA")), 44, "L")).when(_k() % 16 == 8, F.rpad(F.concat(F.lit("P<UTO"), "surname", F.lit("<<SIGNATURE")), 44, "<")).otherwise(F.rpad(F.concat(F.lit("P<UTO"), "surname", F.lit("<<ANNA<MARIA")), 44, "<"))
    m = F.col("mrz")
    found = mrz.parse_mrz(z.select("c_custkey", F.concat_ws("\n", one, two).alias("text")), "text", AS_OF)
    return found.select("c_custkey", m["mrzFormat"].alias("format"), m["candidateScore"].alias("score"), m["documentNumber"].alias("number"), m["surname"].alias("surname"), m["givenNames"].alias("given_names"), m["dateOfBirth"].alias("birth"), F.size(m["corrections"]).alias("corrections"),
                        m["checkDigits"]["documentNumber"].alias("number_valid"), m["checkDigits"]["dateOfBirth"].alias("birth_valid"), m["checkDigits"]["composite"].alias("composite"), m["checkDigits"]["allValid"].alias("all_valid"), m["confidence"]["score"].alias("confidence"))


MRZ_CANDIDATES = f"""
WITH c AS (SELECT c_custkey AS k FROM customer),
p AS (SELECT k, {_SURNAME_SQL} AS surname, {_NUMBER_SQL} AS number, CAST(30 + k % 60 AS VARCHAR) || {_MD_SQL} AS birth, CAST(27 + k % 9 AS VARCHAR) || {_MD_SQL} AS expiry FROM c),
q AS (SELECT *, {digit_sql("number", 9)} AS nd, {digit_sql("birth", 6)} AS bd, {digit_sql("expiry", 6)} AS ed, CASE WHEN k % 8 = 1 THEN replace(number, '0', 'O') ELSE number END AS read FROM p),
r AS (SELECT *, CAST(CASE WHEN k % 8 = 7 THEN (nd + 1) % 10 ELSE nd END AS VARCHAR) AS rnd, CAST(CASE WHEN k % 8 = 6 THEN (bd + 1) % 10 WHEN k % 8 = 7 THEN (bd + 2) % 10 ELSE bd END AS VARCHAR) AS rbd,
  number || CAST(nd AS VARCHAR) || birth || CAST(bd AS VARCHAR) || expiry || CAST(ed AS VARCHAR) AS sound FROM q),
s AS (SELECT *, {digit_sql("sound", 31)} AS whole, read || rnd || birth || rbd || expiry || CAST(ed AS VARCHAR) AS seen FROM r),
t AS (SELECT *, CAST({digit_sql("read", 9)} AS VARCHAR) = rnd AS n_ok, CAST(bd AS VARCHAR) = rbd AS b_ok, {digit_sql("seen", 31)} = whole AS three, {digit_sql("seen", 31)} = 0 AS two FROM s),
u AS (SELECT *, CASE WHEN k % 8 <> 2 AND k % 16 <> 8 AND CAST(n_ok AS INTEGER) + CAST(b_ok AS INTEGER) + CAST(three AS INTEGER) >= 1 THEN 120 + 25 * CAST(n_ok AS INTEGER) + 25 * CAST(b_ok AS INTEGER) + 30 * CAST(three AS INTEGER) END AS s3,
  CASE WHEN k % 8 <> 2 AND k % 16 <> 8 AND CAST(n_ok AS INTEGER) + CAST(b_ok AS INTEGER) + CAST(two AS INTEGER) >= 1 THEN 115 + 20 * CAST(n_ok AS INTEGER) + 20 * CAST(b_ok AS INTEGER) + 25 * CAST(two AS INTEGER) END AS s2 FROM t),
pos AS (SELECT k, read, rnd, list_filter(range(1, 10), lambda i: instr('{cd.NUMBER_FROM}', substr(read, i, 1)) > 0) AS pos FROM u WHERE NOT n_ok),
v AS (SELECT k, read, rnd, pos, len(pos) AS m, unnest(range(0, least(CAST(pow(2, len(pos)) AS BIGINT), 30))) AS j FROM pos),
w AS (SELECT k, rnd, j, bit_count(j) AS n, array_to_string(list_transform(range(1, 10), lambda i: CASE WHEN list_contains(pos, i) AND ((j >> CAST(m - list_position(pos, i) AS INTEGER)) & 1) = 1
  THEN translate(substr(read, i, 1), '{cd.NUMBER_FROM}', '{cd.NUMBER_TO}') ELSE substr(read, i, 1) END), '') AS value FROM v),
one AS (SELECT k, arg_min(value, j) AS value, arg_min(n, j) AS n FROM w WHERE CAST({digit_sql("value", 9)} AS VARCHAR) = rnd GROUP BY k),
f AS (SELECT u.*, one.value, one.n, coalesce(s3, 0) + coalesce(s2, 0) > 0 AS ok, coalesce(s3, 0) >= coalesce(s2, 0) AS is3 FROM u LEFT JOIN one USING (k)),
g AS (SELECT *, ok AND NOT n_ok AND value IS NOT NULL AS fixed, CASE WHEN is3 THEN three ELSE two END AS comp FROM f),
h AS (SELECT *, CASE WHEN fixed THEN NULL ELSE ok AND n_ok AND b_ok AND comp END AS every FROM g)
SELECT k AS c_custkey, CASE WHEN NOT ok THEN 'NONE' WHEN is3 THEN 'TD3' ELSE 'TD2' END AS format, CAST(CASE WHEN is3 THEN s3 ELSE s2 END AS INTEGER) AS score, CASE WHEN NOT ok THEN '' WHEN fixed THEN value ELSE read END AS number,
  CASE WHEN ok THEN surname ELSE '' END AS surname, CASE WHEN ok THEN 'ANNA MARIA' ELSE '' END AS given_names, CASE WHEN ok THEN '19' || substr(birth, 1, 2) || '-' || substr(birth, 3, 2) || '-' || substr(birth, 5, 2) ELSE '' END AS birth, CAST(CASE WHEN fixed THEN n ELSE 0 END AS INTEGER) AS corrections,
  CASE WHEN fixed THEN NULL ELSE ok AND n_ok END AS number_valid, ok AND b_ok AS birth_valid, ok AND comp AS composite, every AS all_valid,
  CASE WHEN NOT ok THEN 0 ELSE least(100, 40 + CASE WHEN coalesce(every, false) THEN 20 ELSE -10 END + CASE WHEN CAST('20' || substr(expiry, 1, 2) || '-' || substr(expiry, 3, 2) || '-' || substr(expiry, 5, 2) AS DATE) > DATE '{AS_OF}' + 30 THEN 15 ELSE 0 END + 10 + 10 + 5 - CASE WHEN fixed THEN 5 * n ELSE 0 END) END AS confidence
FROM h
"""


# name zones

_ZONES = ("{}<<ANNA<MARIA<<<<", "{}<<LIZ<ANN<<<", "{}<<ANNA<KLKLKL<<", "{}KKANNA<MARIA", "{}<DE<LA<<ANNA<KK<DE", "KLKLKL<<ANNA", "{}")


def name_zones(spark, sf):
    """Names with filler read as letters, with particles, and without a separator."""
    zone = F.replace(_of(_ZONES), F.lit("{}"), _surname())
    c = keys(spark, sf).select(_k(), parse_name(zone).alias("n"))
    return c.select("c_custkey", F.col("n.surname").alias("surname"), F.col("n.givenNames").alias("given_names"), F.array_join("n.removed", ",").alias("removed"), F.col("n.confidence.score").alias("score"), F.col("n.confidence.grade").alias("grade"), F.array_join("n.warnings", "|").alias("warnings"), F.array_join("n.confidence.reasons", "|").alias("reasons"))


_LOST, _NO_SEP, _NO_NAME = "Given names were removed or not detected.", 'Primary MRZ name separator "<<" was not found.', "Surname could not be confidently parsed."


def _noise(*tokens: str) -> str:
    return "|".join([*[f'Token "{t}" removed as OCR filler noise.' for t in tokens]])


NAME_ZONES = f"""
WITH c AS (SELECT c_custkey AS k FROM customer), p AS (SELECT k, k % 7 AS c, {_SURNAME_SQL} AS s FROM c)
SELECT k AS c_custkey, CASE c WHEN 4 THEN s || ' DE LA' WHEN 5 THEN '' ELSE s END AS surname, CASE c WHEN 0 THEN 'ANNA MARIA' WHEN 1 THEN '' WHEN 2 THEN 'ANNA' WHEN 3 THEN 'ANNA MARIA' WHEN 4 THEN 'ANNA DE' WHEN 5 THEN 'ANNA' ELSE '' END AS given_names,
  CASE c WHEN 1 THEN 'LIZ,ANN' WHEN 2 THEN 'KLKLKL' WHEN 4 THEN 'KK' WHEN 5 THEN 'KLKLKL' ELSE '' END AS removed, CASE c WHEN 0 THEN 100 WHEN 1 THEN 65 WHEN 2 THEN 92 WHEN 3 THEN 96 WHEN 4 THEN 88 WHEN 5 THEN 63 ELSE 96 END AS score, CASE WHEN c IN (1, 5) THEN 'MEDIUM' ELSE 'HIGH' END AS grade,
  CASE c WHEN 1 THEN '{_LOST}' WHEN 3 THEN 'Possible corrupted MRZ separator "KK" replaced with "<<".' WHEN 4 THEN 'Suspicious token "DE" kept because it was confirmed by visible text or particle list.' WHEN 5 THEN '{_NO_NAME}' WHEN 6 THEN '{_NO_SEP}' ELSE '' END AS warnings,
  CASE c WHEN 1 THEN '{_noise("LIZ")}|Removed 2 OCR filler/noise token(s).' WHEN 2 THEN '{_noise("KLKLKL")}|Removed 1 OCR filler/noise token(s).' WHEN 4 THEN '{_noise("KK")}|Removed 1 OCR filler/noise token(s).' WHEN 5 THEN '{_noise("KLKLKL")}|Removed 1 OCR filler/noise token(s).' ELSE 'MRZ name parsed successfully.' END AS reasons
FROM p
"""


# specialised readers: both sides match patterns against the same text


# separators of name zones, over zones whose letters follow from a digest of the key

_LETTERS = "AB<KLISZCCKKE<RN"
_MODES = ("balanced", "conservative", "aggressive")


def separator_repairs(spark, sf):
    """Name zones repaired in three modes, each as the first line of three formats."""
    zone = F.translate(F.md5(_k().cast("string").cast("binary")), "0123456789abcdef", _LETTERS)
    c = keys(spark, sf).select(_k(), zone.alias("zone"))
    made = {"balanced": variants.separated_sql("zone", "false"), "conservative": variants.conservative_sql("zone"), "aggressive": variants.separated_sql("zone", "true")}
    c = c.select("c_custkey", "zone", *[F.expr(made[m]).alias(m) for m in _MODES])
    lines = lambda m: F.concat_ws("|", *[F.rpad(F.concat(F.lit("P<UTO"), F.col(m)), f["width"], "<") for f in variants.FORMATS.values()])
    return c.select("c_custkey", "zone", *[lines(m).alias(m) for m in _MODES])


def _steps_sql(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return x


_OPENED = _steps_sql("zone", ("<{3,}", "<<"), ("[KLISZ]{3,}", "<<"), ("C{3,}", "<<"), ("<([KLISZC])<C?([KLISZC]){2,}([A-Z]{2,})", r"<<\2\3"), ("<C?([KLISZC]){2,}([A-Z]{2,})", r"<<\1\2"))
# stretches are put in braces first, and then those that are repaired are replaced
_MARKED = _steps_sql("opened", ("([A-Z])([<KLISZC]{2,})([A-Z])", r"\1{\2}\3"))
_REAL = ((r"\{[<KLISZ]+\}", "<<"), (r"\{[KLISZC]*<[<KLISZC]*\}", "<<"), (r"\{C{3,}\}", "<<"))
_CLOSED = ((r"[{}]", ""), ("[<KLISZC]{7,}$", "<" * 30), ("<{3,}", "<<"))
SEPARATOR_REPAIRS = f"""
WITH z AS (SELECT c_custkey, translate(md5(CAST(c_custkey AS VARCHAR)), '0123456789abcdef', '{_LETTERS}') AS zone FROM customer),
o AS (SELECT *, {_OPENED} AS opened FROM z),
m AS (SELECT *, {_MARKED} AS marked FROM o),
r AS (SELECT *, {_steps_sql("marked", *_REAL, *_CLOSED)} AS b, {_steps_sql("zone", ("<{3,}", "<<"), ("[KLISZ]{3,}", "<<"), ("C{4,}", "<<"), ("[<KLISZC]{8,}$", "<" * 30))} AS c, {_steps_sql("marked", *_REAL, (r"[{][<KLISZC]{4,}[}]", "<<"), *_CLOSED)} AS a FROM m)
SELECT c_custkey, zone, {", ".join("concat_ws('|', " + ", ".join(f"rpad('P<UTO' || {x}, {f['width']}, '<')" for f in variants.FORMATS.values()) + f") AS {m}" for x, m in zip("bca", _MODES))} FROM r
"""


def _day() -> Column:
    return F.concat(_two(1 + _k() % 28), F.lit("/"), _two(1 + _k() % 12), F.lit("/"), (2025 + _k() % 4).cast("string"))


_DAY_SQL = "lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '/' || CAST(2025 + k % 4 AS VARCHAR)"
#: Lines of a text: (label or several that take turns, value or several, or the text's own S surname, N number, D day).
_SHORT_STAY = (
    (("VISA",), ("",)), (("TYPE OF VISA: ", "TYPE: "), ("C", "D", "A")), (("VALID FOR: ", "VALABLE POUR "), ("ETATS SCHENGEN 1", "FRANCE 1", "1")), (("FROM: ",), ("01/02/2025", "3.4.2025")), (("UNTIL: ", "VALID UNTIL: ", "ENDS "), ("D",)),
    (("NUMBER OF ENTRIES: ", "ENTRIES: "), ("MULTIPLE", "MULT", "2", "?")), (("DURATION OF STAY: ", "DURATION "), ("90", "15")), (("ISSUED IN: ", "ISSUING AUTHORITY: "), ("PARIS 1",)), (("PASSPORT NO: ", "PASSPORT NUMBER ", "PASSPORT: "), ("N",)),
    (("SURNAME: ", "FAMILY NAME: ", "HOLDER "), ("S.",)), (("GIVEN NAMES: ", "FIRST NAME: "), ("ANNA MARIA.", ".")), (("REMARKS: ",), ("NO WORK 12/A.", ".")),
)
_EMIRATES = (
    (("UNITED ARAB EMIRATES",), ("",)), (("RESIDENCE", "ENTRY PERMIT", "IDENTITY CARD", "TRANSIT", "PAPER"), ("",)), (("VISA NO: ", "PERMIT NUMBER "), ("201/2024/1234567", "AB/123-45")), (("UID NO: ",), ("123456789",)), (("FILE NO: ", "UNIFIED NO "), ("201/2024/77",)),
    (("EMIRATES ID: ", "CARD "), ("784-1990-1234567-1",)), (("PASSPORT NO: ", "NO PAPERS "), ("N",)), (("SURNAME: ", "HOLDER "), ("S.",)), (("GIVEN NAME: ", "NAME: ", "CALLED "), ("ANNA MARIA.",)), (("NATIONALITY: ",), ("SYRIAN.", "CAN.", "INDIA.", "UTOPIA.")),
    (("DATE OF BIRTH: ", "DOB: "), ("D", "1974-08-12")), (("SEX: ", "GENDER: "), ("F", "MALE", "?")), (("ISSUE DATE: ",), ("2025.01.09",)), (("EXPIRY DATE: ", "VALID UNTIL: ", "ENDS "), ("D",)), (("PROFESSION: ", "OCCUPATION: "), ("SALES CLERK.",)),
    (("SPONSOR NAME: ",), ("ACME 7 LLC.",)), (("ENTRY TYPE: ", "TYPE: "), ("MULTIPLE", "SINGLE")), (("PORT OF ENTRY: ",), ("DUBAI.",)),
)


def _made(form) -> Column:
    own = {"D": _day(), "N": F.concat(F.lit("A"), F.lpad((_k() * 7919 % 100000000).cast("string"), 8, "0")), "S.": F.concat(_surname(), F.lit("."))}
    value = lambda v: F.coalesce(*[F.when(_of(v) == c, x) for c, x in own.items()], _of(v))
    return F.concat_ws("\n", *[F.concat(_of(a), value(b)) for a, b in form])


def _made_sql(form) -> str:
    own = f"WHEN 'D' THEN {_DAY_SQL} WHEN 'N' THEN {_NUMBER_SQL} WHEN 'S.' THEN {_SURNAME_SQL} || '.'"
    return "concat_ws(chr(10), " + ", ".join(f"{_of_sql(a)} || CASE {_of_sql(b)} {own} ELSE {_of_sql(b)} END" for a, b in form) + ")"


def _field_sql(kept: str, *patterns: str) -> str:
    """The first pattern that matches, its last group cleaned."""
    group = lambda p: p.count("(") - p.count("(?:")
    found = ", ".join(f"nullif(trim(regexp_replace(regexp_replace(regexp_extract(t, '(?i)\\b{p}', {group(p)}), '\\s+', ' ', 'g'), '(?i)[^A-Z0-9\\s{kept}]', '', 'g')), '')" for p in patterns)
    return f"coalesce({found}, '')"


def _dmy_sql(x: str) -> str:
    p = "^(\\d{1,2})[/.-](\\d{1,2})[/.-](\\d{4})$"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', 3) || '-' || lpad(regexp_extract({x}, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract({x}, '{p}', 1), 2, '0') ELSE '' END"


def _iso_sql(x: str) -> str:
    p = "^(\\d{4})[/.-](\\d{1,2})[/.-](\\d{1,2})$"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN regexp_extract({x}, '{p}', 1) || '-' || lpad(regexp_extract({x}, '{p}', 2), 2, '0') || '-' || lpad(regexp_extract({x}, '{p}', 3), 2, '0') ELSE {_dmy_sql(x)} END"


def _status_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 'UNKNOWN' WHEN CAST({x} AS DATE) < DATE '{AS_OF}' THEN 'EXPIRED' WHEN CAST({x} AS DATE) <= DATE '{AS_OF}' + 30 THEN 'EXPIRING_SOON' ELSE 'VALID' END"


def _grade_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'HIGH' WHEN {x} >= 60 THEN 'MEDIUM' ELSE 'LOW' END"


_GAP, _DMY, _ANY = "\\s*[:\\-]?\\s*", "(\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4})", "(\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}|\\d{4}[/.-]\\d{1,2}[/.-]\\d{1,2})"


def short_stay_records(spark, sf):
    """Records of short-stay visas from their labels; two texts in five have a zone, which fills in what the labels lack."""
    z = _base(spark, sf, 27, 9)
    n, b, e = (F.concat(c, _digit(F.col(c), w)) for c, w in (("number", 9), ("birth", 6), ("expiry", 6)))
    zone = F.concat_ws("\n", F.rpad(F.concat(F.lit("V<UTO"), "surname", F.lit("<<ANNA<MARIA")), 44, "<"), F.concat(n, F.lit("UTO"), b, F.lit("F"), e, F.lit("<" * 15), _digit(F.concat(n, b, e, F.lit("<" * 15)), 39)))
    text = F.concat_ws("\n", F.when(_k() % 5 < 2, zone), _made(_SHORT_STAY))
    r = F.col("record")
    found = read_schengen(z.select("c_custkey", text.alias("text")), "text", AS_OF)
    return found.select("c_custkey", *[r[a].alias(b) for a, b in (("mrzFormat", "format"), ("surname", "surname"), ("givenNames", "given_names"), ("fullName", "full_name"), ("documentNumber", "number"), ("nationality", "nationality"), ("dateOfBirth", "birth"), ("gender", "gender"), ("issuingCountry", "issuing_country"),
                        ("visaType", "visa_type"), ("validFor", "valid_for"), ("validFrom", "valid_from"), ("validUntil", "valid_until"), ("entries", "entries"), ("durationOfStay", "duration"), ("issuingPost", "issuing_post"), ("remarks", "remarks"))],
                        r["expiryStatus"]["status"].alias("status"), r["confidence"]["score"].alias("confidence"), r["confidence"]["grade"].alias("grade"), F.array_join(r["warnings"], "|").alias("warnings"))


def _short(*p: str) -> str:
    return _field_sql("''/-", *p)


SHORT_STAY_RECORDS = f"""
WITH c AS (SELECT c_custkey AS k FROM customer), x AS (SELECT k, k % 5 < 2 AS zone, {_SURNAME_SQL} AS s, {_NUMBER_SQL} AS number, '19' || CAST(30 + k % 60 AS VARCHAR) || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') AS birth, {_made_sql(_SHORT_STAY)} AS t FROM c),
f AS (SELECT *, {_short(f"SURNAME{_GAP}([A-Z\\s''-]+)", f"FAMILY\\s+NAME{_GAP}([A-Z\\s''-]+)")} AS own, {_short(f"GIVEN\\s+NAMES?{_GAP}([A-Z\\s''-]+)", f"FIRST\\s+NAME{_GAP}([A-Z\\s''-]+)")} AS given, {_short(f"PASSPORT\\s*(NO|NUMBER)?{_GAP}([A-Z0-9]{{5,20}})")} AS num,
  {_short(f"TYPE\\s+OF\\s+VISA{_GAP}([ABCD])", f"TYPE{_GAP}([ABCD])\\b")} AS visa_type, {_short(f"VALID\\s+FOR{_GAP}([A-Z\\s]+)", f"VALABLE\\s+POUR{_GAP}([A-Z\\s]+)")} AS valid_for, {_short(f"FROM{_GAP}{_DMY}")} AS since, {_short(f"UNTIL{_GAP}{_DMY}")} AS until,
  {_short(f"NUMBER\\s+OF\\s+ENTRIES{_GAP}(MULT|MULTIPLE|\\d{{1,2}})", f"ENTRIES{_GAP}(MULT|MULTIPLE|\\d{{1,2}})")} AS entries, {_short(f"DURATION\\s+OF\\s+STAY{_GAP}(\\d{{1,3}})", f"DURATION{_GAP}(\\d{{1,3}})")} AS duration, {_short(f"ISSUED\\s+IN{_GAP}([A-Z\\s]+)", f"ISSUING\\s+AUTHORITY{_GAP}([A-Z\\s]+)")} AS post,
  {_short(f"REMARKS{_GAP}([A-Z0-9\\s/-]+)")} AS remarks FROM x),
g AS (SELECT *, {_dmy_sql("since")} AS valid_from, replace({_dmy_sql("replace(until, '.', '/')")}, '', '') AS valid_until, own <> '' AND given <> '' AS named FROM f),
h AS (SELECT *, greatest(0, 20 + CASE WHEN zone THEN 40 ELSE 0 END + CASE WHEN valid_until <> '' THEN 15 ELSE -5 END + CASE WHEN named THEN 10 ELSE -5 END) AS trust, CASE WHEN own <> '' THEN own WHEN zone THEN s ELSE '' END AS surname, CASE WHEN given <> '' THEN given WHEN zone THEN 'ANNA MARIA' ELSE '' END AS names FROM g)
SELECT k AS c_custkey, CASE WHEN zone THEN 'TD3' ELSE 'NONE' END AS format, surname, names AS given_names, trim(names || ' ' || surname) AS full_name, CASE WHEN num <> '' THEN num WHEN zone THEN number ELSE '' END AS number, CASE WHEN zone THEN 'Utopia' ELSE '' END AS nationality, CASE WHEN zone THEN birth ELSE '' END AS birth,
  CASE WHEN zone THEN 'FEMALE' ELSE 'UNSPECIFIED' END AS gender, CASE WHEN valid_for <> '' THEN valid_for ELSE 'Schengen Area' END AS issuing_country, visa_type, valid_for, valid_from, valid_until, replace(entries, 'MULTIPLE', 'MULT') AS entries, duration, post AS issuing_post, remarks, {_status_sql("valid_until")} AS status, trust AS confidence,
  {_grade_sql("trust")} AS grade, concat_ws('|', CASE WHEN valid_until = '' THEN 'Schengen visa expiry date not detected.' END, CASE WHEN NOT named THEN 'Holder name not fully detected from visa text.' END) AS warnings
FROM h
"""


def emirates_records(spark, sf):
    """Records of residence visas, entry permits and identity cards from their labels."""
    c = keys(spark, sf).select(_k(), _made(_EMIRATES).alias("text"))
    r = F.col("record")
    return read_uae(c, "text", AS_OF).select("c_custkey", *[r[a].alias(b) for a, b in (("documentType", "type"), ("documentSubtype", "subtype"), ("surname", "surname"), ("givenNames", "given_names"), ("nationality", "nationality"), ("nationalityCode", "nation_code"), ("dateOfBirth", "birth"), ("gender", "gender"), ("documentNumber", "number"),
                        ("issueDate", "issued"), ("expiryDate", "expiry"), ("uid", "uid"), ("fileNumber", "file_number"), ("emiratesId", "emirates_id"), ("holderNumber", "holder_number"), ("visaNumber", "visa_number"), ("entryType", "entry_type"), ("profession", "profession"), ("sponsorName", "sponsor"), ("portOfEntry", "port"))],
                        r["expiryStatus"]["status"].alias("status"), r["confidence"]["score"].alias("confidence"), r["confidence"]["grade"].alias("grade"), F.array_join(r["warnings"], "|").alias("warnings"))


def _uae(*p: str) -> str:
    return _field_sql("''/.:-", *p)


EMIRATES_RECORDS = f"""
WITH c AS (SELECT c_custkey AS k FROM customer), x AS (SELECT k, {_made_sql(_EMIRATES)} AS t FROM c),
f AS (SELECT *, {_uae(f"VISA\\s*(NO|NUMBER)?{_GAP}(\\d{{2,4}}/\\d{{4}}/\\d{{4,12}})", f"PERMIT\\s*(NO|NUMBER)?{_GAP}([A-Z0-9/-]{{6,25}})")} AS visa, {_uae(f"UID\\s*(NO|NUMBER)?{_GAP}(\\d{{6,20}})")} AS uid, {_uae(f"FILE\\s*(NO|NUMBER)?{_GAP}([0-9/.-]{{6,25}})", f"UNIFIED\\s*(NO|NUMBER)?{_GAP}(\\d{{6,20}})")} AS file,
  {_uae(f"EMIRATES\\s*ID{_GAP}([0-9-]{{10,25}})", f"ID\\s*NUMBER{_GAP}([0-9-]{{10,25}})")} AS eid, {_uae(f"PASSPORT\\s*(NO|NUMBER)?{_GAP}([A-Z0-9]{{5,20}})")} AS num, {_uae(f"SURNAME{_GAP}([A-Z\\s''-]+)", f"FAMILY\\s+NAME{_GAP}([A-Z\\s''-]+)")} AS surname, {_uae(f"GIVEN\\s+NAMES?{_GAP}([A-Z\\s''-]+)", f"NAME{_GAP}([A-Z\\s''-]+)")} AS given,
  {_uae(f"NATIONALITY{_GAP}([A-Z\\s]+)")} AS nation, {_uae(f"DATE\\s+OF\\s+BIRTH{_GAP}{_ANY}", f"DOB{_GAP}{_ANY}")} AS dob, upper({_uae(f"SEX{_GAP}(M|F|MALE|FEMALE)", f"GENDER{_GAP}(M|F|MALE|FEMALE)")}) AS sex, {_uae(f"ISSUE\\s+DATE{_GAP}{_ANY}")} AS issued, {_uae(f"EXPIRY\\s+DATE{_GAP}{_ANY}", f"VALID\\s+UNTIL{_GAP}{_ANY}")} AS ends,
  {_uae(f"SPONSOR\\s*(NAME)?{_GAP}([A-Z0-9\\s''-]+)")} AS sponsor, {_uae(f"PROFESSION{_GAP}([A-Z\\s''-]+)", f"OCCUPATION{_GAP}([A-Z\\s''-]+)")} AS profession, {_uae(f"ENTRY\\s*TYPE{_GAP}(SINGLE|MULTIPLE|TRANSIT)", f"TYPE{_GAP}(SINGLE|MULTIPLE|TRANSIT)")} AS entry_type, {_uae(f"PORT\\s+OF\\s+ENTRY{_GAP}([A-Z\\s]+)", f"ENTRY\\s+PORT{_GAP}([A-Z\\s]+)")} AS port FROM x),
g AS (SELECT *, {_iso_sql("ends")} AS expiry, surname <> '' OR given <> '' AS named, coalesce(nullif(visa, ''), nullif(eid, ''), uid) AS number, CASE WHEN contains(t, 'EMIRATES ID') OR contains(t, 'IDENTITY CARD') THEN 'EMIRATES_ID' WHEN contains(t, 'ENTRY PERMIT') THEN 'ENTRY_PERMIT' WHEN contains(t, 'RESIDENCE') THEN 'UAE_RESIDENCE_VISA' WHEN contains(t, 'TRANSIT') THEN 'TRANSIT_VISA' ELSE 'UAE_VISA_OR_RESIDENCE' END AS subtype,
  CASE WHEN regexp_matches(nation, '^[A-Z]{{3}}$') THEN nation WHEN contains(nation, 'SYRIA') THEN 'SYR' WHEN contains(nation, 'INDIA') THEN 'IND' WHEN contains(nation, 'PAKISTAN') THEN 'PAK' WHEN contains(nation, 'CANAD') THEN 'CAN' ELSE '' END AS code FROM f),
h AS (SELECT *, least(100, greatest(0, 25 + CASE WHEN named THEN 10 ELSE -5 END + CASE WHEN number <> '' THEN 20 ELSE 0 END + CASE WHEN expiry <> '' THEN 15 ELSE -5 END + CASE WHEN num <> '' THEN 15 ELSE -5 END)) AS trust FROM g)
SELECT k AS c_custkey, CASE WHEN subtype = 'EMIRATES_ID' THEN 'IDENTITY_CARD' ELSE 'RESIDENCE' END AS type, subtype, surname, given AS given_names, CASE code WHEN 'SYR' THEN 'Syrian Arab Republic' WHEN 'IND' THEN 'India' WHEN 'CAN' THEN 'Canada' ELSE code END AS nationality, code AS nation_code, {_iso_sql("dob")} AS birth,
  CASE WHEN sex IN ('M', 'MALE') THEN 'MALE' WHEN sex IN ('F', 'FEMALE') THEN 'FEMALE' ELSE 'UNSPECIFIED' END AS gender, number, {_iso_sql("issued")} AS issued, expiry, uid, file AS file_number, eid AS emirates_id, num AS holder_number, visa AS visa_number, entry_type, profession, sponsor, port, {_status_sql("expiry")} AS status, trust AS confidence,
  {_grade_sql("trust")} AS grade, concat_ws('|', CASE WHEN expiry = '' THEN 'Expiry date not detected.' END, CASE WHEN NOT named THEN 'Name not fully detected.' END, CASE WHEN num = '' THEN 'Passport number not detected.' END) AS warnings
FROM h
"""


# the visible text of primary documents

_VISIBLE = (
    (("SURNAME: ", "FAMILY NAME\n", "HOLDER "), ("S.",)), (("GIVEN NAMES - ", "FORENAME: "), ("ANNA MARIA", "DATE")), (("PASSPORT NO. ", "DOCUMENT NUMBER: "), ("N",)), (("NATIONALITY: ", "COUNTRY CODE ", "FROM "), ("UTO", "GBR")), (("DATE OF BIRTH: ", "DOB "), ("1974/08/12", "D")),
    (("SEX: ", "GENDER "), ("F", "M", "?")), (("DATE OF ISSUE: ", "ISSUED "), ("01/02/2025",)), (("DATE OF EXPIRY ", "ENDS "), ("D",)),
)


def visible_records(spark, sf):
    """Records read from labels alone, where no zone is to be parsed."""
    c = keys(spark, sf).select(_k(), _made(_VISIBLE).alias("full_text"))
    r = F.col("record")
    return read_visible(c, AS_OF).select("c_custkey", *[r[a].alias(b) for a, b in (("surname", "surname"), ("givenNames", "given_names"), ("fullName", "full_name"), ("holderNumber", "number"), ("dateOfBirth", "birth"), ("gender", "gender"), ("issueDate", "issued"), ("expiryDate", "expiry"), ("confidenceScore", "confidence"), ("checkAllValid", "checks"))])


VISIBLE_RECORDS = f"""
WITH c AS (SELECT c_custkey AS k, {_SURNAME_SQL.replace("k %", "c_custkey %")} AS s, {_NUMBER_SQL.replace("k *", "c_custkey *")} AS number FROM customer), d AS (SELECT *, CAST(2025 + k % 4 AS VARCHAR) || '-' || lpad(CAST(1 + k % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + k % 28 AS VARCHAR), 2, '0') AS day FROM c),
e AS (SELECT *, CASE WHEN k % 3 < 2 THEN s ELSE '' END AS surname, CASE WHEN k % 3 < 2 THEN s WHEN k % 2 = 0 THEN 'ANNA MARIA' ELSE 'NUMBER A' END AS given FROM d)
SELECT k AS c_custkey, surname, given AS given_names, trim(given || ' ' || surname) AS full_name, number, CASE WHEN k % 2 = 0 THEN '1974-08-12' ELSE day END AS birth, CASE k % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE '' END AS gender, '2025-02-01' AS issued, CASE WHEN k % 2 = 0 THEN day ELSE '' END AS expiry, '35% - LOW' AS confidence, 'FAIL' AS checks FROM e
"""

QUERIES = {
    "separator_repairs": (separator_repairs, SEPARATOR_REPAIRS),
    "mrz_formats": (mrz_formats, MRZ_FORMATS),
    "mrz_candidates": (mrz_candidates, MRZ_CANDIDATES),
    "name_zones": (name_zones, NAME_ZONES),
    "short_stay_records": (short_stay_records, SHORT_STAY_RECORDS),
    "emirates_records": (emirates_records, EMIRATES_RECORDS),
    "visible_records": (visible_records, VISIBLE_RECORDS),
}
