"""Queries of sinks, of small text functions and of the first bytes of files, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.functions.checkdigit import correct_digits, correct_letters
from papyra.functions.names import mrz_name_text, visible_tokens
from papyra.operators import compare, fields
from papyra.operators.secondary import category
from papyra.sources import files, sinks

from .tables import spread

# small text functions

_KINDS = ("Refugee Travel Document", "US Visa", "Work Permit", "Permanent Resident Card", "Emirates ID", "Identity paper", "Refugee Protection Claimant Document", "Ship log")
_PLACES = ("Carte du Canadá", "ROMANIA", "the uae office", "United  Kingdom", "Quâtar", "united kingdom of great britain", "schengen states", "")


def _pick(values: tuple[str, ...]):
    return F.get(F.array(*[F.lit(v) for v in values]), (F.col("c_custkey") % len(values)).cast("int"))


def _pick_sql(values: tuple[str, ...]) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST(c_custkey % {len(values)} + 1 AS INTEGER))"


def text_functions(spark, sf):
    """Names, categories, issuing countries, matches and corrections of texts made from customers."""
    k = F.col("c_custkey")
    c = spread(spark.read.parquet(f"{sf}/customer.parquet").select(k, "c_mktsegment")).withColumn("n", F.lpad((k % 1000).cast("string"), 3, "0"))
    zone = F.concat(F.lit("SM1TH<<ANN4<"), F.translate("n", "0123456789", "KLIABCDEFG"), F.lit("K<KLIK<LIZ"))
    field = F.concat(F.lit("O1l"), F.upper(F.hex(k)), F.lit("QZ8b"))
    digits, letters = correct_digits(field), correct_letters(field)
    return c.select(
        k, mrz_name_text(zone).alias("name_text"), F.array_join(visible_tokens(F.concat(F.lit("Anna 7 "), "c_mktsegment", F.lit(" ANNA\tb, b"))), " ").alias("tokens"),
        category(_pick(_KINDS)).alias("category"), fields.issuing_country(_pick(_PLACES)).alias("issuer"),
        F.array_join(fields.all_matches(F.concat(F.lit("AB123 AB123 CD"), "n", F.lit(" x")), "[A-Z]{2}[0-9]{3}"), "|").alias("matches"),
        digits["value"].alias("digits"), F.size(digits["corrections"]).alias("n_digits"), letters["value"].alias("letters"), F.size(letters["corrections"]).alias("n_letters"),
    )


TEXT_FUNCTIONS = f"""
WITH c AS (SELECT c_custkey, c_mktsegment, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS n, 'O1L' || upper(hex(c_custkey)) || 'QZ8B' AS f, {_pick_sql(_KINDS)} AS kind, upper(strip_accents({_pick_sql(_PLACES)})) AS place FROM customer),
z AS (SELECT *, 'SM1TH<<ANN4<' || translate(n, '0123456789', 'KLIABCDEFG') || 'K<KLIK<LIZ' AS zone FROM c)
SELECT c_custkey, trim(regexp_replace(regexp_replace(replace(translate(zone, '018526', 'OIBSZG'), '<', ' '), '\\b[KLI]{{4,}}\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS name_text, 'ANNA ' || upper(c_mktsegment) || ' B' AS tokens,
  CASE WHEN contains(kind, 'Travel Document') THEN 'Primary Travel Document' WHEN contains(kind, 'Visa') OR contains(kind, 'Permit') THEN 'Immigration Authorization' WHEN contains(kind, 'Resident') THEN 'Residence Document'
    WHEN contains(kind, 'ID') OR contains(kind, 'Identity') THEN 'Identity Document' WHEN contains(kind, 'Claimant') THEN 'Immigration / Protection Document' ELSE 'Other' END AS category,
  CASE WHEN contains(place, 'CANADA') THEN 'CAN' WHEN contains(place, 'UAE') THEN 'ARE' WHEN contains(place, 'UNITED KINGDOM') THEN 'GBR' WHEN contains(place, 'QATAR') THEN 'QAT' WHEN contains(place, 'OMAN') THEN 'OMN' WHEN contains(place, 'SCHENGEN') THEN 'SCHENGEN' ELSE '' END AS issuer,
  'AB123|CD' || n AS matches, translate(f, 'OILBSZGQD', '011852600') AS digits, CAST(length(f) - length(regexp_replace(f, '[OILBSZGQD]', '', 'g')) AS INTEGER) AS n_digits,
  translate(f, '018526', 'OIBSZG') AS letters, CAST(length(f) - length(regexp_replace(f, '[018526]', '', 'g')) AS INTEGER) AS n_letters
FROM z
"""

# the first bytes of files

_HEADS = ("FFD8FFE000104A464946", "89504E470D0A1A0A", "524946460000000057454250", "474946383761", "474946383961", "255044462D312E34", "FFD8", "", "89504E46", "5249464600000000AAAA57454250")


def image_headers(spark, sf):
    """Kinds of images by first bytes, whole, cut off and nearly right, with the text of documents behind them."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    head = F.get(F.array(*[F.lit(h) for h in _HEADS]), (F.col("doc_id") % len(_HEADS)).cast("int"))
    d = d.select("doc_id", F.concat(F.unhex(head), F.when(F.length(head) >= 8, F.encode("text", "UTF-8")).otherwise(F.lit(b""))).alias("content"))
    c = F.col("content")
    return d.select("doc_id", files.is_jpeg(c).alias("jpeg"), files.is_png(c).alias("png"), files.is_webp(c).alias("webp"), files.is_gif(c).alias("gif"), files.has_pdf_magic(c).alias("pdf"), files.image_kind(c).alias("kind"))


IMAGE_HEADERS = f"""
WITH d AS (SELECT doc_id, doc_id % {len(_HEADS)} AS k FROM documents)
SELECT doc_id, k = 0 AS jpeg, k = 1 AS png, k = 2 AS webp, k IN (3, 4) AS gif, k = 5 AS pdf, CASE k WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'gif' WHEN 4 THEN 'gif' END AS kind FROM d
"""


# sinks of verdicts; the records compared are those of the comparison queries


def _verdicts(spark, sf):
    from .queries import AS_OF, _pairs

    return compare.compare_records(_pairs(spark, sf), AS_OF)


def decision_sink(spark, sf):
    table = sinks.decision_table(_verdicts(spark, sf), "c_custkey")
    return table.select(F.col("c_custkey"), "decision", F.col("riskLevel").alias("risk"), "score", "reason", sinks.as_json("c_custkey", "decision", "score").alias("json"))


def alert_sink(spark, sf):
    return sinks.alert_rows(_verdicts(spark, sf), "c_custkey").select("c_custkey", F.col("alert_ord").cast("int").alias("alert_ord"), "alert")


def comparison_sink(spark, sf):
    rows = compare.comparison_rows(_verdicts(spark, sf), "c_custkey")
    shown = sinks.comparison_table(rows.withColumnRenamed("c_custkey", "case_id"))
    return shown.select(F.col("case_id").alias("c_custkey"), F.col("field_ord").cast("int").alias("field_ord"), "label", F.col("primaryValue").alias("mine"), F.col("secondaryValue").alias("theirs"), "status")


def sink_sql(verdict: str, alerts: str, rows: str) -> dict[str, str]:
    """SQL of the three, from that of the comparison queries."""
    decision = f"""SELECT c_custkey, decision, risk, score || '%' AS score, reason, '{{' || chr(10) || '  "c_custkey" : ' || c_custkey || ',' || chr(10) || '  "decision" : "' || decision || '",' || chr(10) || '  "score" : "' || score || '%"' || chr(10) || '}}' AS json FROM ({verdict})"""
    listed = f"SELECT c_custkey, CAST(generate_subscripts(string_split(alerts, chr(10)), 1) - 1 AS INTEGER) AS alert_ord, unnest(string_split(alerts, chr(10))) AS alert FROM ({alerts})"
    shown = f"""
    WITH r AS (SELECT * FROM ({rows})), x AS (SELECT c_custkey, c_mktsegment AS seg, upper(lpad(hex(c_custkey), 9, '0')) AS num, min(o_orderkey) AS o, strftime(DATE '1960-01-01' + CAST(c_custkey % 9000 AS INTEGER), '%Y-%m-%d') AS born,
      strftime(DATE '1960-01-01' + CAST(c_custkey % 9000 + 1 AS INTEGER), '%Y-%m-%d') AS other FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT r.c_custkey, field_ord, label, CASE field_ord WHEN 0 THEN 'ANNA ' || seg WHEN 1 THEN born WHEN 2 THEN CASE WHEN r.c_custkey % 2 = 0 THEN 'M' ELSE 'X' END WHEN 3 THEN num WHEN 4 THEN 'UTO' WHEN 5 THEN 'ARE' WHEN 6 THEN '2030-01-01' ELSE 'Not detected' END AS mine,
      CASE field_ord WHEN 0 THEN CASE o % 5 WHEN 0 THEN 'JOHN SMITHSON' WHEN 1 THEN seg || ' ANNA' ELSE 'Anna ' || seg END WHEN 1 THEN CASE WHEN o % 3 = 0 THEN other ELSE born END WHEN 2 THEN 'MALE'
        WHEN 3 THEN CASE o % 4 WHEN 0 THEN 'Not detected / not available' WHEN 1 THEN replace(num, '0', 'O') WHEN 2 THEN 'QQQQQ' ELSE num END WHEN 4 THEN CASE WHEN o % 2 = 0 THEN 'UTO' WHEN o % 6 = 1 THEN 'UTOPIA' ELSE 'Not detected' END
        WHEN 5 THEN CASE WHEN o % 3 = 1 THEN 'United Arab Emirates' ELSE 'Not detected' END WHEN 6 THEN 'Not detected' ELSE CASE r.c_custkey % 5 WHEN 0 THEN '2020-01-01' WHEN 1 THEN '2025-13-40' WHEN 2 THEN 'Not detected' ELSE '2027-01-01' END END AS theirs, status
    FROM r JOIN x ON r.c_custkey = x.c_custkey"""
    return {"decision_sink": decision, "alert_sink": listed, "comparison_sink": shown}


QUERIES = {"text_functions": (text_functions, TEXT_FUNCTIONS), "image_headers": (image_headers, IMAGE_HEADERS)}
SINKS = {"decision_sink": decision_sink, "alert_sink": alert_sink, "comparison_sink": comparison_sink}
