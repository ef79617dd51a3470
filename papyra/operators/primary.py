"""Primary documents (booklets, travel and identity documents): pages to one flat record for each case."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.config import LOW_PRIMARY_SCORE
from papyra.functions.dates import expiry_status, primary_date
from papyra.functions.text import EDGE, blank, collapse, drop_words, either, first_match, has, literal, present, strip_accents

from .fields import clean_simple
from .mrz import parse_mrz, primary_score
from .pages import best_page

#: Fixed value: printed.
LOW_WARNING = "Low confidence passport read. Please use a clearer image or PDF scan."
#: Words on a page that aren't part of a name; that show that a line isn't one.
NAME_STOPS = ("GIVEN", "NAME", "NAMES", "SURNAME", "FAMILY", "DATE", "BIRTH", "COUNTRY", "CITIZENSHIP", "SEX", "MALE", "FEMALE", "DOCUMENT", "PASSPORT", "TYPE", "CODE", "NATIONALITY")
NOT_A_NAME = "(?:DATE|BIRTH|SEX|COUNTRY|DOCUMENT|PASSPORT|EXPIRY|ISSUE|AUTHORITY|TYPE|CODE|NATIONALITY)"
DATE_SHAPES = r"([0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}|[0-9]{1,2}\s+[A-Z]{3,9}\s+[0-9]{2,4})"


def clean_name(value: Column) -> Column:
    text = F.translate(F.upper(strip_accents(F.coalesce(value, F.lit("")))), "<", " ")
    text = drop_words(F.regexp_replace(blank(text), r"[^A-Z\s'-]", " "), NAME_STOPS)
    return collapse(F.regexp_replace(text, f"{EDGE}[KLI]{{4,}}{EDGE}", " "))


def readable_type(kind: Column, subtype: Column) -> Column:
    k, s = F.upper(F.coalesce(kind, F.lit(""))), F.upper(F.coalesce(subtype, F.lit("")))
    booklet = k == "PASSPORT"
    named = F.when(booklet & (s == "DIPLOMATIC"), "Diplomatic Passport").when(booklet & (s == "SERVICE"), "Service Passport").when(booklet & (s == "OFFICIAL"), "Official Passport").when(booklet, "Passport")
    named = named.when(s == "REFUGEE", "Refugee Travel Document").when(k == "TRAVEL_DOCUMENT", "Travel Document").when(k == "IDENTITY_CARD", "Identity / Travel Card").when(k == "VISA", "Visa")
    return named.otherwise(either(k, F.lit("Unknown Document")))


def sex(value: Column) -> Column:
    v = F.trim(F.upper(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("M", "MALE"), "M").when(v.isin("F", "FEMALE"), "F").when(v.isin("X", "UNSPECIFIED", "<"), "X").otherwise("")


def pass_fail(value: Column) -> Column:
    return F.when(value, "PASS").when(~value, "FAIL").otherwise("")


def percent_grade(score: Column, grade: Column) -> Column:
    shown = F.when(score.isNotNull(), F.concat(score.cast("string"), F.lit("%"))).otherwise("")
    return F.when(has(shown) & has(grade), F.concat(shown, F.lit(" - "), grade)).otherwise(either(shown, F.coalesce(grade, F.lit(""))))


def flat_record(m: Column, full_text: Column, mrz_text: Column, extra_warnings: Column) -> dict[str, Column]:
    """The flat record of a parsed zone; lists are joined by " | "."""
    surname, given = clean_name(m["surname"]), clean_name(m["givenNames"])
    checks, status, trust = m["checkDigits"], m["expiryStatus"], m["confidence"]
    fixes = F.transform(F.coalesce(m["corrections"], F.array().cast("array<struct<field:string,original:string,corrected:string>>")), lambda c: F.concat(c["field"], F.lit(": "), c["original"], F.lit(" → "), c["corrected"]))
    warnings = F.filter(F.concat(F.coalesce(m["warnings"], F.array().cast("array<string>")), extra_warnings), lambda w: w != "")
    return {
        "documentType": readable_type(m["documentType"], m["documentSubtype"]),
        "documentSubtype": present(m["documentSubtype"]),
        "mrzFormat": either(m["mrzFormat"], F.lit("NONE")),
        "issuingCountry": present(m["issuingCountryCode"]),
        "issuingCountryName": present(m["issuingCountry"]),
        "issuingCountryCode": present(m["issuingCountryCode"]),
        "holderNumber": present(m["documentNumber"]),
        "documentNumber": present(m["documentNumber"]),
        "surname": surname,
        "givenNames": given,
        "fullName": clean_name(either(m["fullName"], F.concat(given, F.lit(" "), surname))),
        "nameConfidence": F.when(m["nameConfidence"].isNotNull(), F.concat(m["nameConfidence"]["score"].cast("string"), F.lit("% - "), m["nameConfidence"]["grade"])).otherwise(""),
        "removedNameNoiseTokens": F.coalesce(F.array_join(m["removedNameNoiseTokens"], " | "), F.lit("")),
        "nationality": present(m["nationalityCode"]),
        "nationalityName": present(m["nationality"]),
        "nationalityCode": present(m["nationalityCode"]),
        "dateOfBirth": present(m["dateOfBirth"]),
        "gender": sex(m["gender"]),
        "expiryDate": present(m["expiryDate"]),
        "issueDate": present(m["issueDate"]),
        "expiryStatus": present(status["status"]),
        "daysUntilExpiry": status["daysUntilExpiry"],
        "daysExpired": status["daysExpired"],
        "checkDocumentNumber": pass_fail(checks["documentNumber"]),
        "checkDateOfBirth": pass_fail(checks["dateOfBirth"]),
        "checkExpiryDate": pass_fail(checks["expiryDate"]),
        "checkComposite": pass_fail(checks["composite"]),
        "checkAllValid": pass_fail(checks["allValid"]),
        "confidenceScore": percent_grade(trust["score"], trust["grade"]),
        "confidenceGrade": present(trust["grade"]),
        "confidenceBreakdown": F.array_join(trust["breakdown"], " | "),
        "corrections": F.array_join(fixes, " | "),
        "warnings": F.array_join(warnings, " | "),
        "mrzRawData": F.array_join(m["mrzCleaned"], "\n"),
        "mrzOriginalData": F.array_join(m["mrzRaw"], "\n"),
        "rawOcrText": either(full_text, m["rawOcrText"]),
        "rawMrzOcrText": present(mrz_text),
    }


def _parsed_pages(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """pages with mrz and score. The zone's own text comes first; null texts are empty."""
    text = pages.withColumns({"full_text": present(F.col("full_text")), "mrz_text": present(F.col("mrz_text"))})
    text = text.withColumn("__all", F.concat_ws("\n", "mrz_text", "full_text"))
    return parse_mrz(text, "__all", as_of).withColumn("score", primary_score(F.col("mrz"), F.col("__all"))).drop("__all")


def _record() -> dict[str, Column]:
    low = F.when(F.col("score") < LOW_PRIMARY_SCORE, F.array(F.lit(LOW_WARNING))).otherwise(F.array().cast("array<string>"))
    record = flat_record(F.col("mrz"), F.col("full_text"), F.col("mrz_text"), low)
    return record | {"selectedPage": F.col("page_number"), "processingScore": F.col("score")}


def primary_pages(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """pages with their score and the record that each would give by itself."""
    parsed = _parsed_pages(pages, as_of)
    return parsed.withColumn("record", F.struct(*[c.alias(k) for k, c in _record().items()])).drop("mrz")


def read_primary(pages: DataFrame, as_of: dt.date) -> DataFrame:
    """One flat record for each case_id of pages (case_id, page_number, full_text, mrz_text): that of its best page.

    The zone's own text comes first. The highest score wins, of equal ones the first page. Null texts are empty.
    """
    best = best_page(_parsed_pages(pages, as_of), "case_id", "page_number", "score", ["mrz", "full_text", "mrz_text"])
    return best.select("case_id", *[c.alias(k) for k, c in _record().items()], "attempts")


# what is read from the visible text where there is no zone parser

def is_likely_name(value: Column) -> Column:
    name = clean_name(value)
    return F.length(name).between(2, 70) & ~name.rlike(NOT_A_NAME)


def line_field(lines: Column, *labels: str) -> Column:
    """The name after the first label, else in the next line."""

    def at(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(lines, i + 1), F.lit(""))
        found = []
        for label in labels:
            rest = F.trim(F.regexp_replace(line, rf"(?i).*{literal(label)}\s*[:/-]*\s*", ""))
            found.append(F.when(line.contains(label), F.when(is_likely_name(rest), clean_name(rest)).when(is_likely_name(after), clean_name(after))))
        return F.coalesce(*found)

    return F.coalesce(F.get(F.filter(F.transform(lines, at), lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def text_date(text: Column, *labels: str) -> Column:
    out = F.lit("")
    for label in reversed(labels):
        p = rf"(?i){literal(label)}[^0-9A-Z]{{0,30}}{DATE_SHAPES}"
        out = F.when(text.rlike(p), primary_date(F.regexp_extract(text, p, 1))).otherwise(out)
    return out


def visible_fields(text: Column) -> dict[str, Column]:
    """Fields of a primary document by their printed labels."""
    raw = F.upper(F.coalesce(text, F.lit("")))
    lines = F.filter(F.transform(F.split(raw, r"\r?\n"), lambda x: collapse(strip_accents(x))), lambda x: x != "")
    find = lambda *p: first_match(raw, p, clean_simple)
    return {
        "surname": line_field(lines, "SURNAME", "FAMILY NAME", "LAST NAME", "NOM"),
        "givenNames": line_field(lines, "GIVEN NAMES", "GIVEN NAME", "FIRST NAME", "FORENAME", "NAME"),
        "documentNumber": find(r"(?i)PASSPORT\s*(NO|NUMBER)?[^A-Z0-9]*([A-Z0-9]{5,15})", r"(?i)DOCUMENT\s*(NO|NUMBER)?[^A-Z0-9]*([A-Z0-9]{5,15})"),
        "nationalityCode": find(r"(?i)NATIONALITY[^A-Z0-9]*([A-Z]{3})", r"(?i)COUNTRY\s*CODE[^A-Z0-9]*([A-Z]{3})"),
        "issuingCountryCode": find(r"(?i)ISSUING\s*COUNTRY[^A-Z0-9]*([A-Z]{3})", r"(?i)COUNTRY\s*CODE[^A-Z0-9]*([A-Z]{3})"),
        "dateOfBirth": text_date(raw, "DATE OF BIRTH", "DOB", "BIRTH"),
        "gender": sex(find(r"(?i)SEX[^A-Z0-9]*(M|F|MALE|FEMALE|X)", r"(?i)GENDER[^A-Z0-9]*(M|F|MALE|FEMALE|X)")),
        "issueDate": text_date(raw, "DATE OF ISSUE", "ISSUE DATE", "ISSUED"),
        "expiryDate": text_date(raw, "DATE OF EXPIRY", "EXPIRY DATE", "EXPIRATION DATE", "VALID UNTIL"),
    }


def read_visible(pages: DataFrame, as_of: dt.date, text_col: str = "full_text") -> DataFrame:
    """pages with the flat record of their visible text alone: the mode for pages whose zone isn't to be parsed."""
    v = visible_fields(F.col(text_col))
    df = pages.withColumn("__v", F.struct(*[c.alias(k) for k, c in v.items()]))
    x = F.col("__v")
    no = F.array().cast("array<string>")
    m = F.struct(
        F.lit("UNKNOWN").alias("documentType"), F.lit("UNKNOWN").alias("documentSubtype"), F.lit("NONE").alias("mrzFormat"), x["surname"].alias("surname"), x["givenNames"].alias("givenNames"),
        collapse(F.concat(x["givenNames"], F.lit(" "), x["surname"])).alias("fullName"), F.lit("").alias("nationality"), x["nationalityCode"].alias("nationalityCode"), x["dateOfBirth"].alias("dateOfBirth"),
        x["gender"].alias("gender"), x["documentNumber"].alias("documentNumber"), F.lit("").alias("issuingCountry"), x["issuingCountryCode"].alias("issuingCountryCode"), x["issueDate"].alias("issueDate"), x["expiryDate"].alias("expiryDate"),
        expiry_status(x["expiryDate"], as_of).alias("expiryStatus"), F.struct(*[F.lit(False).alias(c) for c in ("documentNumber", "dateOfBirth", "expiryDate", "composite", "allValid")]).alias("checkDigits"),
        F.struct(F.lit(35).alias("score"), F.lit("LOW").alias("grade"), F.array(F.lit("MRZ parser unavailable or MRZ not detected"), F.lit("Visible OCR fallback used")).alias("breakdown")).alias("confidence"),
        F.lit(None).cast("struct<score:int,grade:string,reasons:array<string>>").alias("nameConfidence"), no.alias("removedNameNoiseTokens"), F.array().cast("array<struct<field:string,original:string,corrected:string>>").alias("corrections"),
        no.alias("warnings"), no.alias("mrzRaw"), no.alias("mrzCleaned"), F.concat(F.lit("\n"), present(F.col(text_col))).alias("rawOcrText"),
    )
    df = df.withColumn("__m", m)
    record = flat_record(F.col("__m"), F.col(text_col), F.lit(""), no)
    return df.select(*pages.columns, F.struct(*[c.alias(k) for k, c in record.items()]).alias("record"))
