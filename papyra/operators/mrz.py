"""Machine-readable zones: lines of a page, the best candidate, and the record decoded from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.config import MIN_MRZ_LINE
from papyra.functions.checkdigit import correct_with_check_digit, correction_records, validate
from papyra.functions.countries import country_map, country_names, normal_code
from papyra.functions.dates import expiry_status, mrz_date
from papyra.functions.names import grade, parse_name
from papyra.functions.text import blank, collapse, constant_map, has, listed, present

from .variants import DOCUMENT_TYPES, best_candidate_column

#: Characters that OCR reads for the filler.
BRACKETS = r"[«‹≤{}\[\]()|¦!/\\]"
_ANY_DIGIT = "[0-9OBISZGL]"
NOT_FOUND = "MRZ not found or all MRZ candidates were rejected by validation."

CORRECTIONS = "array<struct<field:string,original:string,corrected:string>>"
CHECKS = "struct<documentNumber:boolean,dateOfBirth:boolean,expiryDate:boolean,composite:boolean,allValid:boolean>"
CONFIDENCE = "struct<score:int,grade:string,breakdown:array<string>>"


def normalize_line(line: Column) -> Column:
    """A line in capitals without blanks, brackets as fillers, and nothing but A-Z, 0-9 and fillers."""
    text = F.regexp_replace(F.regexp_replace(blank(F.upper(line)), r"\s+", ""), BRACKETS, "<")
    return F.regexp_replace(text, "[^A-Z0-9<]", "")


def is_likely_line(line: Column) -> Column:
    n = F.length(line)
    opens = line.rlike("^[A-Z][A-Z0-9<][A-Z0-9<]{3}") & (n >= 25)
    dates = line.rlike(f"{_ANY_DIGIT}{{6}}{_ANY_DIGIT}[MFX<]{_ANY_DIGIT}{{6}}")
    return (line.contains("<") & (n >= 20)) | opens | dates


def mrz_lines(text: Column) -> Column:
    """The lines of a page that may belong to a zone, in order."""
    lines = F.transform(F.split(F.upper(F.coalesce(text, F.lit(""))), r"\r?\n"), normalize_line)
    return F.filter(lines, lambda x: (F.length(x) >= MIN_MRZ_LINE) & is_likely_line(x))


def document_type(code: Column) -> Column:
    """struct(type, subtype) of a document code: by the code, else by its first letter."""
    kinds = constant_map({k: {"type": a, "subtype": b} for k, (a, b) in DOCUMENT_TYPES.items()}, "struct<type:string,subtype:string>")
    unknown = F.struct(F.lit("UNKNOWN").alias("type"), F.lit("UNKNOWN").alias("subtype"))
    c = F.upper(F.coalesce(code, F.lit("")))
    return F.coalesce(F.try_element_at(kinds, c), F.try_element_at(kinds, F.substring(c, 1, 1)), unknown)


def gender(code: Column) -> Column:
    return F.when(F.upper(code) == "M", "MALE").when(F.upper(code) == "F", "FEMALE").otherwise("UNSPECIFIED")


def _by_format(fmt: Column, td1: Column, other: Column) -> Column:
    return F.when(fmt == "TD1", td1).otherwise(other)


def _cut(line: Column, a: int, b: int) -> Column:
    return F.substring(line, a + 1, b - a)


def composite_valid(fmt: Column, one: Column, two: Column) -> Column:
    """Whether the composite check digit holds, on the lines as they were read."""
    td3 = validate(F.concat(_cut(two, 0, 10), _cut(two, 13, 20), _cut(two, 21, 43)), _cut(two, 43, 44), 39)
    td2 = validate(F.concat(_cut(two, 0, 10), _cut(two, 13, 20), _cut(two, 21, 35)), _cut(two, 35, 36), 31)
    td1 = validate(F.concat(_cut(one, 5, 30), _cut(two, 0, 7), _cut(two, 8, 15), _cut(two, 18, 29)), _cut(two, 29, 30), 50)
    return F.when(fmt == "TD3", td3).when(fmt == "TD2", td2).otherwise(td1)


def confidence(found: Column, all_valid: Column, status: Column, name_score: Column, known: Column, kind: Column, corrections: Column) -> Column:
    valid = F.coalesce(all_valid, F.lit(False))
    n = F.size(corrections)
    name = F.when(name_score >= 90, 10).when(name_score >= 70, 7).when(name_score.isNotNull(), 3).otherwise(0)
    score = F.when(found, 40).otherwise(-20) + F.when(valid, 20).otherwise(-10) + F.when(status == "VALID", 15).otherwise(0) + name + F.when(known, 10).otherwise(0) + F.when(kind != "UNKNOWN", 5).otherwise(0) - 5 * n
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    lines = listed(
        F.when(found, "+40 MRZ detected and parsed").otherwise("-20 MRZ not found"),
        F.when(valid, "+20 all check digits valid").otherwise("-10 one or more check digits failed"),
        F.when(status == "VALID", "+15 expiry date valid"),
        F.when(name_score >= 90, "+10 name parsed successfully (HIGH confidence)").when(name_score >= 70, "+7 name parsed successfully (MEDIUM confidence)").when(name_score.isNotNull(), "+3 name parsed successfully (LOW confidence)"),
        F.when(known, "+10 country code recognized"),
        F.when(kind != "UNKNOWN", "+5 document type identified"),
        F.when(n > 0, F.concat(F.lit("-"), (5 * n).cast("string"), F.lit(" OCR correction penalty"))),
    )
    return F.struct(score.alias("score"), grade(score).alias("grade"), lines.alias("breakdown")).cast(CONFIDENCE)


def parse_mrz(pages: DataFrame, text_col: str, as_of: dt.date, out: str = "mrz") -> DataFrame:
    """pages with a struct column `out`: the record of the zone found in text_col.

    Where none is found its format is NONE, its fields are empty and a warning says so. A null text is an empty one. Nothing
    is shuffled: the columns follow from each row's own text.
    """
    names = country_names(pages.sparkSession)
    known_codes = frozenset(names)
    hidden = [f"__{x}" for x in ("lines", "best", "parts", "decoded", "dates", "status", "judged")]
    df = pages.withColumn("__lines", mrz_lines(F.col(text_col)))
    df = df.withColumn("__best", best_candidate_column("__lines", as_of, known_codes))
    fmt, one, two = F.col("__best.format"), F.get("__best.lines", F.lit(0)), F.get("__best.lines", F.lit(1))
    parts = F.struct(
        _by_format(fmt, _cut(one, 5, 14), _cut(two, 0, 9)).alias("number"),
        _by_format(fmt, _cut(one, 14, 15), _cut(two, 9, 10)).alias("number_digit"),
        _by_format(fmt, _cut(two, 0, 6), _cut(two, 13, 19)).alias("birth"),
        _by_format(fmt, _cut(two, 6, 7), _cut(two, 19, 20)).alias("birth_digit"),
        _by_format(fmt, _cut(two, 8, 14), _cut(two, 21, 27)).alias("expiry"),
        _by_format(fmt, _cut(two, 14, 15), _cut(two, 27, 28)).alias("expiry_digit"),
        _by_format(fmt, _cut(two, 15, 18), _cut(two, 10, 13)).alias("nation"),
        _by_format(fmt, _cut(two, 7, 8), _cut(two, 20, 21)).alias("sex"),
        _by_format(fmt, F.get("__best.lines", F.lit(2)), F.substr(one, F.lit(6))).alias("zone"),
    )
    df = df.withColumn("__parts", F.when(fmt.isNotNull(), parts))
    p = F.col("__parts")
    decoded = F.struct(
        correct_with_check_digit(p["number"], p["number_digit"], "document").alias("number"),
        correct_with_check_digit(p["birth"], p["birth_digit"], "date").alias("birth"),
        correct_with_check_digit(p["expiry"], p["expiry_digit"], "date").alias("expiry"),
        parse_name(p["zone"]).alias("name"),
        document_type(F.regexp_replace(_cut(one, 0, 2), "<", "")).alias("kind"),
        F.regexp_replace(_cut(one, 2, 5), "<", "").alias("issuer"),
        F.regexp_replace(p["nation"], "<", "").alias("nation"),
        F.col("__best.composite").alias("composite"),
    )
    df = df.withColumn("__decoded", F.when(fmt.isNotNull(), decoded))
    d = F.col("__decoded")
    # each step a column of its own, so that what later steps name often is worked out once
    df = df.withColumn("__dates", F.when(fmt.isNotNull(), F.struct(mrz_date(d["birth"]["value"], "birth", as_of).alias("born"), mrz_date(d["expiry"]["value"], "expiry", as_of).alias("ends"))))
    born, ends = F.col("__dates.born"), F.col("__dates.ends")
    df = df.withColumn("__status", expiry_status(ends, as_of))
    status = F.col("__status")
    every = d["number"]["valid"] & d["birth"]["valid"] & d["expiry"]["valid"] & d["composite"]
    # a corrected number has no verdict, and then the whole has none either
    every = F.when(d["number"]["valid"].isNull(), F.lit(None).cast("boolean")).otherwise(every)
    corrections = F.concat(correction_records("documentNumber", p["number"], d["number"]), correction_records("dateOfBirth", p["birth"], d["birth"]), correction_records("expiryDate", p["expiry"], d["expiry"]))
    codes = country_map(names)
    look = lambda c: F.coalesce(F.try_element_at(codes, normal_code(c)), normal_code(c))
    known = lambda c: F.map_contains_key(codes, normal_code(c))
    judged = F.struct(every.alias("every"), corrections.cast(CORRECTIONS).alias("corrections"), known(d["nation"]).alias("known_nation"), known(d["issuer"]).alias("known_issuer"), look(d["nation"]).alias("nation"), look(d["issuer"]).alias("issuer"))
    df = df.withColumn("__judged", F.when(fmt.isNotNull(), judged))
    j, name = F.col("__judged"), d["name"]
    warnings = F.concat(
        name["warnings"],
        name["warnings"],  # once from the name, once from the whole record
        listed(
            F.when((name["surname"] == "") | (name["givenNames"] == ""), "Name is incomplete."),
            F.when(~j["known_nation"], "Nationality code is not recognized."),
            F.when(~j["known_issuer"], "Issuing country code is not recognized."),
            F.when(status["status"] == "EXPIRED", "Document is expired."),
            F.when(status["status"] == "EXPIRING_SOON", "Document expires within 30 days."),
            F.when(~F.coalesce(j["every"], F.lit(False)), "One or more MRZ check digits failed."),
        ),
    )
    no_text = F.array().cast("array<string>")
    full = collapse(F.concat(name["givenNames"], F.lit(" "), name["surname"]))
    fields = {
        "documentType": (d["kind"]["type"], "UNKNOWN"),
        "documentSubtype": (d["kind"]["subtype"], "UNKNOWN"),
        "mrzFormat": (fmt, "NONE"),
        "surname": (name["surname"], ""),
        "givenNames": (name["givenNames"], ""),
        "fullName": (full, ""),
        "nameConfidence": (name["confidence"], None),
        "removedNameNoiseTokens": (name["removed"], None),
        "nationality": (j["nation"], ""),
        "nationalityCode": (d["nation"], ""),
        "dateOfBirth": (born, ""),
        "gender": (gender(p["sex"]), "UNSPECIFIED"),
        "documentNumber": (F.regexp_replace(d["number"]["value"], "<", ""), ""),
        "issuingCountry": (j["issuer"], ""),
        "issuingCountryCode": (d["issuer"], ""),
        "issueDate": (F.lit(None).cast("string"), None),
        "expiryDate": (ends, ""),
        "expiryStatus": (status, expiry_status(F.lit(""), as_of)),
        "checkDigits": (F.struct(d["number"]["valid"], d["birth"]["valid"], d["expiry"]["valid"], d["composite"], j["every"]).cast(CHECKS), F.struct(*[F.lit(False)] * 5).cast(CHECKS)),
        "confidence": (
            confidence(F.lit(True), j["every"], status["status"], name["confidence"]["score"], j["known_nation"], d["kind"]["type"], j["corrections"]),
            F.struct(F.lit(0), F.lit("LOW"), F.array(F.lit("MRZ not parsed"))).cast(CONFIDENCE),
        ),
        "corrections": (j["corrections"], F.array().cast(CORRECTIONS)),
        "warnings": (warnings, F.array(F.lit(NOT_FOUND))),
        "mrzRaw": (F.col("__best.raw"), F.col("__lines")),
        "mrzCleaned": (F.col("__best.lines"), no_text),
        "rawOcrText": (present(F.col(text_col)), present(F.col(text_col))),
        "candidateScore": (F.col("__best.score"), None),
    }

    def pick(value: Column, default) -> Column:
        return F.when(fmt.isNotNull(), value) if default is None else F.when(fmt.isNotNull(), value).otherwise(default)

    return df.withColumn(out, F.struct(*[pick(v, e).alias(k) for k, (v, e) in fields.items()])).drop(*hidden)


def primary_score(m: Column, text: Column) -> Column:
    """The score of a page as a primary document, 0 to 100."""
    checks = m["checkDigits"]
    some = sum((F.when(checks[c], 8).otherwise(0) for c in ("documentNumber", "dateOfBirth", "expiryDate", "composite")), F.lit(0))
    parts = sum((F.when(has(m[c]), 5).otherwise(0) for c in ("surname", "givenNames", "dateOfBirth", "expiryDate", "issuingCountryCode", "nationalityCode")), F.lit(0))
    score = F.when(m["mrzFormat"] != "NONE", 40).otherwise(0) + F.when(checks["allValid"], 30).otherwise(some) + F.when(has(m["documentNumber"]), 10).otherwise(0) + parts
    score = score + F.floor(m["confidence"]["score"] / 10 + 0.5) + F.when(F.coalesce(text, F.lit("")).contains("<<"), 5).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), score)).cast("int")
