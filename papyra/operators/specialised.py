"""Readers for two families of secondary documents, offered by name; no classification leads to them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.countries import country_map, country_names, normal_code
from papyra.functions.dates import expiry_status, residence_date, visa_date
from papyra.functions.names import grade
from papyra.functions.text import blank, collapse, either, first_match, has, let, listed, strip_accents

from .mrz import CHECKS, parse_mrz

_B = "(?<![A-Za-z0-9_])"
_E = "(?![A-Za-z0-9_])"
_SEP = r"\s*[:\-]?\s*"
_DMY = r"([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4})"
_ANY_DATE = r"([0-9]{1,2}[/\-.][0-9]{1,2}[/\-.][0-9]{2,4}|[0-9]{4}[/\-.][0-9]{1,2}[/\-.][0-9]{1,2})"
_NO = r"\s*(NO|NUMBER)?"
_NAME = r"([A-Z\s'-]+)"
_WORDS = r"([A-Z\s]+)"


def _p(*patterns: str) -> tuple[str, ...]:
    return tuple(f"(?i){_B}{p}" for p in patterns)


#: Patterns of short-stay visas. Values may run over lines.
SCHENGEN = {
    "visaType": _p(rf"TYPE\s+OF\s+VISA{_SEP}([ABCD])", rf"TYPE{_SEP}([ABCD]){_E}"),
    "validFor": _p(rf"VALID\s+FOR{_SEP}{_WORDS}", rf"VALABLE\s+POUR{_SEP}{_WORDS}"),
    "validFrom": _p(rf"FROM{_SEP}{_DMY}", rf"VALID\s+FROM{_SEP}{_DMY}"),
    "validUntil": _p(rf"UNTIL{_SEP}{_DMY}", rf"VALID\s+UNTIL{_SEP}{_DMY}"),
    "entries": _p(rf"NUMBER\s+OF\s+ENTRIES{_SEP}(MULT|MULTIPLE|[0-9]{{1,2}})", rf"ENTRIES{_SEP}(MULT|MULTIPLE|[0-9]{{1,2}})"),
    "duration": _p(rf"DURATION\s+OF\s+STAY{_SEP}([0-9]{{1,3}})", rf"DURATION{_SEP}([0-9]{{1,3}})"),
    "issuingPost": _p(rf"ISSUED\s+IN{_SEP}{_WORDS}", rf"ISSUING\s+AUTHORITY{_SEP}{_WORDS}"),
    "remarks": _p(rf"REMARKS{_SEP}([A-Z0-9\s/-]+)", rf"OBSERVATIONS{_SEP}([A-Z0-9\s/-]+)"),
    "holderNumber": _p(rf"PASSPORT{_NO}{_SEP}([A-Z0-9]{{5,20}})"),
    "surname": _p(rf"SURNAME{_SEP}{_NAME}", rf"FAMILY\s+NAME{_SEP}{_NAME}"),
    "givenNames": _p(rf"GIVEN\s+NAMES?{_SEP}{_NAME}", rf"FIRST\s+NAME{_SEP}{_NAME}"),
}

#: Patterns of residence visas, entry permits and identity cards of the Emirates.
UAE = {
    "visaNumber": _p(rf"VISA{_NO}{_SEP}([0-9]{{2,4}}/[0-9]{{4}}/[0-9]{{4,12}})", rf"PERMIT{_NO}{_SEP}([A-Z0-9/-]{{6,25}})"),
    "uid": _p(rf"UID{_NO}{_SEP}([0-9]{{6,20}})"),
    "fileNumber": _p(rf"FILE{_NO}{_SEP}([0-9/.-]{{6,25}})", rf"UNIFIED{_NO}{_SEP}([0-9]{{6,20}})"),
    "emiratesId": _p(rf"EMIRATES\s*ID{_SEP}([0-9\-]{{10,25}})", rf"ID\s*NUMBER{_SEP}([0-9\-]{{10,25}})"),
    "holderNumber": _p(rf"PASSPORT{_NO}{_SEP}([A-Z0-9]{{5,20}})"),
    "surname": _p(rf"SURNAME{_SEP}{_NAME}", rf"FAMILY\s+NAME{_SEP}{_NAME}"),
    "givenNames": _p(rf"GIVEN\s+NAMES?{_SEP}{_NAME}", rf"NAME{_SEP}{_NAME}"),
    "nationality": _p(rf"NATIONALITY{_SEP}{_WORDS}"),
    "dob": _p(rf"DATE\s+OF\s+BIRTH{_SEP}{_ANY_DATE}", rf"DOB{_SEP}{_ANY_DATE}"),
    "gender": _p(rf"SEX{_SEP}(M|F|MALE|FEMALE)", rf"GENDER{_SEP}(M|F|MALE|FEMALE)"),
    "issueDate": _p(rf"ISSUE\s+DATE{_SEP}{_ANY_DATE}"),
    "expiryDate": _p(rf"EXPIRY\s+DATE{_SEP}{_ANY_DATE}", rf"VALID\s+UNTIL{_SEP}{_ANY_DATE}"),
    "sponsor": _p(rf"SPONSOR\s*(NAME)?{_SEP}([A-Z0-9\s'-]+)"),
    "sponsorNumber": _p(rf"SPONSOR{_NO}{_SEP}([A-Z0-9/-]{{5,25}})"),
    "profession": _p(rf"PROFESSION{_SEP}{_NAME}", rf"OCCUPATION{_SEP}{_NAME}"),
    "entryType": _p(rf"ENTRY\s*TYPE{_SEP}(SINGLE|MULTIPLE|TRANSIT)", rf"TYPE{_SEP}(SINGLE|MULTIPLE|TRANSIT)"),
    "portOfEntry": _p(rf"PORT\s+OF\s+ENTRY{_SEP}{_WORDS}", rf"ENTRY\s+PORT{_SEP}{_WORDS}"),
}
#: Words for nationalities -> code, in the order they are looked for.
NATIONALITIES = (("SYRIA", "SYR"), ("SYRIAN", "SYR"), ("INDIA", "IND"), ("INDIAN", "IND"), ("PAKISTAN", "PAK"), ("PAKISTANI", "PAK"), ("CANADA", "CAN"), ("CANADIAN", "CAN"), ("UAE", "ARE"), ("UNITED ARAB EMIRATES", "ARE"))


def _normal(text: Column) -> Column:
    return F.translate(blank(F.upper(strip_accents(F.coalesce(text, F.lit(""))))), "\r", "\n")


def _clean(kept: str):
    return lambda value: F.trim(F.regexp_replace(F.regexp_replace(blank(value), r"\s+", " "), f"(?i)[^A-Z0-9\\s{kept}]", ""))


#: Warnings, and what points are for.
NOTES = {
    "short_expiry": "Schengen visa expiry date not detected.",
    "short_name": "Holder name not fully detected from visa text.",
    "expiry": "Expiry date not detected.",
    "name": "Name not fully detected.",
    "number": "Passport number not detected.",
    "document_found": "document number detected",
    "holder_found": "passport number detected",
    "name_found": "name detected",
    "expiry_found": "expiry detected",
}


def _score(base: int, points: list[tuple[Column, int, str]], warnings: Column) -> Column:
    score = sum((F.when(ok, n).otherwise(0) for ok, n, _ in points), F.lit(base)) - 5 * F.size(warnings)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score))
    lines = listed(*[F.when(ok, f"+{n} {what}") for ok, n, what in points])
    return F.struct(score.alias("score"), grade(score).alias("grade"), lines.alias("breakdown"))


def _full(given: Column, surname: Column) -> Column:
    return collapse(F.concat(given, F.lit(" "), surname))


def _fields(pages: DataFrame, text_col: str, patterns: dict[str, tuple[str, ...]], clean) -> DataFrame:
    df = pages.withColumn("__t", _normal(F.col(text_col)))
    # bound, as the optimizer puts the fields of a plain struct wherever they are named, and each pattern is then tried as often
    return df.withColumn("__f", let(F.col("__t"), lambda t: F.struct(*[first_match(t, p, clean).alias(k) for k, p in patterns.items()])))


def read_schengen(pages: DataFrame, text_col: str, as_of: dt.date, out: str = "record") -> DataFrame:
    """pages with the record of a short-stay visa; what its text lacks comes from its zone."""
    clean = _clean("'/-")
    df = parse_mrz(_fields(pages, text_col, SCHENGEN, clean), text_col, as_of, "__m")
    f, m = F.col("__f"), F.col("__m")
    until, since = visa_date(f["validUntil"]), visa_date(f["validFrom"])
    named = has(f["surname"]) & has(f["givenNames"])
    warnings = listed(F.when(until == "", NOTES["short_expiry"]), F.when(~named, NOTES["short_name"]))
    surname, given = either(f["surname"], m["surname"]), either(f["givenNames"], m["givenNames"])
    trust = _score(20, [(m["mrzFormat"] != "NONE", 40, "MRZ detected"), (until != "", 15, NOTES["expiry_found"]), (named, 10, NOTES["name_found"])], warnings)
    record = {
        "documentType": F.lit("VISA"), "documentSubtype": F.lit("SCHENGEN"), "mrzFormat": m["mrzFormat"], "surname": surname, "givenNames": given, "fullName": _full(given, surname),
        "nationality": m["nationality"], "nationalityCode": m["nationalityCode"], "dateOfBirth": m["dateOfBirth"], "gender": m["gender"], "documentNumber": either(f["holderNumber"], m["documentNumber"]),
        "issuingCountry": either(f["validFor"], F.lit("Schengen Area")), "issuingCountryCode": F.lit("SCHENGEN"), "issueDate": F.lit(None).cast("string"), "expiryDate": until, "visaType": f["visaType"], "validFor": f["validFor"],
        "validFrom": since, "validUntil": until, "entries": F.when(f["entries"] == "MULTIPLE", "MULT").otherwise(f["entries"]), "durationOfStay": f["duration"], "issuingPost": f["issuingPost"], "remarks": f["remarks"],
        "expiryStatus": expiry_status(until, as_of), "checkDigits": m["checkDigits"], "confidence": trust, "corrections": F.array().cast("array<struct<field:string,original:string,corrected:string>>"), "warnings": warnings,
        "mrzRaw": m["mrzRaw"], "mrzCleaned": m["mrzCleaned"], "rawOcrText": F.coalesce(F.col(text_col), F.lit("")),
    }
    return df.withColumn(out, F.struct(*[c.alias(k) for k, c in record.items()])).drop("__t", "__f", "__m")


def uae_subtype(text: Column) -> Column:
    return (
        F.when(text.contains("EMIRATES ID") | text.contains("IDENTITY CARD"), "EMIRATES_ID")
        .when(text.contains("ENTRY PERMIT"), "ENTRY_PERMIT")
        .when(text.contains("RESIDENCE"), "UAE_RESIDENCE_VISA")
        .when(text.contains("TRANSIT"), "TRANSIT_VISA")
        .otherwise("UAE_VISA_OR_RESIDENCE")
    )


def nationality_code(value: Column) -> Column:
    """Three letters stay as they are; else the first word that is found decides."""
    v = F.upper(F.coalesce(value, F.lit("")))
    out = F.lit("")
    for word, code in reversed(NATIONALITIES):
        out = F.when(v.contains(word), code).otherwise(out)
    return F.when(v.rlike(r"^[A-Z]{3}\z"), v).otherwise(out)


def read_uae(pages: DataFrame, text_col: str, as_of: dt.date, out: str = "record") -> DataFrame:
    """pages with the record of a residence visa, entry permit or identity card of the Emirates."""
    df = _fields(pages, text_col, UAE, _clean("'/.:-"))
    f = F.col("__f")
    subtype = uae_subtype(F.col("__t"))
    expiry = residence_date(f["expiryDate"])
    named = has(f["surname"]) | has(f["givenNames"])
    number = either(f["visaNumber"], f["emiratesId"], f["uid"])
    warnings = listed(F.when(expiry == "", NOTES["expiry"]), F.when(~named, NOTES["name"]), F.when(~has(f["holderNumber"]), NOTES["number"]))
    code = nationality_code(f["nationality"])
    names = country_map(country_names(pages.sparkSession))
    g = F.upper(f["gender"])
    trust = _score(25, [(named, 10, NOTES["name_found"]), (has(number), 20, NOTES["document_found"]), (expiry != "", 15, NOTES["expiry_found"]), (has(f["holderNumber"]), 15, NOTES["holder_found"])], warnings)
    no = F.array().cast("array<string>")
    record = {
        "documentType": F.when(subtype == "EMIRATES_ID", "IDENTITY_CARD").otherwise("RESIDENCE"), "documentSubtype": subtype, "mrzFormat": F.lit("NONE"), "surname": f["surname"], "givenNames": f["givenNames"],
        "fullName": _full(f["givenNames"], f["surname"]), "nationality": F.coalesce(F.try_element_at(names, normal_code(code)), code), "nationalityCode": code, "dateOfBirth": residence_date(f["dob"]),
        "gender": F.when(g.isin("M", "MALE"), "MALE").when(g.isin("F", "FEMALE"), "FEMALE").otherwise("UNSPECIFIED"), "documentNumber": number, "issuingCountry": F.lit("United Arab Emirates"), "issuingCountryCode": F.lit("ARE"),
        "issueDate": residence_date(f["issueDate"]), "expiryDate": expiry, "uid": f["uid"], "fileNumber": f["fileNumber"], "emiratesId": f["emiratesId"], "holderNumber": f["holderNumber"], "visaNumber": f["visaNumber"],
        "entryType": f["entryType"], "profession": f["profession"], "sponsorName": f["sponsor"], "sponsorNumber": f["sponsorNumber"], "portOfEntry": f["portOfEntry"], "expiryStatus": expiry_status(expiry, as_of),
        "checkDigits": F.struct(*[F.lit(False)] * 5).cast(CHECKS), "confidence": trust, "corrections": F.array().cast("array<struct<field:string,original:string,corrected:string>>"), "warnings": warnings, "mrzRaw": no, "mrzCleaned": no,
        "rawOcrText": F.coalesce(F.col(text_col), F.lit("")),
    }
    return df.withColumn(out, F.struct(*[c.alias(k) for k, c in record.items()])).drop("__t", "__f")
