"""Two records of a case against each other: eight fields, alerts, a weighted score, a decision and its reason."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.config import NAME_SIMILARITY, REVIEW_MEDIUM_FROM, TOKEN_SIMILARITY, VERIFIED_FROM, WARNINGS_FROM
from papyra.functions.dates import is_date
from papyra.functions.text import blank, collapse, constant_map, drop_words, either, half_up, has, let, listed, present

#: Spellings of countries -> code; others stay as they are.
COUNTRY_ALIASES = {
    "CANADA": "CAN", "CAN": "CAN", "SYRIA": "SYR", "SYRIANARABREPUBLIC": "SYR", "SYR": "SYR", "UNITEDARABEMIRATES": "ARE", "UAE": "ARE", "ARE": "ARE", "SAUDIARABIA": "SAU",
    "KSA": "SAU", "SAU": "SAU", "UNITEDSTATES": "USA", "USA": "USA", "UNITEDKINGDOM": "GBR", "UK": "GBR", "GBR": "GBR",
}
NAME_STOPS = ("GIVEN", "NAME", "NAMES", "SURNAME", "FAMILY")
TITLES = ("MR", "MS", "MRS", "MISS")
WARNED = ("Partial Match", "Missing", "Not Available", "Invalid Date")

#: What notes, alerts and reasons say.
NOTES = {
    "identical": "Values are identical.",
    "name_missing": "Name could not be detected on one or both documents.",
    "name_order": "Same name tokens detected, but order is different.",
    "name_near": "Names are highly similar but not identical.",
    "missing": "One or both values were not detected.",
    "gender_unclear": "Gender could not be confidently normalized.",
    "gender": "Gender values are different.",
    "country": "Country value differs. This may be normal depending on document type.",
    "confusions": "Values match after OCR confusion correction.",
    "different": "Values are different.",
    "no_number": "Secondary document does not show a passport number. This is acceptable for some document types.",
    "no_nation": "Nationality or citizenship could not be detected.",
    "citizenship": "Secondary document shows citizenship. Citizenship may differ from issuing country or travel document nationality.",
    "no_secondary_nation": "Secondary document nationality/citizenship was not detected.",
    "no_issuers": "Issuing country was not detected on one or both documents.",
    "no_issuer": "Secondary document issuing country was not detected.",
    "same_issuer": "Both documents appear to be issued by the same country.",
    "other_issuer": "Different issuing countries can be normal for visas, residence permits, refugee documents, and travel documents.",
    "no_expiry": "Expiry date was not detected.",
    "bad_expiry": "Date format could not be validated.",
    "expired": " is expired.",
    "valid": " is valid.",
    "alert_expired": ": document is expired.",
    "alert_zone": "⚠ Primary document MRZ was not detected clearly.",
    "alert_kind": "ℹ Secondary document detected as: ",
    "verified": "All critical identity fields are valid and matched.",
    "attention_before": "Identity appears acceptable, but ",
    "attention_after": " field(s) require attention.",
    "rejected": "Critical issue detected: ",
    "identity": "identity mismatch",
    "review": "Document data could not be verified confidently and requires manual review.",
    "not_shown": "Not detected / not available",
}
FIELD = "struct<label:string,primaryValue:string,secondaryValue:string,status:string,statusClass:string,score:int,weight:int,critical:boolean,note:string>"
ABSENT = "Not detected"


def plain(value: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z0-9]", "")


def plain_name(value: Column) -> Column:
    return collapse(drop_words(F.regexp_replace(blank(F.upper(F.coalesce(value, F.lit("")))), r"[^A-Z\s]", " "), NAME_STOPS))


def name_tokens(value: Column) -> Column:
    return F.filter(F.split(plain_name(value), " "), lambda t: (F.length(t) > 1) & ~t.isin(*TITLES))


def sex(value: Column) -> Column:
    v = F.trim(F.upper(F.coalesce(value, F.lit(""))))
    return F.when(v.isin("M", "MALE"), "M").when(v.isin("F", "FEMALE"), "F").otherwise("")


def country(value: Column) -> Column:
    v = F.regexp_replace(F.upper(F.coalesce(value, F.lit(""))), "[^A-Z]", "")
    return F.coalesce(F.try_element_at(constant_map(COUNTRY_ALIASES), v), v)


def without_confusions(value: Column) -> Column:
    return F.translate(value, "OIBSZ", "01852")


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 1 if both are empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of a's distinct tokens that are, or nearly are, tokens of b, over the larger set."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    near = F.filter(x, lambda s: F.array_contains(y, s) | F.exists(y, lambda t: similarity(s, t) >= TOKEN_SIMILARITY))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(near) / F.greatest(F.size(x), F.size(y)))


def _field(label, p: Column, s: Column, status, score, weight: int, critical=False, note="") -> Column:
    status_class = {"Exact Match": "match", "Valid": "match", "Mismatch": "mismatch", "Expired": "mismatch"}
    parts = [label, p, s, status, status_class.get(status, "partial"), score, weight, critical, note]
    names = ("label", "primaryValue", "secondaryValue", "status", "statusClass", "score", "weight", "critical", "note")
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in zip(parts, names)]).cast(FIELD)


def _shown(value: Column) -> Column:
    return either(value, F.lit(ABSENT))


def match(label: str, p: Column, s: Column, weight: int, critical: bool) -> Column:
    return _field(label, _shown(p), _shown(s), "Exact Match", 100, weight, critical, NOTES["identical"])


def mismatch(label: str, p: Column, s: Column, note: str, weight: int, critical: bool) -> Column:
    return _field(label, _shown(p), _shown(s), "Mismatch", 0, weight, critical, note)


def compare_names(label: str, p: Column, s: Column, weight: int, critical: bool) -> Column:
    def sorted_tokens(x: Column) -> Column:
        return F.array_join(F.array_sort(x), " ")

    def judged(v: Column) -> Column:
        a, b, x, y = v["a"], v["b"], v["x"], v["y"]
        best = F.greatest(token_overlap(x, y), similarity(a, b))
        near = let(best, lambda n: F.when(n >= NAME_SIMILARITY, _field(label, p, s, "Partial Match", half_up(n * 100), weight, critical, NOTES["name_near"])).otherwise(mismatch(label, p, s, "Names do not match.", weight, critical)))
        return (
            F.when((a == "") | (b == ""), _field(label, _shown(p), _shown(s), "Missing", 55, weight, critical, NOTES["name_missing"]))
            .when(a == b, match(label, p, s, weight, critical))
            .when((F.size(x) > 0) & (sorted_tokens(x) == sorted_tokens(y)), _field(label, p, s, "Partial Match", 92, weight, critical, NOTES["name_order"]))
            .otherwise(near)
        )

    return let(F.struct(plain_name(p).alias("a"), plain_name(s).alias("b"), name_tokens(p).alias("x"), name_tokens(s).alias("y")), judged)


def compare_field(label: str, p: Column, s: Column, mode: str, weight: int = 10, critical: bool = False) -> Column:
    """A field of both records. mode: name, gender, country, or strict (equal but for characters that OCR confuses)."""
    return let(F.struct(present(p).alias("p"), present(s).alias("s")), lambda v: _compared(label, v["p"], v["s"], mode, weight, critical))


def _compared(label: str, p: Column, s: Column, mode: str, weight: int, critical: bool) -> Column:
    missing = _field(label, _shown(p), _shown(s), "Missing", 40 if critical else 65, weight, critical, NOTES["missing"])
    if mode == "name":
        rest = compare_names(label, p, s, weight, critical)
    elif mode == "gender":
        unclear = _field(label, _shown(p), _shown(s), "Missing", 65, weight, False, NOTES["gender_unclear"])
        rest = let(F.struct(sex(p).alias("x"), sex(s).alias("y")), lambda v: F.when((v["x"] == "") | (v["y"] == ""), unclear).when(v["x"] == v["y"], match(label, p, s, weight, critical)).otherwise(mismatch(label, p, s, NOTES["gender"], weight, critical)))
    elif mode == "country":
        other = _field(label, _shown(p), _shown(s), "Information Only", 80, weight, False, NOTES["country"])
        rest = F.when(country(p) == country(s), match(label, p, s, weight, critical)).otherwise(other)
    else:
        near = _field(label, p, s, "Partial Match", 90, weight, critical, NOTES["confusions"])
        a, b = plain(p), plain(s)
        rest = F.when(a == b, match(label, p, s, weight, critical)).when(without_confusions(a) == without_confusions(b), near).otherwise(mismatch(label, p, s, NOTES["different"], weight, critical))
    return F.when((plain(p) == "") | (plain(s) == ""), missing).otherwise(rest)


def compare_full_name(p: Column, s: Column) -> Column:
    whole = lambda r: either(r["fullName"], F.trim(F.concat(present(r["givenNames"]), F.lit(" "), present(r["surname"]))))
    return compare_field("Full Name", whole(p), whole(s), "name", 25)


def compare_document_number(p: Column, s: Column) -> Column:
    mine, theirs = either(p["holderNumber"], p["documentNumber"]), present(s["holderNumber"])
    none = _field("Passport Number", mine, F.lit(NOTES["not_shown"]), "Not Available", 75, 15, False, NOTES["no_number"])
    return F.when(theirs == "", none).otherwise(compare_field("Passport Number", mine, theirs, "strict", 15, True))


def compare_nationality(p: Column, s: Column) -> Column:
    both, mine, nation, citizen = "Nationality / Citizenship", present(p["nationality"]), present(s["nationality"]), present(s["citizenship"])
    absent = F.lit(ABSENT)
    return (
        F.when((mine == "") & (nation == "") & (citizen == ""), _field(both, absent, absent, "Missing", 65, 10, False, NOTES["no_nation"]))
        .when(nation != "", compare_field("Nationality", mine, nation, "country", 10, False))
        .when(citizen != "", _field(both, _shown(mine), citizen, "Information Only", 85, 10, False, NOTES["citizenship"]))
        .otherwise(_field(both, _shown(mine), absent, "Missing", 65, 10, False, NOTES["no_secondary_nation"]))
    )


def compare_issuing_country(p: Column, s: Column) -> Column:
    label, mine, theirs, absent = "Issuing Country", present(p["issuingCountry"]), present(s["issuingCountry"]), F.lit(ABSENT)
    return (
        F.when((mine == "") & (theirs == ""), _field(label, absent, absent, "Missing", 70, 5, False, NOTES["no_issuers"]))
        .when(theirs == "", _field(label, _shown(mine), absent, "Not Available", 75, 5, False, NOTES["no_issuer"]))
        .when(country(mine) == country(theirs), _field(label, mine, theirs, "Exact Match", 100, 5, False, NOTES["same_issuer"]))
        .otherwise(_field(label, _shown(mine), theirs, "Information Only", 85, 5, False, NOTES["other_issuer"]))
    )


def check_expiry(label: str, value: Column, primary: bool, as_of: dt.date) -> Column:
    value = present(value)
    p, s = (_shown(value), F.lit("")) if primary else (F.lit(""), _shown(value))
    day = F.when(is_date(value), F.try_to_date(value, "yyyy-MM-dd"))
    return (
        F.when(value == "", _field(label, p, s, "Missing", 70, 5, False, NOTES["no_expiry"]))
        .when(day.isNull(), _field(label, p, s, "Invalid Date", 60, 5, False, NOTES["bad_expiry"]))
        .when(day < F.lit(as_of), _field(label, p, s, "Expired", 0, 5, True, label + NOTES["expired"]))
        .otherwise(_field(label, p, s, "Valid", 100, 5, False, label + NOTES["valid"]))
    )


def field_rows(p: Column, s: Column, as_of: dt.date) -> Column:
    """The eight fields, in their order."""
    return F.array(
        compare_full_name(p, s),
        compare_field("Date of Birth", p["dateOfBirth"], s["dateOfBirth"], "strict", 25),
        compare_field("Gender", p["gender"], s["gender"], "gender", 10),
        compare_document_number(p, s),
        compare_nationality(p, s),
        compare_issuing_country(p, s),
        check_expiry("Primary Document Expiry", p["expiryDate"], True, as_of),
        check_expiry("Secondary Document Expiry", s["expiryDate"], False, as_of),
    )


def alerts(fields: Column, mrz_text: Column, secondary_type: Column) -> Column:
    def of(f: Column) -> Column:
        named = F.concat(f["label"], F.lit(": "), f["note"])
        return (
            F.when(f["status"] == "Mismatch", F.concat(F.lit("❌ "), named))
            .when(f["status"] == "Expired", F.concat(F.lit("❌ "), f["label"], F.lit(NOTES["alert_expired"])))
            .when(f["status"].isin(*WARNED), F.concat(F.lit("⚠ "), named))
            .when(f["status"] == "Information Only", F.concat(F.lit("ℹ "), named))
        )

    record = listed(F.when(~has(mrz_text), F.lit(NOTES["alert_zone"])), F.when(has(secondary_type), F.concat(F.lit(NOTES["alert_kind"]), secondary_type, F.lit("."))))
    return F.concat(F.filter(F.transform(fields, of), lambda x: x.isNotNull()), record)


def weighted_score(fields: Column) -> Column:
    """The weighted mean of the scores, halves up; a weight of 0 counts as 1."""
    weight = lambda f: F.when(F.coalesce(f["weight"], F.lit(0)) == 0, 1).otherwise(f["weight"])
    total = F.aggregate(fields, F.lit(0), lambda a, f: a + weight(f))
    return half_up(F.aggregate(fields, F.lit(0), lambda a, f: a + F.coalesce(f["score"], F.lit(0)) * weight(f)) / total)


def decide(fields: Column, score: Column) -> Column:
    hit = lambda test: F.exists(fields, test)
    critical = hit(lambda f: f["critical"] & f["status"].isin("Expired", "Mismatch"))
    name = hit(lambda f: (f["label"] == "Full Name") & (f["status"] == "Mismatch"))
    born = hit(lambda f: (f["label"] == "Date of Birth") & (f["status"] == "Mismatch"))
    return F.when(critical | (name & born), "REJECTED").when(score >= VERIFIED_FROM, "VERIFIED").when(score >= WARNINGS_FROM, "VERIFIED WITH WARNINGS").otherwise("MANUAL REVIEW REQUIRED")


def risk_level(decision: Column, score: Column) -> Column:
    return F.when(decision == "VERIFIED", "LOW").when(decision == "VERIFIED WITH WARNINGS", "MEDIUM").when(decision == "REJECTED", "HIGH").when(score >= REVIEW_MEDIUM_FROM, "MEDIUM").otherwise("HIGH")


def reason(fields: Column, decision: Column) -> Column:
    bad = F.array_join(F.transform(F.filter(fields, lambda f: f["critical"] & f["status"].isin("Mismatch", "Expired")), lambda f: f["label"]), ", ")
    warned = F.size(F.filter(fields, lambda f: f["status"].isin(*WARNED)))
    return (
        F.when(decision == "VERIFIED", NOTES["verified"])
        .when(decision == "VERIFIED WITH WARNINGS", F.concat(F.lit(NOTES["attention_before"]), warned.cast("string"), F.lit(NOTES["attention_after"])))
        .when(decision == "REJECTED", F.concat(F.lit(NOTES["rejected"]), either(bad, F.lit(NOTES["identity"])), F.lit(".")))
        .otherwise(NOTES["review"])
    )


def compare_records(pairs: DataFrame, as_of: dt.date, primary: str = "primary", secondary: str = "secondary") -> DataFrame:
    """pairs, with two struct columns of records, and decision, riskLevel, score, reason, fields, alerts."""
    p, s = F.col(primary), F.col(secondary)
    df = pairs.withColumn("fields", field_rows(p, s, as_of))
    df = df.withColumn("score", weighted_score(F.col("fields")))
    df = df.withColumn("decision", decide(F.col("fields"), F.col("score")))
    return df.withColumns({"riskLevel": risk_level(F.col("decision"), F.col("score")), "reason": reason(F.col("fields"), F.col("decision")), "alerts": alerts(F.col("fields"), p["mrzRawData"], s["documentType"])})


def compare_documents(primary: DataFrame, secondary: DataFrame, as_of: dt.date, key: str = "case_id") -> DataFrame:
    """One verdict for each key that both tables have: key, decision, riskLevel, score, reason, fields, alerts."""
    a = primary.select(key, F.struct(*[c for c in primary.columns if c != key]).alias("primary"))
    b = secondary.select(key, F.struct(*[c for c in secondary.columns if c != key]).alias("secondary"))
    return compare_records(a.join(b, key), as_of).select(key, "decision", "riskLevel", "score", "reason", "fields", "alerts")


def comparison_rows(verdicts: DataFrame, key: str = "case_id") -> DataFrame:
    """One row for each field of each verdict, numbered from 0."""
    return verdicts.select(key, F.posexplode("fields").alias("field_ord", "f")).select(key, "field_ord", "f.*")
