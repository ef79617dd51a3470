"""Secondary documents (visas, permits, residence papers): pages to one record for each case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.config import LOW_SECONDARY_SCORE
from papyra.functions.text import has, present

from . import fields as f
from .classify import RULES, Rule, Rules, classify, normalize
from .pages import best_page

#: Patterns of numbers, the number in the last group.
VISA_NUMBER = tuple(rf"(?i){w}\s*(NO|NUMBER)?\s*[:\-]?\s*([A-Z0-9]{{5,25}})" for w in ("VISA", "VAF", "VIGNETTE"))
HOLDER_NUMBER = (r"(?i)PASSPORT\s*(NO|NUMBER)?\s*[:\-]?\s*([A-Z0-9]{5,25})", r"(?i)P\.?\s*NO\s*[:\-]?\s*([A-Z0-9]{5,25})", r"(?i)DOCUMENT\s*(NO|NUMBER)?\s*[:\-]?\s*([A-Z0-9]{5,25})")
APPLICATION_NUMBER = tuple(rf"(?i){w}\s*(NO|NUMBER)?\s*[:\-]?\s*([A-Z0-9]{{5,25}})" for w in ("APPLICATION", "APP"))
UCI = tuple(rf"(?i)(?<![A-Za-z0-9_]){w}\s*[:\-]?\s*([A-Z0-9]{{5,20}})" for w in ("UCI", "UC"))

#: Points for what a page shows, by field.
POINTS = {
    "documentNumber": 12, "visaNumber": 12, "holderNumber": 12, "applicationNumber": 10, "uci": 10, "surname": 8, "givenNames": 8, "fullName": 8,
    "dateOfBirth": 10, "gender": 5, "expiryDate": 10, "issueDate": 5, "issuingCountry": 5,
}
LOW_WARNING = "Low confidence secondary document read. Please use a clearer image or PDF scan."


def category(kind: Column) -> Column:
    out = F.lit("Other")
    rules = (
        (("Passport", "Travel Document"), "Primary Travel Document"),
        (("Visa", "Permit"), "Immigration Authorization"),
        (("Resident", "Residence"), "Residence Document"),
        (("ID", "Identity"), "Identity Document"),
        (("Refugee Protection Claimant",), "Immigration / Protection Document"),
    )
    for words, name in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | kind.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


#: The labels of each field, in the order they are tried.
FIELDS = (
    f.Field("surname", ("FAMILY NAME", "SURNAME", "LAST NAME", "NOM")),
    f.Field("givenNames", ("GIVEN NAME(S)", "GIVEN NAMES", "GIVEN NAME", "FIRST NAME", "FORENAME", "PRENOMS", "PRÉNOMS")),
    f.Field("fullName", ("FULL NAME", "NAME OF HOLDER", "HOLDER", "NAME")),
    f.Field("documentNumber", f.NUMBER_LABELS),
    f.Field("nationality", ("NATIONALITY", "NATION")),
    f.Field("citizenship", ("COUNTRY OF CITIZENSHIP", "CITIZENSHIP")),
    f.Field("countryOfBirth", ("COUNTRY OF BIRTH", "PLACE OF BIRTH", "BIRTH PLACE")),
    f.Field("dateOfBirth", ("DATE OF BIRTH", "DOB", "BIRTH"), True),
    f.Field("gender", ("SEX", "GENDER")),
    f.Field("issueDate", ("DATE ISSUED", "ISSUE DATE", "DATE OF ISSUE", "ISSUED"), True),
    f.Field("expiryDate", ("EXPIRY DATE", "EXPIRATION DATE", "VALID UNTIL", "VALID TO", "EXPIRES"), True),
    f.Field("entries", ("ENTRIES", "NO. OF ENTRIES", "NUMBER OF ENTRIES")),
    f.Field("durationOfStay", ("DURATION OF STAY", "DURATION")),
    f.Field("validFrom", ("VALID FROM", "FROM"), True),
    f.Field("validUntil", ("VALID UNTIL", "VALID TO", "UNTIL"), True),
)


def extract(pages: DataFrame, text_col: str = "full_text", rules: Rules | tuple[Rule, ...] = RULES, out: str = "data", labels: tuple[f.Field, ...] = FIELDS) -> DataFrame:
    """pages with two struct columns: classification, and `out`, the 26 fields read from text_col. labels: those of other forms,
    for the fields named in FIELDS; fields without labels are empty."""
    df = pages.withColumns({"__lines": f.clean_lines(F.col(text_col)), "__normal": normalize(F.col(text_col))})
    df = df.withColumns({"classification": classify(F.col("__normal"), rules), "__flat": F.array_join("__lines", "\n"), "__found": f.labelled(F.col("__lines"), labels)})
    lines, flat, kind = F.col("__lines"), F.col("__flat"), F.col("classification.type")
    place = {x.name: i for i, x in enumerate(labels)}
    found = lambda name: F.get(F.col("__found"), F.lit(place[name])) if name in place else F.lit("")
    surname, given = found("surname"), found("givenNames")
    full = F.when(has(given) & has(surname), F.concat(given, F.lit(" "), surname)).otherwise(found("fullName"))
    read = {
        "documentType": kind,
        "classificationType": kind,
        "classificationConfidence": F.concat(F.col("classification.confidence").cast("string"), F.lit("%")),
        "documentCategory": category(kind),
        "documentNumber": f.document_number(lines, flat, found("documentNumber")),
        "visaNumber": f.pattern_value(flat, *VISA_NUMBER),
        "holderNumber": f.pattern_value(flat, *HOLDER_NUMBER),
        "applicationNumber": f.pattern_value(flat, *APPLICATION_NUMBER),
        "uci": f.pattern_value(flat, *UCI),
        "surname": surname,
        "givenNames": given,
        "fullName": f.clean_name(full),
        **{k: found(k) for k in ("nationality", "citizenship", "countryOfBirth", "dateOfBirth")},
        "gender": f.sex(found("gender")),
        **{k: found(k) for k in ("issueDate", "expiryDate", "entries", "durationOfStay", "validFrom", "validUntil")},
        "issuingCountry": f.issuing_country(F.col(text_col)),
        "matchedClassificationKeywords": F.array_join("classification.matchedKeywords", ", "),
        "confidenceScore": F.when(has(F.col(text_col)), "OCR detected text. Field extraction uses line-based parsing and document classification.").otherwise("OCR library unavailable or no text detected."),
    }
    return df.withColumn(out, F.struct(*[v.alias(k) for k, v in read.items()])).drop("__lines", "__normal", "__flat", "__found")


def page_score(text: Column, confidence: Column, data: Column) -> Column:
    """The score of a page as a secondary document, 0 to 100."""
    score = F.when(F.length(F.trim(F.coalesce(text, F.lit("")))) > 30, 20).otherwise(0) + F.least(F.lit(30), confidence)
    score = sum((F.when(has(data[k]), v).otherwise(0) for k, v in POINTS.items()), score)
    return F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")


def _scored_pages(pages: DataFrame, rules: Rules | tuple[Rule, ...], labels: tuple[f.Field, ...] = FIELDS) -> DataFrame:
    read = extract(pages.withColumn("full_text", present(F.col("full_text"))), "full_text", rules, labels=labels)
    return read.withColumn("score", page_score(F.col("full_text"), F.col("classification.confidence"), F.col("data")))


def secondary_pages(pages: DataFrame, rules: Rules | tuple[Rule, ...] = RULES) -> DataFrame:
    """pages with their score and the record that each would give by itself."""
    scored = _scored_pages(pages, rules)
    warning = F.when(F.col("score") < LOW_SECONDARY_SCORE, LOW_WARNING)
    names = scored.schema["data"].dataType.names
    record = F.struct(*[F.col(f"data.{c}").alias(c) for c in names], F.col("page_number").alias("selectedPage"), F.col("score").alias("processingScore"), warning.alias("warnings"))
    return scored.withColumn("record", record).drop("data", "classification")


def read_secondary(pages: DataFrame, rules: Rules | tuple[Rule, ...] = RULES, labels: tuple[f.Field, ...] = FIELDS) -> DataFrame:
    """One record for each case_id of pages (case_id, page_number, full_text): that of its best page.

    The best page has the highest score; of equal ones the first counts. A case whose best page scores low has a warning,
    others have none (null). Null texts are read as empty pages.
    """
    scored = _scored_pages(pages, rules, labels)
    best = best_page(scored, "case_id", "page_number", "score", ["data", "classification"])
    warning = F.when(F.col("score") < LOW_SECONDARY_SCORE, LOW_WARNING)
    names = scored.schema["data"].dataType.names
    return best.select("case_id", *[F.col(f"data.{c}").alias(c) for c in names], F.col("page_number").alias("selectedPage"), F.col("score").alias("processingScore"), warning.alias("warnings"), "attempts")
