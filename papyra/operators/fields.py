"""Labelled fields in the lines of a secondary document.

Lines stay one array for each page: a label and its value are at most two lines apart, so nothing is exploded or shuffled.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.dates import secondary_date
from papyra.functions.text import EDGE, blank, collapse, drop_words, edged, first_match, let, literal, strip_accents

#: Lines that begin with one of these hold a label, not a value.
LABEL_LINES = (
    "FAMILY NAME", "SURNAME", "GIVEN NAME", "GIVEN NAMES", "DATE OF BIRTH", "DOB", "SEX", "GENDER", "COUNTRY OF BIRTH", "COUNTRY OF CITIZENSHIP",
    "NATIONALITY", "DATE ISSUED", "ISSUE DATE", "EXPIRY DATE", "EXPIRATION DATE", "APPLICATION NO", "UCI", "DOCUMENT NO", "PASSPORT NO", "VISA NO",
    "ADDITIONAL INFORMATION", "CLIENT INFORMATION", "VALID FROM", "VALID UNTIL", "DURATION OF STAY", "ENTRIES",
)
#: Print on forms that is no value; words that aren't part of a name; of a country.
BOILERPLATE = ("CLIENT INFORMATION", "ADDITIONAL INFORMATION", "PROTECTED WHEN COMPLETED", "NOT VALID FOR TRAVEL")
NAME_STOPS = ("FAMILY", "SURNAME", "GIVEN", "NAME", "NAMES", "FIRST", "LAST", "DATE", "BIRTH", "SEX", "COUNTRY", "CITIZENSHIP", "NATIONALITY", "VALID", "UNTIL", "FROM", "EXPIRY", "ISSUE")
COUNTRY_STOPS = ("DATE", "ISSUED", "ISSUE", "EXPIRY", "EXPIRATION", "COUNTRY", "CITIZENSHIP", "BIRTH", "NATIONALITY", "VALID", "UNTIL", "FROM")
DATE_HINTS = ("YYYY", "YYY", "MM", "DD", "OD")
MOST_CHARS = 60


def clean_lines(text: Column) -> Column:
    """Lines in capitals without accents, bars as I, plain quotes, single blanks; empty ones dropped."""
    lines = F.split(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), "\n")
    one = lambda x: collapse(F.translate(F.upper(strip_accents(x)), "|“”", 'I""'))
    return F.filter(F.transform(lines, one), lambda x: x != "")


def clean_value(value: Column) -> Column:
    text = F.regexp_replace(F.coalesce(value, F.lit("")), r"\([^)]*\)", "")
    text = F.regexp_replace(text, f"(?i){edged('(?:' + '|'.join(DATE_HINTS) + ')')}", "")
    return collapse(F.regexp_replace(blank(text), r"^[\s:;,\-.]+", ""))


def clean_name(value: Column) -> Column:
    return collapse(drop_words(F.regexp_replace(blank(F.upper(strip_accents(F.coalesce(value, F.lit(""))))), r"[^A-Z\s'-]", " "), NAME_STOPS))


def clean_country(value: Column) -> Column:
    return collapse(drop_words(F.regexp_replace(blank(F.upper(strip_accents(F.coalesce(value, F.lit(""))))), r"[^A-Z\s]", " "), COUNTRY_STOPS))


def clean_simple(value: Column) -> Column:
    return collapse(F.regexp_replace(blank(F.upper(F.coalesce(value, F.lit("")))), r"[^A-Z0-9\s/-]", ""))


#: How a value is cleaned, or that it is a date.
NAME, COUNTRY, SIMPLE, DATE = range(4)


def kind_of(label: str) -> int:
    """How a label's values are cleaned, by words in it."""
    if any(x in label for x in ("NAME", "NOM", "HOLDER")):
        return NAME
    return COUNTRY if any(x in label for x in ("CITIZENSHIP", "BIRTH", "NATION")) else SIMPLE


def is_label_line(line: Column) -> Column:
    return F.upper(line).rlike(f"^(?:{'|'.join(LABEL_LINES)}){EDGE}")


def is_useful(value: Column) -> Column:
    return (value != "") & (F.length(value) <= MOST_CHARS) & ~value.isin(*BOILERPLATE)


def _plain(label: str) -> str:
    return "".join(x for x in unicodedata.normalize("NFD", label) if not 0x300 <= ord(x) <= 0x36F).upper()


@dataclass(frozen=True)
class Field:
    """A field of a form: the labels that its value may stand behind, and whether it is a date."""

    name: str
    labels: tuple[str, ...]
    date: bool = False


#: Labels that a table of them may hold: it becomes one constant of the plan.
MOST_LABELS = 20_000
_TABLE = "array<array<struct<label:string,pattern:string,kind:int>>>"
_READ = "struct<value:string,stop:boolean>"


def fields_of(labels: DataFrame, date: str | None = "date") -> tuple[Field, ...]:
    """Fields from a table (field, field_ord, label, label_ord, date); both ordinals say what comes first."""
    rows = labels.select("field", "field_ord", "label", "label_ord", date).limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"over {MOST_LABELS} labels")
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["field_ord"], r["field"], r["label_ord"], r["label"])):
        found.setdefault(r["field"], []).append(r)
    return tuple(Field(name, tuple(r["label"] for r in own), bool(own[0][date])) for name, own in found.items())


def labels_frame(spark: SparkSession, found: tuple[Field, ...]) -> DataFrame:
    """The table that fields_of() reads."""
    rows = [(f.name, i, label, j, f.date) for i, f in enumerate(found) for j, label in enumerate(f.labels)]
    return spark.createDataFrame(rows, "field string, field_ord int, label string, label_ord int, date boolean")


def labelled(lines: Column, found: tuple[Field, ...]) -> Column:
    """The value of each field, as an array in the fields' order; '' where there is none.

    Lines are gone through in order, and for each line its field's labels. The value is what follows the label in its line, else
    one of the next two lines, up to a line that holds another label; a date may stand anywhere in these lines. Labels are data
    of one expression, whatever their number; a label's pattern is tried only in lines that contain it.
    """
    table = []
    for f in found:
        plain = list(dict.fromkeys(_plain(x) for x in f.labels))
        table.append([{"label": x, "pattern": rf"(?i){edged(literal(x))}\s*[:\-]?\s*(.*)\z", "kind": DATE if f.date else kind_of(x)} for x in plain])
    labels = F.from_json(F.lit(json.dumps(table, ensure_ascii=False)), _TABLE)
    none = F.lit(None).cast("string")

    def value(text: Column, kind: Column) -> Column:
        cleaned = lambda v: F.when(kind == NAME, clean_name(v)).when(kind == COUNTRY, clean_country(v)).otherwise(clean_simple(v))
        return F.when(kind == DATE, F.nullif(secondary_date(text), F.lit(""))).otherwise(let(clean_value(text), lambda v: F.when(is_useful(v), cleaned(v))))

    def read(z: Column, i: Column, label: Column) -> Column:
        line = F.get(z, i)
        rest = F.when(label["kind"] == DATE, line).otherwise(F.call_function("regexp_extract", line, label["pattern"], F.lit(1)))

        def step(s: Column, k: Column) -> Column:
            text = F.when(k == 0, rest).otherwise(F.coalesce(F.get(z, i + k), F.lit("")))
            next_one = let(text, lambda t: F.when((k > 0) & is_label_line(t), F.struct(none.alias("value"), F.lit(True).alias("stop")).cast(_READ)).otherwise(F.struct(value(t, label["kind"]).alias("value"), F.lit(False).alias("stop")).cast(_READ)))
            return F.when(s["stop"] | s["value"].isNotNull(), s).otherwise(next_one)

        start = F.struct(none.alias("value"), F.lit(False).alias("stop")).cast(_READ)
        return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), start, step, lambda s: s["value"])

    def of_field(z: Column, own: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            hit = lambda label: F.get(z, i).contains(label["label"]) & F.rlike(F.get(z, i), label["pattern"])
            return F.when(v.isNotNull(), v).otherwise(F.aggregate(own, none, lambda u, label: F.when(u.isNull() & hit(label), read(z, i, label)).otherwise(u)))

        return F.coalesce(F.when(F.size(z) > 0, F.aggregate(F.sequence(F.lit(0), F.size(z) - 1), none, at)), F.lit(""))

    return let(lines, lambda z: F.transform(labels, lambda own: of_field(z, own)))


def labelled_value(lines: Column, *labels: str) -> Column:
    return F.get(labelled(lines, (Field("value", labels),)), F.lit(0))


def labelled_date(lines: Column, *labels: str) -> Column:
    return F.get(labelled(lines, (Field("date", labels, True),)), F.lit(0))


#: Labels of document numbers, and the shape of a number without one.
NUMBER_LABELS = ("DOCUMENT NO", "DOCUMENT NUMBER", "DOC NO", "CARD NO", "PERMIT NO", "ID NUMBER")
BARE_NUMBER = edged("[A-Z]{1,4}[0-9]{5,12}")


def document_number(lines: Column, flat: Column, labelled_number: Column | None = None) -> Column:
    """labelled_number: what was read behind NUMBER_LABELS, if it is known already."""
    bare = clean_simple(F.regexp_extract(flat, BARE_NUMBER, 0))
    near = labelled_value(lines, *NUMBER_LABELS) if labelled_number is None else labelled_number
    return let(F.regexp_replace(near, r"\s", ""), lambda near: F.when(near.rlike(r"^[A-Z0-9]{5,25}\z"), near).otherwise(bare))


def all_matches(text: Column, pattern: str) -> Column:
    """Distinct cleaned matches, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), clean_simple))


def pattern_value(flat: Column, *patterns: str) -> Column:
    return first_match(flat, patterns, clean_simple)


def sex(value: Column) -> Column:
    v = F.trim(F.upper(value))
    return F.when(v.isin("M", "MALE"), "M").when(v.isin("F", "FEMALE"), "F").when(v == "X", "X").otherwise("")


#: Words of a text -> issuing country; the first that is found counts, also inside words.
ISSUERS = (("CANADA", "CAN"), ("UNITED ARAB EMIRATES", "ARE"), ("UAE", "ARE"), ("UNITED STATES", "USA"), ("UNITED KINGDOM", "GBR"), ("SAUDI ARABIA", "SAU"), ("QATAR", "QAT"), ("KUWAIT", "KWT"), ("BAHRAIN", "BHR"), ("OMAN", "OMN"), ("SCHENGEN", "SCHENGEN"))


def issuing_country(text: Column) -> Column:
    value = F.upper(strip_accents(F.coalesce(text, F.lit(""))))
    out = F.lit("")
    for word, code in reversed(ISSUERS):
        out = F.when(value.contains(word), code).otherwise(out)
    return out
