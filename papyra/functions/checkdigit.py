"""Check digits of machine-readable zones (weights 7, 3, 1) and their use to correct misread characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.config import MAX_NUMBER_VARIANTS

from .text import let

#: A character's worth is its place here; all others are worth 0.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WEIGHTS = (7, 3, 1)
#: Characters that OCR confuses, in fields of digits, in fields of letters, and in document numbers.
DIGIT_FROM, DIGIT_TO = "OILBSZGQD", "011852600"
ALPHA_FROM, ALPHA_TO = "018526", "OIBSZG"
NUMBER_FROM, NUMBER_TO = "O0IL1B8S5Z2G6", "0O11I8B5S2Z6G"

CORRECTION = "struct<value:string,valid:boolean,corrections:int>"


def check_digit(field: Column, length: int | None = None) -> Column:
    """The check digit of field, or of its first characters if a length is named.

    A fold, not a sum of so many terms: those of a long field don't fit a compiled method, and each task would find that out anew.
    """
    weight = F.array(*[F.lit(w) for w in WEIGHTS])
    worth = lambda text, i: F.greatest(F.instr(F.lit(ALPHABET), F.substr(text, i, F.lit(1))) - 1, F.lit(0)) * F.get(weight, (i - 1) % 3)

    def summed(text: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)) if length is None else F.lit(length))
        return F.aggregate(places, F.lit(0), lambda a, i: a + worth(text, i)) % 10

    return let(F.upper(F.coalesce(field, F.lit(""))), summed)


def validate(field: Column, digit: Column, length: int | None = None) -> Column:
    """True if digit is field's check digit. A missing digit or a filler is never valid."""
    return F.coalesce((digit != "<") & (check_digit(field, length).cast("string") == digit), F.lit(False))


def correct_digits(field: Column) -> Column:
    """struct(value, corrections): letters that stand for digits replaced; one correction (index, original, corrected) each."""
    text = F.upper(F.coalesce(field, F.lit("")))
    return _corrected(text, DIGIT_FROM, DIGIT_TO)


def correct_letters(field: Column) -> Column:
    text = F.upper(F.coalesce(field, F.lit("")))
    return _corrected(text, ALPHA_FROM, ALPHA_TO)


def _corrected(text: Column, a: str, b: str) -> Column:
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    each = F.transform(chars, lambda ch, i: F.struct(i.alias("index"), ch.alias("original"), F.translate(ch, a, b).alias("corrected")))
    return F.struct(F.translate(text, a, b).alias("value"), F.filter(each, lambda x: x["original"] != x["corrected"]).alias("corrections"))


def number_variants(field: Column, most: int = MAX_NUMBER_VARIANTS) -> Column:
    """array<struct(value, corrections)>: readings of a document number with ambiguous characters toggled.

    Reading k toggles the j-th of m ambiguous places where bit m-1-j of k is set, which is the order of a depth-first search
    that tries each character as it is before its twin.
    """
    return _with_places(field, lambda chars, places: _readings(chars, places, most, lambda ks, reading: F.transform(ks, reading)))


def first_valid_variant(field: Column, digit: Column, most: int = MAX_NUMBER_VARIANTS) -> Column:
    """The first of number_variants() whose check digit is digit, else null; those after it are not made."""
    kind = "struct<value:string,corrections:int>"
    kept = lambda v: F.when(validate(v["value"], digit), v).cast(kind)

    def found(ks: Column, reading) -> Column:
        return F.aggregate(ks, F.lit(None).cast(kind), lambda got, k: F.when(got.isNotNull(), got).otherwise(let(reading(k), kept)))

    return _with_places(field, lambda chars, places: _readings(chars, places, most, found))


def _with_places(field: Column, body) -> Column:
    """body(characters, indices of the ambiguous ones)"""
    chars = F.filter(F.split(F.upper(F.coalesce(field, F.lit(""))), ""), lambda ch: ch != "")
    places = lambda c: F.filter(F.transform(c, lambda ch, i: F.when(F.instr(F.lit(NUMBER_FROM), ch) > 0, i)), lambda i: i.isNotNull())
    return let(chars, lambda c: let(F.struct(c.alias("chars"), places(c).alias("places")), lambda x: body(x["chars"], x["places"])))


def _readings(chars: Column, places: Column, most: int, of) -> Column:
    """of(numbers of the readings, reading)"""
    m = F.size(places)
    last = F.when(m < 10, F.least(F.pow(F.lit(2), m).cast("int"), F.lit(most))).otherwise(most) - 1

    def reading(k: Column) -> Column:
        def char(ch: Column, i: Column) -> Column:
            j = F.array_position(places, i) - 1
            on = (j >= 0) & (m - 1 - j < 31) & (F.floor(k / F.pow(F.lit(2), F.least(m - 1 - j, F.lit(31)))) % 2 == 1)
            return F.when(on, F.translate(ch, NUMBER_FROM, NUMBER_TO)).otherwise(ch)

        return F.struct(F.array_join(F.transform(chars, char), "").alias("value"), F.bit_count(k).alias("corrections"))

    return of(F.sequence(F.lit(0), last), reading)


def correct_with_check_digit(field: Column, digit: Column, kind: str) -> Column:
    """struct(value, valid, corrections): the reading of field that its check digit supports.

    kind: date (digits for letters), alpha (letters for digits) or document (the first reading that is valid). A document
    number that had to be corrected has no verdict: valid is null.
    """
    text = F.upper(F.coalesce(field, F.lit("")))
    return let(text, lambda t: _supported(t, digit, kind))


def _supported(text: Column, digit: Column, kind: str) -> Column:
    asis = F.struct(text.alias("value"), F.lit(True).alias("valid"), F.lit(0).alias("corrections")).cast(CORRECTION)
    if kind in ("date", "alpha"):
        fixed = correct_digits(text) if kind == "date" else correct_letters(text)
        other = let(fixed, lambda f: F.struct(f["value"].alias("value"), validate(f["value"], digit).alias("valid"), F.size(f["corrections"]).alias("corrections")).cast(CORRECTION))
    else:
        found = first_valid_variant(text, digit)
        none = F.struct(text.alias("value"), F.lit(False).alias("valid"), F.lit(0).alias("corrections")).cast(CORRECTION)
        other = let(found, lambda f: F.when(f.isNotNull(), F.struct(f["value"].alias("value"), F.lit(None).cast("boolean").alias("valid"), f["corrections"].alias("corrections")).cast(CORRECTION)).otherwise(none))
    return F.when(validate(text, digit), asis).otherwise(other)


def correction_records(field: str, original: Column, result: Column) -> Column:
    """One record (field, original, corrected) for each corrected character; all of a field are alike."""
    record = F.struct(F.lit(field).alias("field"), original.alias("original"), result["value"].alias("corrected"))
    return F.when(result["corrections"] > 0, F.array_repeat(record, result["corrections"])).otherwise(F.array_repeat(record, 0))
