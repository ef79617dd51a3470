"""The name zone of a machine-readable zone: split, and told apart from filler that OCR reads as letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Particles of names.
PARTICLES = (
    "AL", "EL", "DE", "DA", "DI", "DO", "DOS", "DAS", "DEL", "DELA", "DELOS", "VAN", "VON", "DER", "DEN", "DEM", "BIN", "IBN", "ABU", "ABD",
    "ABDUL", "ABDEL", "O", "MC", "MAC", "ST", "LA", "LE", "LES", "LOS", "LAS",
)
#: Letters that OCR reads for the filler, and pairs of them that it repeats.
FILLER = "KLISZX"
FILLER_PAIRS = "(?:KL|LK|KI|IK|LI|IL|KZ|ZK|LS|SL)+"

CONFIDENCE = "struct<score:int,grade:string,reasons:array<string>>"
NAME = f"struct<surname:string,givenNames:string,removed:array<string>,confidence:{CONFIDENCE},warnings:array<string>>"
_STATE = "struct<out:array<string>,removed:array<string>,warnings:array<string>,reasons:array<string>,accepted:boolean,noise:boolean>"


def grade(score: Column) -> Column:
    return F.when(score >= 85, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")


def filler_ratio(token: Column) -> Column:
    return F.when(F.length(token) > 0, F.length(F.regexp_replace(token, f"[^{FILLER}]", "")) / F.length(token)).otherwise(F.lit(0.0))


def is_alternating_filler(token: Column) -> Column:
    letters = F.size(F.array_distinct(F.filter(F.split(token, ""), lambda x: x != "")))
    return (F.length(token) >= 4) & token.rlike(rf"^[{FILLER}]+\z") & ((letters <= 2) | token.rlike(rf"^{FILLER_PAIRS}\z"))


def is_noise(token: Column, accepted: Column, surname: bool) -> Column:
    """Whether a token is filler; accepted: a real token came before it in the same part."""
    only = token.rlike(rf"^[{FILLER}]+\z")
    ratio = filler_ratio(token)
    first = only & (accepted | (F.length(token) >= 4)) if surname else only
    noise = first | is_alternating_filler(token) | (accepted & (ratio >= 0.8)) | (accepted & (F.length(token) <= 3) & ~token.rlike("[AEIOU]")) | ((F.length(token) >= 4) & (ratio >= 0.85))
    return (token == "") | (~token.isin(*PARTICLES) & noise)


def _fold(tokens: Column, state: Column, surname: bool, visible: Column) -> Column:
    """Tokens taken one after the other: once filler has begun, only particles and visible tokens are kept."""
    clean = F.filter(F.transform(tokens, lambda t: F.trim(F.regexp_replace(F.upper(t), "[^A-Z'-]", ""))), lambda t: t != "")
    start = F.struct(F.array().cast("array<string>").alias("out"), state["removed"].alias("removed"), state["warnings"].alias("warnings"), state["reasons"].alias("reasons"), F.lit(False).alias("accepted"), F.lit(False).alias("noise")).cast(_STATE)

    def step(s: Column, t: Column) -> Column:
        seen = F.array_contains(visible, t)
        kept = seen | t.isin(*PARTICLES)
        noise = ~s["noise"] & is_noise(t, s["accepted"], surname) & ~kept
        taken = F.when(s["noise"], kept).otherwise(~noise)
        one = F.array(t)
        no = F.array().cast("array<string>")
        begins = noise & (s["accepted"] if surname else F.lit(True))
        return F.struct(
            F.concat(s["out"], F.when(taken, one).otherwise(no)).alias("out"),
            F.concat(s["removed"], F.when(taken, no).otherwise(one)).alias("removed"),
            F.concat(s["warnings"], F.when(s["noise"] & kept, F.array(F.concat(F.lit('Suspicious token "'), t, F.lit('" kept because it was confirmed by visible text or particle list.')))).otherwise(no)).alias("warnings"),
            F.concat(s["reasons"], F.when(noise, F.array(F.concat(F.lit('Token "'), t, F.lit('" removed as OCR filler noise.')))).otherwise(no)).alias("reasons"),
            F.when(s["noise"], s["accepted"] | kept).otherwise(s["accepted"] | (taken & ~t.isin(*PARTICLES))).alias("accepted"),
            (s["noise"] | begins).alias("noise"),
        ).cast(_STATE)

    return F.aggregate(clean, start, step)


def visible_tokens(text: Column) -> Column:
    """Distinct tokens of a name read elsewhere on the page."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[^A-Z\s'-]", " "), r"\s+"), lambda t: t != ""))


def parse_name(zone: Column, visible_surname: Column | None = None, visible_given: Column | None = None) -> Column:
    """struct(surname, givenNames, removed, confidence, warnings) of a name zone."""
    none = F.array().cast("array<string>")
    vs, vg = (visible_tokens(v) if v is not None else none for v in (visible_surname, visible_given))
    z = F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(zone, F.lit(""))), "[^A-Z<]", ""), "<{3,}", "<<")
    return let(z, lambda z: _parts(z, lambda part: _named(part, vs, vg)))


def _parts(z: Column, body) -> Column:
    """body(struct(family, given, warnings)) of a cleaned zone."""
    none = F.array().cast("array<string>")
    # a zone without a separator: filler between letters stands for it (no particle is made of such letters alone)
    broken = f"([A-Z])([{FILLER}]{{2,4}})([A-Z])"
    lacks = ~z.contains("<<")
    mended = F.when(lacks, F.regexp_replace(z, broken, "$1<<$3")).otherwise(z)
    repairs = F.when(lacks, F.transform(F.regexp_extract_all(z, F.lit(broken), 2), lambda m: F.concat(F.lit('Possible corrupted MRZ separator "'), m, F.lit('" replaced with "<<".')))).otherwise(none)

    def cut(x: Column) -> Column:
        at = F.instr(x["mended"], "<<")
        missing = F.when(at > 0, none).otherwise(F.array(F.lit('Primary MRZ name separator "<<" was not found.')))
        family = F.when(at > 0, F.substring_index(x["mended"], "<<", 1)).otherwise(x["mended"])
        return F.struct(family.alias("family"), F.when(at > 0, F.substr(x["mended"], at + 2)).otherwise("").alias("given"), F.concat(x["repairs"], missing).alias("warnings"))

    return let(let(F.struct(mended.alias("mended"), repairs.alias("repairs")), cut), body)


def _named(part: Column, visible_surname: Column, visible_given: Column) -> Column:
    none = F.array().cast("array<string>")
    split = lambda x: F.filter(F.split(x, "<"), lambda t: t != "")
    start = F.struct(none.alias("removed"), part["warnings"].alias("warnings"), none.alias("reasons"))
    folded = let(_fold(split(part["family"]), start, True, visible_surname), lambda one: F.struct(F.array_join(one["out"], " ").alias("surname"), _fold(split(part["given"]), one, False, visible_given).alias("two")))

    def judged(x: Column) -> Column:
        two, surname, names = x["two"], x["surname"], F.array_join(x["two"]["out"], " ")
        lost = (names == "") & (part["given"] != "")
        warnings = F.concat(two["warnings"], F.when(surname == "", F.array(F.lit("Surname could not be confidently parsed."))).otherwise(none), F.when(lost, F.array(F.lit("Given names were removed or not detected."))).otherwise(none))
        gone = F.size(two["removed"])
        reasons = F.concat(two["reasons"], F.when(gone > 0, F.array(F.concat(F.lit("Removed "), gone.cast("string"), F.lit(" OCR filler/noise token(s).")))).otherwise(none))
        score = 100 - F.when(surname == "", 25).otherwise(0) - F.when(lost, 15).otherwise(0) - F.least(F.lit(35), 8 * gone) - F.least(F.lit(20), 4 * F.size(warnings))
        score = F.greatest(F.lit(0), F.least(F.lit(100), score))
        reasons = F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("MRZ name parsed successfully.")))
        return F.struct(surname.alias("surname"), names.alias("givenNames"), two["removed"].alias("removed"), F.struct(score.alias("score"), grade(score).alias("grade"), reasons.alias("reasons")).alias("confidence"), warnings.alias("warnings")).cast(NAME)

    return let(folded, judged)


def mrz_name_text(zone: Column) -> Column:
    """The plain reading of a name zone: letters for digits, blanks for fillers, words of K, L and I alone dropped."""
    from .checkdigit import ALPHA_FROM, ALPHA_TO
    from .text import EDGE, collapse

    text = F.translate(F.translate(F.upper(F.coalesce(zone, F.lit(""))), ALPHA_FROM, ALPHA_TO), "<", " ")
    return collapse(F.regexp_replace(text, f"{EDGE}[KLI]{{4,}}{EDGE}", " "))
