"""The engine on published specimens and rows derived by hand."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from papyra.functions import checkdigit as cd
from papyra.functions import dates as d
from papyra.functions.countries import country_name, country_names, country_table, is_known_code
from papyra.functions.names import parse_name
from papyra.operators import fields, reference, secondary, variants
from papyra.operators.automaton import Automaton
from papyra.operators.classify import RULES, UNKNOWN_TYPE, Rule, Rules, classify, normalize, rules_frame
from papyra.operators.compare import compare_field, similarity
from papyra.operators.mrz import mrz_lines, parse_mrz
from papyra.operators.primary import read_primary, read_visible
from papyra.operators.secondary import read_secondary
from papyra.operators.specialised import read_schengen, read_uae
from papyra.plans import catalogue
from papyra.plans.verify import run
from tests import zones_by_hand

THEN, NOW = dt.date(2016, 1, 1), dt.date(2026, 11, 26)
LINE1 = "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"
TD3 = LINE1 + "\nL898902C36UTO7408122F1204159ZE184226B<<<<<10"
TD3_VALID = LINE1 + "\nL898902C36UTO7408122F3104150ZE184226B<<<<<16"
TD3_MISREAD = LINE1 + "\nL8989O2C36UTO7408122F3104150ZE184226B<<<<<16"
TD2 = "I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<\nD231458907UTO7408122F1204159<<<<<<<6"
TD1 = "I<UTOD231458907<<<<<<<<<<<<<<<\n7408122F1204159UTO<<<<<<<<<<<6\nERIKSSON<<ANNA<MARIA<<<<<<<<<<"
VISA = """UNITED ARAB EMIRATES
RESIDENCE VISA
VISA NO: 20120241234567
PASSPORT NO: L898902C3
SURNAME: ERIKSSON
GIVEN NAME(S): ANNA MARIA
NATIONALITY: UTOPIA
DATE OF BIRTH: 12/08/1974
SEX: F
ISSUE DATE: 01 JAN 2025
VALID UNTIL
2027-01-01"""


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def mrz(spark, text, as_of):
    return parse_mrz(spark.createDataFrame([(text,)], "t string"), "t", as_of).first()["mrz"]


@pytest.mark.parametrize("field,digit,number,valid", [("L898902C3", "6", 6, True), ("740812", "2", 2, True), ("120415", "9", 9, True), ("310415", "0", 0, True), ("L8989O2C3", "6", 0, False), ("<<<<<<<<<", "<", 0, False), ("<<<<<<<<<", "0", 0, True), ("", None, 0, False)])
def test_check_digits(spark, field, digit, number, valid):
    f, g = F.lit(field), F.lit(digit).cast("string")
    assert value(spark, cd.check_digit(f)) == number
    assert value(spark, cd.validate(f, g)) is valid
    if field:
        assert value(spark, cd.check_digit(f, len(field))) == number


def test_number_variants_in_depth_first_order(spark):
    def search(text):
        twins = dict(zip(cd.NUMBER_FROM, cd.NUMBER_TO))
        places = [i for i, ch in enumerate(text) if ch in twins]
        out = [(text, 0)]
        for p in reversed(places):  # the last place changes first
            out = out + [(v[:p] + twins[v[p]] + v[p + 1 :], n + 1) for v, n in out]
        return out

    for text in ("A", "O", "0I", "L8989O2C3", "OIBSZGOIB", "000000000000"):
        got = [tuple(x) for x in value(spark, cd.number_variants(F.lit(text)))]
        assert got == search(text)[:30]


def test_specimens(spark):
    r = mrz(spark, TD3, THEN)
    assert (r.mrzFormat, r.documentType, r.documentSubtype, r.surname, r.givenNames) == ("TD3", "PASSPORT", "STANDARD", "ERIKSSON", "ANNA MARIA")
    assert (r.nationality, r.nationalityCode, r.dateOfBirth, r.gender, r.documentNumber, r.expiryDate) == ("Utopia", "UTO", "1974-08-12", "FEMALE", "L898902C3", "2012-04-15")
    assert (r.expiryStatus.status, r.expiryStatus.daysExpired, r.checkDigits.allValid, r.candidateScore) == ("EXPIRED", 1356, True, 200)
    assert (r.nameConfidence.score, r.confidence.score, r.confidence.grade, r.warnings, r.corrections) == (100, 85, "HIGH", ["Document is expired."], [])
    late = mrz(spark, TD3, NOW)
    assert late.mrzFormat == "NONE" and len(late.warnings) == 1 and late.checkDigits.allValid is False
    r = mrz(spark, TD2, THEN)
    assert (r.mrzFormat, r.candidateScore, r.documentNumber, r.documentType) == ("TD2", 180, "D23145890", "IDENTITY_CARD")
    r = mrz(spark, TD2[:-1] + "5", THEN)
    assert (r.mrzFormat, r.candidateScore) == ("TD3", 170)
    r = mrz(spark, TD1, THEN)
    assert (r.mrzFormat, r.candidateScore, r.documentNumber, r.nationalityCode, r.checkDigits.allValid) == ("TD1", 145, "D23145890", "UTO", True)
    r = mrz(spark, TD3_VALID, NOW)
    assert (r.expiryStatus.status, r.expiryStatus.daysUntilExpiry, r.confidence.score, r.warnings) == ("VALID", 1601, 100, [])


def test_corrected_number_has_no_verdict(spark):
    r = mrz(spark, TD3_MISREAD, NOW)
    assert (r.mrzFormat, r.candidateScore, r.documentNumber) == ("TD3", 145, "L898902C3")
    assert (r.checkDigits.documentNumber, r.checkDigits.composite, r.checkDigits.allValid) == (None, False, None)
    assert [tuple(c) for c in r.corrections] == [("documentNumber", "L8989O2C3", "L898902C3")]
    assert (r.confidence.score, r.confidence.grade) == (65, "MEDIUM") and r.warnings == ["One or more MRZ check digits failed."]
    pages = spark.createDataFrame([("c", 1, "", TD3_MISREAD)], "case_id string, page_number int, full_text string, mrz_text string")
    p = read_primary(pages, NOW).first()
    assert (p.checkDocumentNumber, p.checkComposite, p.checkAllValid) == ("", "FAIL", "")


def readings(spark, raw, fmt, line):
    role = variants._constant(variants._role(fmt, line), variants._ROLE)
    return value(spark, F.expr(variants.let_sql(f"named_struct('raw', '{raw}', 'role', {role})", "l", variants.readings_sql("l.raw", "l.role"))))


def test_variants_keep_their_order_and_number(spark):
    raw = "L8989O2C36UTO7408122F3104150ZE184226B<<<<<16"
    got = readings(spark, raw, "TD2", 2)
    assert len(got) == 32 and len(set(got)) == 32 and got[0] == raw[:36]
    assert "L8989O2C36UTO7408122F3104150ZE184268" not in got
    assert readings(spark, "", "TD3", 2) == ["<" * 44, zones_by_hand.forced("", 44, variants.SPANS["TD3"])]
    names = readings(spark, LINE1, "TD3", 1)
    assert names[0] == LINE1 and any("ER<<ON" in n for n in names[1:])
    for text in (raw, LINE1, "I<UTOD231458907<<<<<<<<<<<<<<<X", "7408122F12O4159UTO<<<<<<<<<<<<6", "AB", "", raw + "00"):
        for fmt, line in (("TD3", 1), ("TD3", 2), ("TD2", 1), ("TD2", 2), ("TD1", 1), ("TD1", 2), ("TD1", 3)):
            assert readings(spark, text, fmt, line) == list(zones_by_hand.line_variants(text, f"{fmt}_LINE{line}")), (text, fmt, line)


def test_separators_equal_the_expressions_by_hand(spark):
    rng = random.Random(5)
    zones = ["".join(rng.choice("AB<KLISZCCKKX<Z") for _ in range(rng.randrange(40))) for _ in range(1500)]
    zones += ["", "A", "<<", "AKK", "AKKB", "ACCB", "ACCCB", "ACCCCB", "A<CB", "AKCB<", "ACCK<<", "AKKBKKC", "KKKK", "C" * 9, "AB" + "<" * 9, "A1KKB"]
    rows = spark.createDataFrame([(z,) for z in zones], "z string").select("z", *[F.expr(variants.separated_sql("z", a)).alias(m) for a, m in (("false", "balanced"), ("true", "aggressive"))], F.expr(variants.conservative_sql("z")).alias("conservative"))
    for r in rows.collect():
        assert (r.balanced, r.aggressive, r.conservative) == (zones_by_hand.separated(r.z, "balanced"), zones_by_hand.separated(r.z, "aggressive"), zones_by_hand.conservative(r.z)), r.z


def digit(field):
    return str(sum((7, 3, 1)[i % 3] * "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".find(ch) * (ch != "<") for i, ch in enumerate(field)) % 10)


def random_zone(rng):
    """Lines of a zone in one of the formats, with up to two characters changed, added or lost in each."""
    number, birth, expiry = "".join(rng.choice("ABL0O1I89S") for _ in range(9)), rng.choice(["740812", "990101", "010203", "741331"]), rng.choice(["310415", "280101", "190101"])
    nation = rng.choice(["UTO", "GBR", "D<<", "QQQ"])
    issuer, sex = rng.choice([nation, nation, "USA"]), rng.choice("MFX<Z")
    name = rng.choice(["ERIKSSON<<ANNA<MARIA", "SMITH<JOHN", "KLKL<<ANNA", "DOKKANNA", "DATE<<X", "A<<B", "SCCHMIDT<<C", "SMITHCCJO"])
    fmt = rng.choice(["TD3", "TD2", "TD1"])
    if fmt == "TD1":
        one = rng.choice(["I<", "ID", "Q<"]) + issuer + number + digit(number) + "Z12".ljust(15, "<")
        two = birth + digit(birth) + sex + expiry + digit(expiry) + nation + "<" * 11
        lines = [one, two + digit(one[5:30] + two[:7] + two[8:15] + two[18:29]), name.ljust(30, "<")]
    else:
        width = 44 if fmt == "TD3" else 36
        two = (number + digit(number) + nation + birth + digit(birth) + sex + expiry + digit(expiry) + "ZE184").ljust(width - 1, "<")
        lines = [(rng.choice(["P<", "V<", "XX"]) + issuer + name).ljust(width, "<"), two + digit(two[:10] + two[13:20] + two[21 : width - 1])]
    out = []
    for line in lines:
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i, k = rng.randrange(len(line)), rng.randrange(3)
            line = line[:i] + (rng.choice("O0I1BSZK<9A") if k < 2 else "") + line[i + (k != 0) :]
        out.append(line)
    return out


def test_best_candidates_equal_all_tried_by_hand(spark):
    rng = random.Random(7)
    zones = [[], [""], ["P<UTOABC<<" * 4]]
    for _ in range(400):
        lines = random_zone(rng)
        zones.append(["P<UTOABC<<" * 4, *lines] if rng.random() < 0.2 else lines[:1] if rng.random() < 0.05 else lines)
    known = frozenset(country_names(spark))
    rows = spark.createDataFrame(list(enumerate(zones)), "i int, z array<string>").repartition(4)
    found = {r.i: r.c for r in rows.select("i", variants.best_candidate_column("z", NOW, known).alias("c")).collect()}
    formats = Counter()
    for i, zone in enumerate(zones):
        want, got = zones_by_hand.best_candidate(zone, NOW.year, known), found[i]
        formats[want and want[0]] += 1
        assert (want is None) == (got is None), zone
        if want:
            assert (got.format, got.raw, got.lines, got.score, got.valid_checks) == (want[0], list(want[1]), want[2], want[3], want[5]), zone
    assert min(formats[x] for x in ("TD3", "TD2", "TD1")) > 10


def test_lines_and_page_noise(spark):
    assert value(spark, mrz_lines(F.lit("hello\np<uto eriksson«‹anna<maria<<<<<<<<<<<<<<<<<<<\r\nNO"))) == ["P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<"]
    assert value(spark, mrz_lines(F.lit(None).cast("string"))) == []
    noisy = TD3.replace("ERIKSSON", "PLACEMAN")
    assert mrz(spark, noisy, THEN).mrzFormat == "NONE"


def test_names(spark):
    a = value(spark, parse_name(F.lit("ERIKSSON<<ANNA<MARIA<<<<")))
    assert (a.surname, a.givenNames, a.removed, a.confidence.score, a.confidence.grade, a.warnings) == ("ERIKSSON", "ANNA MARIA", [], 100, "HIGH", [])
    b = value(spark, parse_name(F.lit("SMITH<<LIZ<ANN<<<")))
    assert (b.surname, b.givenNames, b.removed, b.confidence.score, b.confidence.grade) == ("SMITH", "", ["LIZ", "ANN"], 65, "MEDIUM")
    assert b.warnings == ["Given names were removed or not detected."]
    c = value(spark, parse_name(F.lit("SMITH<JOHN")))
    assert c.warnings[0].startswith("Primary MRZ name separator")


def test_dates(spark):
    for text, second, first in (("2025/1/9", "2025-01-09", "2025-01-09"), ("9.1.25", "2025-01-09", ""), ("9-1-41", "1941-01-09", "1941-01-09"), ("9-1-40", "2040-01-09", "2040-01-09"), ("01 MAI 2025", "2025-05-01", "2025-05-01"), ("01 FOO 2025", "", "")):
        assert value(spark, d.secondary_date(F.lit(text))) == second
        assert value(spark, d.primary_date(F.lit(text))) == first
    for days, status, left, gone in ((-1, "EXPIRED", None, 1), (0, "EXPIRING_SOON", 0, None), (30, "EXPIRING_SOON", 30, None), (31, "VALID", 31, None)):
        got = value(spark, d.expiry_status(F.lit((NOW + dt.timedelta(days)).isoformat()), NOW))
        assert (got.status, got.daysUntilExpiry, got.daysExpired) == (status, left, gone)
    assert tuple(value(spark, d.expiry_status(F.lit(""), NOW))) == (False, "UNKNOWN", None, None)
    assert value(spark, d.is_date(F.lit("2023-02-30"))) is False and value(spark, d.is_date(F.lit("2023-2-3"))) is False


def test_countries(spark):
    names = country_names(spark)
    assert len(names) == 258 and names["CIV"] == "Côte d'Ivoire" and names["ALA"] == "Åland Islands" and names["BLM"] == "Saint Barthélemy"
    assert country_table(spark).count() == 258
    assert value(spark, country_name(F.lit("d<<"))) == "Germany" and value(spark, country_name(F.lit("QQQ"))) == "QQQ"
    assert value(spark, is_known_code(F.lit("UTO"))) is True and value(spark, is_known_code(F.lit(None).cast("string"))) is False


def test_secondary_record(spark):
    pages = spark.createDataFrame([("c", 1, VISA), ("c", 2, VISA), ("d", 1, None)], "case_id string, page_number int, full_text string")
    rows = {r.case_id: r for r in read_secondary(pages).collect()}
    r = rows["c"]
    assert (r.documentType, r.classificationConfidence, r.documentCategory, r.visaNumber, r.holderNumber, r.documentNumber) == ("Visa", "60%", "Immigration Authorization", "20120241234567", "L898902C3", "")
    assert (r.surname, r.givenNames, r.fullName, r.nationality, r.dateOfBirth, r.gender) == ("ERIKSSON", "ANNA MARIA", "ANNA MARIA ERIKSSON", "UTOPIA", "1974-08-12", "F")
    assert (r.issueDate, r.expiryDate, r.validFrom, r.validUntil, r.issuingCountry, r.processingScore, r.selectedPage, r.warnings) == ("2025-01-01", "2027-01-01", "", "2027-01-01", "ARE", 100, 1, None)
    assert rows["d"].processingScore == 0 and rows["d"].warnings.startswith("Low confidence")


def test_classification(spark):
    got = value(spark, classify(normalize(F.lit(VISA))))
    assert [(a.type, a.confidence) for a in got.alternatives] == [("UAE Residence Visa", 58), ("Passport", 50), ("Emirates ID", 18)]
    none = value(spark, classify(normalize(F.lit(""))))
    assert (none.type, none.category, none.route, none.confidence) == (UNKNOWN_TYPE, "Other", "refugee", 0) and [a.confidence for a in none.alternatives] == [0, 0, 0]
    zone = value(spark, classify(normalize(F.lit("")), mrz_format=F.lit("TD3"), mrz_type=F.lit("")))
    assert (zone.type, zone.confidence, zone.route) == ("Passport", 95, "mrz")


SCHEMA = "case_id string, role string, page_number int, full_text string, mrz_text string"
CHANGES = {
    "same": (VISA, 97, "VERIFIED", "LOW", "All critical identity fields are valid and matched."),
    "number": (VISA.replace("PASSPORT NO: L898902C3", "PASSPORT NO: X1234567"), 82, "REJECTED", "HIGH", "Critical issue detected: Passport Number."),
    "birth": (VISA.replace("12/08/1974", "01/01/1980"), 72, "MANUAL REVIEW REQUIRED", "MEDIUM", "Document data could not be verified confidently and requires manual review."),
    "expiry": (VISA.replace("2027-01-01", "2020-01-01"), 92, "REJECTED", "HIGH", "Critical issue detected: Secondary Document Expiry."),
    "person": (VISA.replace("ERIKSSON", "SMITH").replace("ANNA MARIA", "JOHN").replace("12/08/1974", "01/01/1980"), 47, "REJECTED", "HIGH", "Critical issue detected: identity mismatch."),
}


@pytest.fixture(scope="module")
def verdicts(spark):
    """Each case as two pages of each role, in one run over one partition and, in another order, over several."""
    rows = [row for case, (visa, *_) in CHANGES.items() for row in ((case, "primary", 1, "", TD3_VALID), (case, "primary", 2, "", TD3_VALID), (case, "secondary", 1, visa, None), (case, "secondary", 2, "", None))]
    rows += [("alone", "primary", 1, "", TD3_VALID)]
    one, many = spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    first, second = (sorted(run(x, NOW)["verdicts"].collect()) for x in (one, many))
    assert list(map(str, first)) == list(map(str, second))
    return {v.case_id: v for v in first}


def test_verdicts(verdicts):
    assert set(verdicts) == set(CHANGES)
    for case, (_, *expected) in CHANGES.items():
        v = verdicts[case]
        assert [v.score, v.decision, v.riskLevel, v.reason] == expected, case
    v = verdicts["same"]
    assert [(f.label, f.status, f.score, f.weight) for f in v.fields] == [
        ("Full Name", "Exact Match", 100, 25), ("Date of Birth", "Exact Match", 100, 25), ("Gender", "Exact Match", 100, 10), ("Passport Number", "Exact Match", 100, 15),
        ("Nationality", "Information Only", 80, 10), ("Issuing Country", "Information Only", 85, 5), ("Primary Document Expiry", "Valid", 100, 5), ("Secondary Document Expiry", "Valid", 100, 5),
    ]
    assert [a.split(":")[0] for a in v.alerts] == ["ℹ Nationality", "ℹ Issuing Country", "ℹ Secondary document detected as"]


@pytest.mark.parametrize("other,status,score", [("ERIKSSON ANNA MARIA", "Partial Match", 92), ("MS ANNA MARIA ERIKSSON", "Partial Match", 92), ("ANNA MARIE ERIKSSON", "Partial Match", 95), ("JOHN SMITH", "Mismatch", 0)])
def test_name_comparison(spark, other, status, score):
    f = value(spark, compare_field("Full Name", F.lit("ANNA MARIA ERIKSSON"), F.lit(other), "name", 25))
    assert (f.status, f.score) == (status, score)


def test_similarity_is_symmetric(spark):
    for a, b in (("ABC", "ABD"), ("", ""), ("A", ""), ("KITTEN", "SITTING")):
        assert value(spark, similarity(F.lit(a), F.lit(b))) == value(spark, similarity(F.lit(b), F.lit(a)))


def test_labels(spark):
    lines = F.array(*[F.lit(x) for x in ("NAME (PRINT)", "SURNAME", "DATE OF BIRTH", "SMITH")])
    assert value(spark, fields.labelled_value(lines, "SURNAME")) == ""
    lines = F.array(*[F.lit(x) for x in ("SURNAME", "", "SMITH")])
    assert value(spark, fields.labelled_value(lines, "SURNAME")) == "SMITH"
    assert value(spark, fields.document_number(F.array().cast("array<string>"), F.lit("X AB123456 Y"))) == "AB123456"
    assert value(spark, fields.issuing_country(F.lit("ROMANIA"))) == "OMN"


def test_visible_text(spark):
    # NAME is found inside SURNAME, whose line comes first
    text = "SURNAME: SMITH\nGIVEN NAMES\nJOHN\nPASSPORT NO AB1234567\nNATIONALITY: UTO\nDATE OF BIRTH: 01/02/1980\nSEX: M"
    r = read_visible(spark.createDataFrame([(text,)], "full_text string"), NOW).first()["record"]
    assert (r.surname, r.givenNames, r.holderNumber, r.nationality, r.dateOfBirth, r.gender, r.confidenceScore) == ("SMITH", "SMITH", "AB1234567", "UTO", "1980-02-01", "M", "35% - LOW")


def test_specialised_readers(spark):
    text = "TYPE OF VISA C\nVALID FOR SCHENGEN STATES\nFROM 01-02-25 UNTIL 01-03-27\nNUMBER OF ENTRIES MULT\nDURATION OF STAY 90\nSURNAME: SMITH"
    r = read_schengen(spark.createDataFrame([(text,)], "t string"), "t", NOW).first()["record"]
    assert (r.visaType, r.validFrom, r.validUntil, r.entries, r.durationOfStay, r.issuingCountryCode) == ("C", "2025-02-01", "2027-03-01", "MULT", "90", "SCHENGEN")
    assert r.validFor == "SCHENGEN STATES FROM" and r.confidence.score == 30
    u = read_uae(spark.createDataFrame([(VISA + "\nUID NO: 123456789",)], "t string"), "t", NOW).first()["record"]
    assert (u.documentSubtype, u.uid, u.holderNumber, u.expiryDate, u.dateOfBirth, u.gender) == ("UAE_RESIDENCE_VISA", "123456789", "L898902C3", "2027-01-01", "1974-08-12", "FEMALE")



def test_names_of_codes_by_date(spark):
    table = spark.createDataFrame(
        [("UTO", "Old", None, dt.date(2000, 1, 1)), ("uto", "New", dt.date(2000, 1, 1), None), ("UTO", "Newest", dt.date(2010, 1, 1), dt.date(2011, 1, 1)), ("GAP", "First", dt.date(1990, 1, 1), dt.date(1991, 1, 1)), (None, "none", None, None), ("<", "blank", None, None)],
        reference.SCHEMA,
    )
    rows = [(1, "UTO", dt.date(1999, 12, 31)), (2, "u t o<", dt.date(2000, 1, 1)), (3, "UTO", dt.date(2010, 6, 1)), (4, "UTO", dt.date(2011, 1, 1)), (5, "GAP", dt.date(1995, 1, 1)), (6, "QQQ", dt.date(1995, 1, 1)), (7, None, dt.date(1995, 1, 1)), (8, "UTO", None), (1, "UTO", dt.date(1999, 12, 31))]
    records = spark.createDataFrame(rows, "id int, code string, day date").withColumns({"name": F.lit("mine"), "versions": F.lit(0)})
    named = reference.with_name(records, "code", table, F.col("day"), "found")
    assert named.columns == [*records.columns, "found"]
    assert Counter((r.id, r.found) for r in named.collect()) == Counter([(1, "Old"), (1, "Old"), (2, "New"), (3, "Newest"), (4, "New"), (5, "GAP"), (6, "QQQ"), (7, ""), (8, "UTO")])
    assert {r.found for r in reference.with_name(records.where("id = 1"), "code", table, dt.date(2020, 1, 1), "found").collect()} == {"New"}
    assert sorted(r.id for r in reference.with_known_code(records, "code", table).collect()) == [1, 1, 2, 3, 4, 5, 8]
    assert sorted(r.id for r in reference.with_unknown_code(records, "code", table).collect()) == [6, 7]
    assert reference.with_name(records, "code", reference.default_table(spark).limit(0), NOW, "found").where("id = 6").first().found == "QQQ"
    assert reference.with_name(records.limit(0), "code", table, NOW, "found").count() == 0


def test_functions_in_sql_text(spark):
    assert "papyra_lines" in catalogue.register(spark, NOW)
    spark.createDataFrame([(1, "x\n" + TD3_VALID), (2, None), (3, "")], "k int, text string").createOrReplaceTempView("pages_of_test")
    lines = spark.sql("SELECT k, l.line_no, l.line FROM pages_of_test, LATERAL papyra_lines(text) l ORDER BY k, line_no").collect()
    assert [tuple(r) for r in lines] == [(1, i, line) for i, line in enumerate(TD3_VALID.split("\n"))]
    zones = {r.k: r.z for r in spark.sql("SELECT k, papyra_zone(text) AS z FROM pages_of_test").collect()}
    assert (zones[1].format, zones[1].score, zones[1].composite, zones[2], zones[3]) == ("TD3", 200, True, None, None)
    got = spark.sql("SELECT papyra_check_digit('l898902c3') AS a, papyra_check_digit('') AS b, papyra_is_valid('L898902C3', '<') AS c, papyra_date('740812', 'birth') AS d, papyra_date('2O0101', 'birth') AS e, papyra_country('d<<') AS f, papyra_country(null) AS g").first()
    assert tuple(got) == (6, 0, False, "1974-08-12", "", "Germany", "")
    for fmt, line in (("TD3", 1), ("TD2", 2), ("TD1", 3)):
        read = spark.sql(f"SELECT r.reading_no, r.reading FROM (SELECT '{LINE1}7' AS x), LATERAL papyra_readings(x, '{fmt}', {line}) r ORDER BY reading_no").collect()
        assert [r.reading for r in read] == list(zones_by_hand.line_variants(LINE1 + "7", f"{fmt}_LINE{line}"))


def test_rules_and_labels_from_tables(spark):
    assert Rules.of(rules_frame(spark)).rules == RULES
    text = normalize(F.lit(VISA + "\nSCHENGEN SPONSOR"))
    few, many = (value(spark, classify(text, r)) for r in (RULES, Rules(RULES + tuple(Rule(f"R{i}", "c", "r", (f"KEYWORD {i}", f"WORD {i}")) for i in range(5000)))))
    assert few == many and few.type == "UAE Residence Visa"
    none = value(spark, classify(F.lit(""), Rules(RULES + (Rule("x", "y", "z", tuple(f"K{i}" for i in range(300))),))))
    assert (none.type, none.route, [a.confidence for a in none.alternatives]) == (UNKNOWN_TYPE, "refugee", [0, 0, 0])
    table = fields.labels_frame(spark, secondary.FIELDS)
    assert fields.fields_of(table) == secondary.FIELDS
    swapped = fields.fields_of(spark.createDataFrame([("surname", 0, "APELLIDO", 0, False), ("dateOfBirth", 1, "NACIDO", 0, True)], table.schema))
    page = spark.createDataFrame([("c", 1, "APELLIDO: GARCIA\nNACIDO EL\n01/02/1980\nSURNAME: SMITH")], "case_id string, page_number int, full_text string")
    r = read_secondary(page, labels=swapped).first()
    assert (r.surname, r.dateOfBirth, r.givenNames, r.expiryDate) == ("GARCIA", "1980-02-01", "", "")


def test_automaton_finds_all_keywords():
    rng = random.Random(1)
    for _ in range(150):
        words = ["".join(rng.choice("abé") for _ in range(rng.randrange(0 if rng.random() < 0.1 else 1, 6))) for _ in range(rng.randrange(1, 12))]
        texts = ["".join(rng.choice("abéc") for _ in range(rng.randrange(40))) for _ in range(6)] + [None, "", "ab" * 1500]
        got = list(zip(*(x.tolist() for x in Automaton(words).found(texts))))
        assert got == sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if w in (t or ""))
