"""The library's functions by name, for SQL text: scalar and table functions of the session.

Each is defined in SQL, so that a plan that calls one holds nothing but built-in expressions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import SparkSession

from papyra.functions.checkdigit import ALPHABET
from papyra.functions.countries import country_names
from papyra.functions.text import WIDE_BLANKS
from papyra.operators import mrz, variants

PREFIX = "papyra_"


def _raw(pattern: str) -> str:
    """A pattern as a SQL literal that keeps backslashes."""
    return "r'" + pattern.replace("'", "\\x27") + "'"


def _plain_line(line: str) -> str:
    for pattern, by in ((WIDE_BLANKS, " "), (r"\s+", ""), (mrz.BRACKETS, "<"), ("[^A-Z0-9<]", "")):
        line = f"regexp_replace({line}, {_raw(pattern)}, '{by}')"
    return line


def _lines(text: str) -> str:
    likely = f"(contains(l, '<') OR (l RLIKE '^[A-Z][A-Z0-9<][A-Z0-9<]{{3}}' AND length(l) >= 25) OR l RLIKE {_raw(mrz._ANY_DIGIT + '{6}' + mrz._ANY_DIGIT + '[MFX<]' + mrz._ANY_DIGIT + '{6}')})"
    return f"filter(transform(split(upper(coalesce({text}, '')), {_raw(chr(92) + 'r?' + chr(92) + 'n')}), l -> {_plain_line('l')}), l -> length(l) >= {mrz.MIN_MRZ_LINE} AND {likely})"


def _digit(field: str) -> str:
    worth = f"greatest(instr('{ALPHABET}', substr({field}, i + 1, 1)) - 1, 0) * array(7, 3, 1)[i % 3]"
    return f"if(length({field}) > 0, aggregate(sequence(0, length({field}) - 1), 0, (a, i) -> a + {worth}), 0) % 10"


def definitions(spark: SparkSession, as_of: dt.date) -> dict[str, str]:
    """Name without prefix -> parameters, result and body. as_of is the clock of those that need one."""
    names = country_names(spark)
    of_code = "map_from_arrays(array(" + ", ".join(f"'{c}'" for c in names) + "), array(" + ", ".join("'" + n.replace("'", "\\'") + "'" for n in names.values()) + "))"
    letters = "regexp_replace(upper(coalesce(code, '')), '[^A-Z]', '')"
    year = "cast(substr(value, 1, 2) as int)"
    century = as_of.year // 100 * 100
    iso = f"if(kind = 'expiry', {century} + {year} + if({century} + {year} < {as_of.year - 5}, 100, 0), {year} + if({year} > {as_of.year % 100}, 1900, 2000))"
    role = f"element_at({variants._constant({f'{f}{i + 1}': variants._role(f, i + 1) for f in variants.FORMATS for i in range(3 if f == 'TD1' else 2)}, f'map<string,{variants._ROLE}>')}, concat(format, number))"
    readings = variants.let_sql(f"named_struct('raw', line, 'role', {role})", "l", variants.readings_sql("l.raw", "l.role"))
    return {
        "check_digit": f"(field STRING) RETURNS INT RETURN {variants.let_sql('upper(coalesce(field, ' + chr(39) * 2 + '))', 'f', _digit('f'))}",
        "is_valid": f"(field STRING, digit STRING) RETURNS BOOLEAN RETURN coalesce(digit <> '<' AND cast({variants.let_sql('upper(coalesce(field, ' + chr(39) * 2 + '))', 'f', _digit('f'))} as string) = digit, false)",
        "date": f"(value STRING, kind STRING) RETURNS STRING RETURN if(coalesce(value, '') RLIKE '^[0-9]{{6}}$', concat({iso}, '-', substr(value, 3, 2), '-', substr(value, 5, 2)), '')",
        "country": f"(code STRING) RETURNS STRING RETURN coalesce(try_element_at({of_code}, {letters}), {letters})",
        "zone": f"(text STRING) RETURNS {variants.CANDIDATE} RETURN {variants.let_sql(_lines('text'), 'ls', variants.best_candidate_sql('ls', as_of.year, frozenset(names)))}",
        "lines": f"(text STRING) RETURNS TABLE(line_no INT, line STRING) RETURN SELECT pos, col FROM (SELECT posexplode({_lines('text')}))",
        "readings": f"(line STRING, format STRING, number INT) RETURNS TABLE(reading_no INT, reading STRING) RETURN SELECT pos, col FROM (SELECT posexplode({readings}))",
    }


def register(spark: SparkSession, as_of: dt.date) -> list[str]:
    """Makes the functions known to the session, under PREFIX; their names. Those registered before are replaced."""
    made = definitions(spark, as_of)
    for name, definition in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {PREFIX}{name}{definition}")
    return [PREFIX + name for name in made]
