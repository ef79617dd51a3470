"""Readings of the lines of a machine-readable zone, and the best candidate among them.

All of it is one expression of built-in functions, written as SQL: what formats, lines and checks differ in is data, so that each
step stands in the plan once. Lines are judged one by one before they are combined: a candidate's score is the sum of what its
lines earn and a bonus. The search is a fold over start lines and formats whose state is the best candidate so far; a format that
can't beat it is not looked at, nor is a reading worked out for it.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyra.config import MAX_LINE_VARIANTS

#: Words printed around a zone; a candidate whose lines hold one is no zone.
NOISE_WORDS = (
    "SIGNATURE", "SIGHATURE", "DATE", "ISSUE", "EXPIRY", "EXPIRATION", "PLACE", "FATHER", "MOTHER", "PROFESSION", "OCCUPATION", "REPUBLIC",
    "PASSEPORT", "PASSPORT", "SURNAME", "GIVEN", "PRENOM", "PRNOM", "NOM", "BIRTH", "CENTER", "CENTRE", "AUTHORITY",
)
#: Document codes -> (type, subtype); else the first letter decides.
DOCUMENT_TYPES = {
    "P": ("PASSPORT", "STANDARD"), "PN": ("PASSPORT", "STANDARD"), "PD": ("PASSPORT", "DIPLOMATIC"), "PS": ("PASSPORT", "SERVICE"), "PO": ("PASSPORT", "OFFICIAL"),
    "PT": ("TRAVEL_DOCUMENT", "TRAVEL_DOCUMENT"), "PR": ("TRAVEL_DOCUMENT", "REFUGEE"), "IP": ("IDENTITY_CARD", "PASSPORT_CARD"), "I": ("IDENTITY_CARD", "STANDARD"),
    "ID": ("IDENTITY_CARD", "STANDARD"), "C": ("IDENTITY_CARD", "STANDARD"), "A": ("IDENTITY_CARD", "STANDARD"), "V": ("VISA", "STANDARD"),
}
#: Fixed values, by format: width; points for document number, birth, expiry, composite, separator, countries alike.
#: Noise, wrong dates and fewer than two valid checks cost points too, but rule a candidate out in any case.
FORMATS = {
    "TD3": {"width": 44, "checks": (25, 25, 25, 30), "separator": 20, "alike": 30},
    "TD2": {"width": 36, "checks": (20, 20, 20, 25), "separator": 20, "alike": 30},
    "TD1": {"width": 30, "checks": (20, 20, 20, 25), "separator": 15, "alike": 0},
}
#: Points for shape, gender, and known type, issuing country and nationality.
SHAPE, GENDER, KNOWN = 10, 5, 10
#: Least score by format, and the score from which an unknown type or country is let pass (never for TD1).
LEAST = {"TD3": 70, "TD2": 70, "TD1": 80}
LENIENT_FROM = 95

#: What OCR reads for digits, and the digits; where digits stand, by kind of line.
DIGIT_FROM, DIGIT_TO = "OQDILBSZG<", "0001185260"
SPANS = {
    "TD3": ((9, 10), (13, 20), (21, 28), (43, 44)),
    "TD2": ((9, 10), (13, 20), (21, 28), (35, 36)),
    "TD1_1": ((14, 15),),
    "TD1_2": ((0, 7), (8, 15), (29, 30)),
}

CANDIDATE = "struct<format:string,raw:array<string>,lines:array<string>,score:int,gen_ord:bigint,valid_checks:int,composite:boolean>"
_SPAN = "array<struct<a:int,b:int>>"
_SUM = "array<struct<p:int,w:int>>"
_CHECK = f"array<struct<sum:{_SUM},digit:int,points:int>>"
_ROLE = f"struct<width:int,name:boolean,spans:{_SPAN},places:array<int>,realign:boolean,every:boolean>"
_FORMAT = (
    f"struct<name:string,count:int,most:int,second:int,least:int,strict:boolean,composite:int,alike:int,separator:int,roles:array<{_ROLE}>,"
    f"checks:array<{_CHECK}>,parts:array<{_SUM}>,digit:int,nation:int,sex:int,birth:int,expiry:int>"
)


def _spans(kind: str) -> list[dict]:
    return [{"a": a, "b": b} for a, b in SPANS[kind]]


def _role(fmt: str, line: int) -> dict:
    """What the readings of a line follow from."""
    width = FORMATS[fmt]["width"]
    if (fmt, line) in (("TD3", 1), ("TD2", 1), ("TD1", 3)):
        return {"width": width, "name": True, "spans": [], "places": [], "realign": False, "every": False}
    if fmt == "TD1":
        return {"width": width, "name": False, "spans": _spans(f"TD1_{line}"), "places": [*range(5, 15)] if line == 1 else [*range(7), *range(8, 15)], "realign": False, "every": False}
    return {"width": width, "name": False, "spans": _spans(fmt), "places": [*range(10, 45 if fmt == "TD3" else 36)], "realign": True, "every": True}


def _sum(*spans: tuple[int, int], after: int = 0) -> list[dict]:
    """Places and weights of a check digit's field; after: so many places of it stand in the line before."""
    places = [p for a, b in spans for p in range(a, b)]
    return [{"p": p, "w": (7, 3, 1)[(after + i) % 3]} for i, p in enumerate(places)]


def _format(fmt: str) -> dict:
    rule, end = FORMATS[fmt], FORMATS[fmt]["width"] - 1
    number, birth, expiry, composite = rule["checks"]
    checked = lambda a, b, points: {"sum": _sum((a, b)), "digit": b, "points": points}
    if fmt == "TD1":
        at = {"checks": [[checked(5, 14, number)], [checked(0, 6, birth), checked(8, 14, expiry)]], "parts": [_sum((5, 30)), _sum((0, 7), (8, 15), (18, 29), after=25)], "nation": 15, "sex": 7, "birth": 0, "expiry": 8}
    else:
        at = {"checks": [[], [checked(0, 9, number), checked(13, 19, birth), checked(21, 27, expiry)]], "parts": [[], _sum((0, 10), (13, 20), (21, end))], "nation": 10, "sex": 20, "birth": 13, "expiry": 21}
    lines = 3 if fmt == "TD1" else 2
    most = SHAPE + sum(rule["checks"]) + rule["separator"] + rule["alike"] + GENDER + 3 * KNOWN
    second = sum(c["points"] for c in at["checks"][1]) + KNOWN + GENDER
    return at | {"name": fmt, "count": lines, "most": most, "second": second, "least": LEAST[fmt], "strict": fmt == "TD1", "composite": composite, "alike": rule["alike"], "separator": rule["separator"], "roles": [_role(fmt, i + 1) for i in range(lines)], "digit": end}


# pieces of SQL; each takes and gives the text of an expression


def let_sql(value: str, name: str, body: str) -> str:
    """body, in which name stands for value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', '{by}')"
    return text


def _constant(value, kind: str) -> str:
    return f"from_json('{json.dumps(value)}', '{kind}')"


#: How a zone's first line begins. No reading of it changes its first five characters.
OPENS = "^[A-Z][A-Z<][A-Z]{3}"
#: Letters that OCR reads for fillers between names, in a class.
_RUN = "[<KLISZC]"
_END = r"\\z"


def between_sql(zone: str, aggressive: str) -> str:
    """A zone whose misread separators between two letters are repaired.

    A machine over stretches of possible filler and of other letters. Its state is what is settled, the letter that a separator
    may follow, and the filler since then. When a letter ends two or more of filler, the stretch is either repaired or stands as
    it is; both ends of it are passed over either way. Filler at the end of the zone ends with its last letter.
    """
    state = "cast(named_struct('done', {}, 'first', {}, 'run', {}) as struct<done:string,first:string,run:string>)"
    real = lambda run: f"(contains({run}, '<') OR NOT contains({run}, 'C') OR {run} RLIKE '^C{{3,}}{_END}' OR ({aggressive} AND length({run}) >= 4))"
    mended = lambda run: f"if({real(run)}, '<<', {run})"
    opens = let_sql("length(regexp_extract(t, '^<*', 0))", "n", state.format("concat(s.done, left(t, n))", "substr(t, n + 1, 1)", "substr(t, n + 2)"))
    step = f"""CASE WHEN t RLIKE '^{_RUN}' THEN if(s.first <> '', {state.format("s.done", "s.first", "t")}, {opens})
      WHEN length(s.run) >= 2 THEN {state.format(f"concat(s.done, s.first, {mended('s.run')}, left(t, greatest(length(t) - 1, 1)))", "if(length(t) > 1, right(t, 1), '')", "''")}
      ELSE {state.format("concat(s.done, s.first, s.run, left(t, length(t) - 1))", "right(t, 1)", "''")} END"""
    last = f"'^(.{{2,}})([KLISZC])(<*){_END}'"
    cut = let_sql(f"regexp_extract(s.run, {last}, 1)", "m", f"concat({mended('m')}, substr(s.run, length(m) + 1))")
    end = f"concat(s.done, s.first, if(s.run RLIKE {last}, {cut}, s.run))"
    return f"aggregate(regexp_extract_all({zone}, '{_RUN}+|[^<KLISZC]+', 0), {state.format(chr(39) * 2, chr(39) * 2, chr(39) * 2)}, (s, t) -> {step}, s -> {end})"


def separated_sql(zone: str, aggressive: str) -> str:
    """A name zone whose separators were misread as filler letters."""
    opened = _replaced(zone, ("[^A-Z<]", ""), ("<{3,}", "<<"), ("[KLISZ]{3,}", "<<"), ("C{3,}", "<<"), ("<([KLISZC])<C?([KLISZC]){2,}([A-Z]{2,})", "<<$2$3"), ("<C?([KLISZC]){2,}([A-Z]{2,})", "<<$1$2"))
    return _replaced(between_sql(opened, aggressive), (f"{_RUN}{{7,}}{_END}", "<" * 30), ("<{3,}", "<<"))


def conservative_sql(zone: str) -> str:
    return _replaced(zone, ("<{3,}", "<<"), ("[KLISZ]{3,}", "<<"), ("C{4,}", "<<"), (f"{_RUN}{{8,}}{_END}", "<" * 30))


def _fit(text: str, width: str) -> str:
    return f"rpad({text}, {width}, '<')"


def _digits(text: str) -> str:
    return f"translate({text}, '{DIGIT_FROM}', '{DIGIT_TO}')"


def _forced(text: str, width: str, spans: str) -> str:
    """text at its width, with digits where spans say."""
    return f"aggregate({spans}, {_fit(text, width)}, (x, p) -> concat(left(x, p.a), {_digits('substr(x, p.a + 1, p.b - p.a)')}, substr(x, p.b + 1)))"


def _name_readings(raw: str, role: str) -> str:
    names = f"transform(array(0, 1, 2), m -> concat(left({raw}, 5), if(m = 1, {conservative_sql(f'substr({raw}, 6)')}, {separated_sql(f'substr({raw}, 6)', 'm = 2')})))"
    return f"transform(if(length({raw}) >= 5, concat(array({raw}), {names}), array({raw})), x -> {_fit('x', f'{role}.width')})"


def _data_readings(raw: str, role: str) -> str:
    spans = {k: _constant(_spans(k), _SPAN) for k in ("TD3", "TD2")}
    plain = f"cast(null as {_SPAN})"
    pair = lambda text, how: f"named_struct('t', {text}, 's', {how})"
    cut = lambda i: f"concat(left({raw}, {i}), substr({raw}, {i} + 2))"
    none = f"cast(array() as array<struct<t:string,s:{_SPAN}>>)"
    moved = f"if(substr({raw}, 11, 10) RLIKE '^[A-Z]{{4}}[0-9OBISZGL]{{6}}', array({pair(cut('13'), f'{role}.spans')}), {none})"
    shifted = f"transform(filter(transform(array(13, 14, 15, 16), i -> {cut('i')}), c -> substr(c, 11, 3) RLIKE '^[A-Z]{{3}}{_END}' AND {_digits('substr(c, 14, 6)')} RLIKE '^[0-9]{{6}}{_END}'), c -> {pair('c', f'{role}.spans')})"
    shape = lambda v: f"if({v}.s IS NULL, {_fit(f'{v}.t', f'{role}.width')}, {_forced(f'{v}.t', f'{role}.width', f'{v}.s')})"
    tried = lambda pairs: f"transform({pairs}, v -> {shape('v')})"
    first = f"array_distinct({tried(f'concat(array({pair(raw, plain)}, {pair(raw, f'{role}.spans')}), if(length({raw}) > {role}.width AND {role}.realign, concat({moved}, {shifted}), {none}))')})"
    # one letter too many: place by place until there are enough; deletions as they are come after those at the role's places
    places = f"concat(transform(filter({role}.places, i -> i < length({raw})), i -> struct(i, false as every)), if({role}.every, transform(sequence(0, length({raw}) - 1), i -> struct(i, true as every)), cast(array() as array<struct<i:int,every:boolean>>)))"
    each = let_sql(cut("q.i"), "c", f"if(q.every, array({pair('c', f'{role}.spans')}), array({pair('c', plain)}, {pair('c', spans['TD3'])}, {pair('c', spans['TD2'])}))")
    deleted = f"aggregate({places}, {first}, (got, q) -> if(size(got) >= {MAX_LINE_VARIANTS}, got, array_union(got, {tried(each)})))"
    return f"slice(if(length({raw}) > {role}.width, {deleted}, {first}), 1, {MAX_LINE_VARIANTS})"


def readings_sql(raw: str, role: str) -> str:
    """Distinct readings of a line in the order they are tried, MAX_LINE_VARIANTS at most. raw, role: names."""
    return f"if({role}.name, slice(array_distinct({_name_readings(raw, role)}), 1, {MAX_LINE_VARIANTS}), {_data_readings(raw, role)})"


def _at(text: str, begin: str, n: int) -> str:
    return f"substr({text}, {begin} + 1, {n})"


def _known(code: str, known: str) -> str:
    return f"contains('{known}', concat(',', {code}, ','))"


def _summed(of: str) -> str:
    return f"aggregate({of}, 0, (a, q) -> a + greatest(instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(x, q.p + 1, 1)) - 1, 0) * q.w)"


def _judged(line: int, known: str) -> str:
    """What a reading x of a line earns by itself: struct of points, valid checks, part of the composite sum, country, and
    whether what must be known is known. f, i: the format, and the reading's place."""
    valid = f"filter(f.checks[{line}], c -> substr(x, c.digit + 1, 1) = cast({_summed('c.sum')} % 10 as string))"
    if line == 0:
        types = "," + ",".join(DOCUMENT_TYPES) + ","
        code = "replace(left(x, 2), '<', '')"
        kind = f"({_known(code, types)} OR {_known(f'left({code}, 1)', types)})"
        country = "replace(substr(x, 3, 3), '<', '')"
        issuer = _known(country, known)
        points = f"if({kind}, {KNOWN}, 0) + if({issuer}, {KNOWN}, 0) + if(f.count = 2 AND contains(x, '<<'), f.separator, 0)"
        sure = f"{kind} AND {issuer}"
    else:
        country = f"replace({_at('x', 'f.nation', 3)}, '<', '')"
        sure = _known(f"regexp_replace({country}, '[^A-Z]', '')", known)
        points = f"if({sure}, {KNOWN}, 0) + if({_at('x', 'f.sex', 1)} IN ('M', 'F', 'X', '<'), {GENDER}, 0)"
    of_checks = f"aggregate(v, {points}, (a, c) -> a + c.points)"
    return let_sql(valid, "v", f"named_struct('x', x, 'i', i, 'points', {of_checks}, 'valid', size(v), 'part', {_summed(f'f.parts[{line}]')}, 'country', {country}, 'sure', {sure})")


def _dated(year: int) -> str:
    """Whether a reading x holds a birth and an expiry that can be. Both are six digits."""
    born = "cast(substr(x, f.birth + 1, 2) as int)"
    ends = f"({year // 100 * 100} + cast(substr(x, f.expiry + 1, 2) as int))"
    both = f"array(named_struct('y', if({born} > {year % 100}, 1900, 2000) + {born}, 'd', {_at('x', 'f.birth', 6)}, 'low', 1900, 'high', {year}), named_struct('y', if({ends} < {year - 5}, 100, 0) + {ends}, 'd', {_at('x', 'f.expiry', 6)}, 'low', {year - 30}, 'high', {year + 30}))"
    # by arithmetic: parsers of dates tell by an exception that a day doesn't exist, and most readings have none
    month, day = "cast(substr(d.d, 3, 2) as int)", "cast(substr(d.d, 5, 2) as int)"
    last = f"CASE WHEN {month} IN (4, 6, 9, 11) THEN 30 WHEN {month} <> 2 THEN 31 WHEN d.y % 4 = 0 AND (d.y % 100 <> 0 OR d.y % 400 = 0) THEN 29 ELSE 28 END"
    return f"forall({both}, d -> d.y BETWEEN d.low AND d.high AND {month} BETWEEN 1 AND 12 AND {day} BETWEEN 1 AND {last})"


def best_candidate_sql(lines: str, year: int, known: frozenset[str]) -> str:
    """The acceptable candidate (CANDIDATE) with the highest score among those of `lines`; of equal scores the first generated.
    Null where there is none."""
    codes = "," + ",".join(sorted(known)) + ","
    digits = lambda at: f"{_at('x', at, 6)} RLIKE '^[0-9]{{6}}{_END}'"
    read = lambda n, how: let_sql(f"named_struct('raw', own[{n}], 'role', f.roles[{n}])", "l", how("l.raw", "l.role"))
    firsts = f"transform(filter(transform({read(0, readings_sql)}, (x, i) -> struct(x, i)), y -> y.x RLIKE '{OPENS}'), y -> {_pairwise('y', _judged(0, codes))})"
    seconds = f"transform(filter(transform({read(1, _data_readings)}, (x, i) -> struct(x, i)), y -> {_pairwise('y', f'{digits('f.birth')} AND {digits('f.expiry')} AND {_dated(year)}')}), y -> {_pairwise('y', _judged(1, codes))})"
    # the reading of a third line matters only by its separator: the first that has one, else the first
    named = lambda raw, role: f"slice(array_distinct({_name_readings(raw, role)}), 1, {MAX_LINE_VARIANTS})"
    third = f"if(f.count = 3, {let_sql(read(2, named), 'r', "coalesce(filter(transform(r, (x, i) -> struct(x, i)), y -> contains(y.x, '<<'))[0], named_struct('x', r[0], 'i', 0))")}, cast(null as struct<x:string,i:int>))"
    whole = "substr(two.x, f.digit + 1, 1) = cast((one.part + two.part) % 10 as string)"
    score = f"{SHAPE} + one.points + two.points + if(whole, f.composite, 0) + if(one.country <> '' AND one.country = two.country, f.alike, 0) + if(coalesce(contains(p.third.x, '<<'), false), f.separator, 0)"
    fine = f"score > b.score AND score >= f.least AND one.valid + two.valid + cast(whole as int) >= 2 AND (one.sure OR (NOT f.strict AND score >= {LENIENT_FROM})) AND (two.sure OR NOT f.strict)"
    lines_read = "if(p.third IS NULL, array(one.x, two.x), array(one.x, two.x, p.third.x))"
    order = f"((cast(k as bigint) * {MAX_LINE_VARIANTS} + one.i) * {MAX_LINE_VARIANTS} + two.i) * {MAX_LINE_VARIANTS} + coalesce(p.third.i, 0)"
    made = f"cast(named_struct('format', f.name, 'raw', own, 'lines', {lines_read}, 'score', score, 'gen_ord', {order}, 'valid_checks', one.valid + two.valid + cast(whole as int), 'composite', whole) as {CANDIDATE})"
    better = let_sql(whole, "whole", let_sql(score, "score", f"if({fine}, {made}, b)"))
    pairs = f"aggregate(p.firsts, best, (a, one) -> aggregate(seconds, a, (b, two) -> {better}))"
    search = let_sql(f"named_struct('firsts', {firsts}, 'third', {third})", "p", pairs)
    # readings of a first line begin as it does; no pair earns more than the format's most with the best of the second lines
    worth = "size(seconds) > 0 AND f.most - f.second + array_max(transform(seconds, x -> x.points)) > best.score"
    search = f"if(own[0] RLIKE '{OPENS}', {let_sql(seconds, 'seconds', f'if({worth}, {search}, best)')}, best)"
    noisy = f"concat_ws(' ', own) RLIKE '{'|'.join(NOISE_WORDS)}'"
    own = "transform(sequence(0, f.count - 1), n -> coalesce(get(z, k div 3 + n), ''))"
    step = let_sql("formats[k % 3]", "f", f"if(best.score >= f.most, best, {let_sql(own, 'own', f'if({noisy}, best, {search})')})")
    nothing = f"cast(named_struct('format', null, 'raw', null, 'lines', null, 'score', 0, 'gen_ord', null, 'valid_checks', null, 'composite', null) as {CANDIDATE})"
    folded = f"aggregate(sequence(0, 3 * size(z) - 1), {nothing}, (best, k) -> {step}, best -> if(best.format IS NULL, cast(null as {CANDIDATE}), best))"
    formats = _constant([_format(x) for x in ("TD3", "TD2", "TD1")], f"array<{_FORMAT}>")
    return f"if(size({lines}) > 0, {let_sql(formats, 'formats', let_sql(lines, 'z', folded))}, cast(null as {CANDIDATE}))"


def _pairwise(y: str, body: str) -> str:
    """body, which names x and i, of a struct y of both."""
    return let_sql(f"{y}.x", "x", let_sql(f"{y}.i", "i", body))


def best_candidate_column(lines: str, as_of: dt.date, known: frozenset[str]) -> Column:
    """best_candidate_sql as a column. lines: the name of an array of lines."""
    return F.expr(best_candidate_sql(lines, as_of.year, known))
