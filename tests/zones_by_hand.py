"""The search for a zone's best candidate in plain Python, for tests of the expression that does it."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

from papyra.config import MAX_LINE_VARIANTS
from papyra.operators.variants import DOCUMENT_TYPES, FORMATS, GENDER, KNOWN, LEAST, LENIENT_FROM, NOISE_WORDS, SHAPE, SPANS

_TO_DIGIT = str.maketrans("OQDILBSZG<", "0001185260")
_WORTH = {ch: i for i, ch in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")}
_FILL = "<" * 30


def force_digits(text: str) -> str:
    return text.translate(_TO_DIGIT)


def fit(text: str, width: int) -> str:
    return text[:width].ljust(width, "<")


def forced(text: str, width: int, spans: tuple[tuple[int, int], ...]) -> str:
    """text at its width, with digits forced where spans say; a span beyond the end adds and is cut again."""
    line = fit(text, width)
    for a, b in spans:
        line = line[:a] + force_digits(line[a:b])[: b - a].ljust(b - a, "<") + line[b:]
    return fit(line, width)


def separated(zone: str, mode: str) -> str:
    """A name zone whose separators were misread as filler letters."""
    zone = re.sub("[^A-Z<]", "", zone)
    for p in ("<{3,}", "[KLISZ]{3,}", "C{3,}"):
        zone = re.sub(p, "<<", zone)
    zone = re.sub("<([KLISZC])<C?([KLISZC]){2,}([A-Z]{2,})", r"<<\2\3", zone)
    zone = re.sub("<C?([KLISZC]){2,}([A-Z]{2,})", r"<<\1\2", zone)

    def between(m: re.Match) -> str:
        sep = m[2]
        real = "<" in sep or "C" not in sep or (set(sep) == {"C"} and len(sep) >= 3) or (mode == "aggressive" and len(sep) >= 4)
        return f"{m[1]}<<{m[3]}" if real else m[0]

    zone = re.sub("([A-Z])([<KLISZC]{2,})([A-Z])", between, zone)
    return re.sub("<{3,}", "<<", re.sub(r"[<KLISZC]{7,}\Z", _FILL, zone))


def conservative(zone: str) -> str:
    for p in ("<{3,}", "[KLISZ]{3,}", "C{4,}"):
        zone = re.sub(p, "<<", zone)
    return re.sub(r"[<KLISZC]{8,}\Z", _FILL, zone)


def name_line(raw: str, width: int) -> list[str]:
    out = [fit(raw, width)]
    if len(raw) >= 5:
        out += [fit(raw[:5] + z, width) for z in (separated(raw[5:], "balanced"), conservative(raw[5:]), separated(raw[5:], "aggressive"))]
    return out


def without(raw: str, i: int) -> str:
    return raw[:i] + raw[i + 1 :]


def _deletions(raw: str, width: int, places: range | tuple[int, ...]):
    if len(raw) > width:
        for i in places:
            if i < len(raw):
                cut = without(raw, i)
                yield fit(cut, width)
                yield forced(cut, width, SPANS["TD3"])
                yield forced(cut, width, SPANS["TD2"])


def _data_line(raw: str, width: int, fmt: str):
    yield fit(raw, width)
    yield forced(raw, width, SPANS[fmt])
    if len(raw) > width:
        if re.match(r"[A-Z]{4}[0-9OBISZGL]{6}", raw[10:20]):
            yield forced(without(raw, 13), width, SPANS[fmt])
        for i in range(13, 17):
            cut = without(raw, i)
            if re.fullmatch("[A-Z]{3}", cut[10:13]) and re.fullmatch("[0-9]{6}", force_digits(cut[13:19])):
                yield forced(cut, width, SPANS[fmt])
    yield from _deletions(raw, width, range(10, 45 if fmt == "TD3" else 36))
    if len(raw) > width:
        for i in range(len(raw)):
            yield forced(without(raw, i), width, SPANS[fmt])


def line_variants(raw: str, role: str) -> Iterator[str]:
    """Distinct readings of a line in the order they are tried, MAX_LINE_VARIANTS at most. role: TD3_LINE1 and so on."""
    fmt, place = role.split("_LINE")
    width = FORMATS[fmt]["width"]
    if (fmt, place) in (("TD3", "1"), ("TD2", "1"), ("TD1", "3")):
        made = name_line(raw, width)
    elif fmt != "TD1":
        made = _data_line(raw, width, fmt)
    elif place == "1":
        made = chain((fit(raw, width), forced(raw, width, SPANS["TD1_1"])), _deletions(raw, width, range(5, 15)))
    else:
        made = chain((fit(raw, width), forced(raw, width, SPANS["TD1_2"])), _deletions(raw, width, (*range(7), *range(8, 15))))
    seen: set[str] = set()
    for reading in made:
        if reading not in seen:
            seen.add(reading)
            yield reading
            if len(seen) == MAX_LINE_VARIANTS:
                return


class Replay:
    """What an iterator gives, worked out as far as it is asked for, any number of times."""

    def __init__(self, made: Iterator[str]):
        self.made, self.seen = made, []

    def __iter__(self) -> Iterator[str]:
        i = 0
        while True:
            if i == len(self.seen):
                more = next(self.made, None)
                if more is None:
                    return
                self.seen.append(more)
            yield self.seen[i]
            i += 1


def check(field: str, digit: str) -> bool:
    return digit not in ("", "<") and str(sum((7, 3, 1)[i % 3] * _WORTH.get(ch, 0) for i, ch in enumerate(field)) % 10) == digit


def _real(year: int, month: str, day: str) -> bool:
    try:
        dt.date(year, int(month), int(day))
    except ValueError:
        return False
    return True


def dates_ok(birth: str, expiry: str, year: int) -> bool:
    yy = int(birth[:2])
    born = (1900 if yy > year % 100 else 2000) + yy
    ends = year // 100 * 100 + int(expiry[:2])
    ends += 100 if ends < year - 5 else 0
    return 1900 <= born <= year and year - 30 <= ends <= year + 30 and _real(born, birth[2:4], birth[4:6]) and _real(ends, expiry[2:4], expiry[4:6])


def document_type(code: str) -> tuple[str, str]:
    return DOCUMENT_TYPES.get(code) or DOCUMENT_TYPES.get(code[:1]) or ("UNKNOWN", "UNKNOWN")


def _known(code: str, known: frozenset[str]) -> bool:
    return re.sub("[^A-Z]", "", code) in known


_OPENS = re.compile("[A-Z][A-Z<][A-Z]{3}")


def _digits(text: str) -> bool:
    return len(text) == 6 and text.isascii() and text.isdigit()


def candidates(lines: list[str], year: int, known: frozenset[str]):
    """All acceptable candidates, in order of generation: (format, raw, lines, score, ordinal, valid checks)."""
    ordinal = 0
    variants = lru_cache(None)(lambda raw, role: Replay(line_variants(raw, role)))
    for i in range(len(lines)):
        raw = [lines[i], lines[i + 1] if i + 1 < len(lines) else "", lines[i + 2] if i + 2 < len(lines) else ""]
        for fmt, count in (("TD3", 2), ("TD2", 2), ("TD1", 3)):
            rule, own = FORMATS[fmt], raw[:count]
            noise = any(w in " ".join(own) for w in NOISE_WORDS)
            firsts = Replay(v for v in variants(own[0], f"{fmt}_LINE1") if _OPENS.match(v))
            birth, expiry = ((0, 6), (8, 14)) if fmt == "TD1" else ((13, 19), (21, 27))
            dated_line = lambda v, b=birth, e=expiry: _digits(v[b[0] : b[1]]) and _digits(v[e[0] : e[1]])
            seconds = Replay(filter(dated_line, variants(own[1], f"{fmt}_LINE2")))
            thirds = variants(own[2], "TD1_LINE3") if count == 3 else (None,)
            for one in firsts:
                kind, issuer = document_type(one[:2].replace("<", ""))[0], one[2:5].replace("<", "")
                for two in seconds:
                    if fmt == "TD1":
                        number, nation, sex = check(one[5:14], one[14]), two[15:18].replace("<", ""), two[7]
                        whole = check(one[5:30] + two[:7] + two[8:15] + two[18:29], two[29])
                    else:
                        end = rule["width"] - 1
                        number, nation, sex = check(two[:9], two[9]), two[10:13].replace("<", ""), two[20]
                        whole = check(two[:10] + two[13:20] + two[21:end], two[end])
                    checks = (number, check(two[birth[0] : birth[1]], two[birth[1]]), check(two[expiry[0] : expiry[1]], two[expiry[1]]), whole)
                    valid, dated = sum(checks), dates_ok(two[birth[0] : birth[1]], two[expiry[0] : expiry[1]], year)
                    alike = bool(issuer) and issuer == nation
                    score = SHAPE + sum(p for p, ok in zip(rule["checks"], checks) if ok) + GENDER * (sex in "MFX<") + KNOWN * ((kind != "UNKNOWN") + (issuer in known) + _known(nation, known))
                    score += rule["alike"] * alike
                    for three in thirds:
                        ordinal += 1
                        total = max(0, score + rule["separator"] * ("<<" in (one if three is None else three)))
                        if noise or not dated or valid < 2 or total < LEAST[fmt]:
                            continue
                        strange = kind == "UNKNOWN" or issuer not in known
                        if strange and (fmt == "TD1" or total < LENIENT_FROM) or fmt == "TD1" and not _known(nation, known):
                            continue
                        yield fmt, own, [one, two] if three is None else [one, two, three], total, ordinal, valid


def best_candidate(lines: list[str], year: int, known: frozenset[str]) -> tuple | None:
    """The acceptable candidate with the highest score; of equal scores the first generated."""
    best = None
    for c in candidates(lines, year, known):
        if best is None or c[3] > best[3]:
            best = c
    return best
