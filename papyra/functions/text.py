"""String rules shared by all extractors: blanks, word edges, accents, first-non-empty."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks beyond those that the JVM's \s knows.
WIDE_BLANKS = "[\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
#: ASCII word edges: the JVM's own \b also counts letters beyond ASCII.
WORD = "[A-Za-z0-9_]"
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def blank(c: Column) -> Column:
    return F.regexp_replace(c, WIDE_BLANKS, " ")


def collapse(c: Column) -> Column:
    """Runs of blanks become one space; none at the ends."""
    return F.trim(F.regexp_replace(blank(c), r"\s+", " "))


def present(c: Column) -> Column:
    """'' is the mark of absence: null becomes ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def either(*cs: Column) -> Column:
    """The first that is neither null nor ''; else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs], F.lit(""))


def has(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


@lru_cache
def _accents() -> tuple[str, str]:
    """Characters that lose marks in U+0300-036F when decomposed, and the single characters that stay."""
    a, b = [], []
    for code in range(0x80, min(0x10000, sys.maxunicode)):
        ch = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if not 0x300 <= ord(x) <= 0x36F)
        if len(bare) == 1 and bare != ch:
            a.append(ch)
            b.append(bare)
    return "".join(a), "".join(b)


def strip_accents(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *_accents()), "[\\u0300-\\u036f]", "")


def edged(pattern: str) -> str:
    return f"{EDGE}{pattern}{EDGE}"


def drop_words(c: Column, words: tuple[str, ...], by: str = " ") -> Column:
    return F.regexp_replace(c, edged(f"(?:{'|'.join(words)})"), by)


def literal(text: str) -> str:
    """A pattern for text as it is. Blanks and letters stay as they are."""
    return "".join("\\" + ch if ch in ".*+?^${}()|[]\\" else ch for ch in text)


def half_up(c: Column) -> Column:
    """Rounding with halves up, for numbers that aren't negative."""
    return F.floor(c + 0.5).cast("int")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def listed(*values: Column) -> Column:
    """The values that aren't null, in order."""
    return F.filter(F.array(*values), lambda x: x.isNotNull())


def constant_map(entries: dict, kind: str = "string") -> Column:
    """A map known when the plan is built, as one constant: a map of many single literals would slow the optimizer."""
    return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), f"map<string,{kind}>")


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it: a binding inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_match(c: Column, patterns: tuple[str, ...], clean) -> Column:
    """clean(group 2, or if it is empty group 1) of the first pattern that is found; clean('') if none is."""
    out = F.lit("")
    for p in reversed(patterns):
        groups = _groups(p)
        value = F.regexp_extract(c, p, 1) if groups < 2 else either(F.regexp_extract(c, p, 2), F.regexp_extract(c, p, 1))
        out = F.when(c.rlike(p), value).otherwise(out)
    return clean(out)


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern.replace("\\z", "\\Z")).groups
