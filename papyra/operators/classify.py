"""Documents by keywords: each rule's score, the best, and the next three."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions.text import collapse, let, strip_accents

from .automaton import MOST_BYTES, Automaton, Windows


@dataclass(frozen=True)
class Rule:
    type: str
    category: str
    route: str
    keywords: tuple[str, ...]


#: The rules, in the order that decides between equal scores.
RULES = (
    Rule("Refugee Protection Claimant Document", "Immigration / Protection Document", "refugee", ("REFUGEE PROTECTION CLAIMANT DOCUMENT", "REFUGEE PROTECTION CLAIMANT", "IMMIGRATION AND REFUGEE PROTECTION ACT", "APPLICATION NO", "UCI", "NOT VALID FOR TRAVEL")),
    Rule("Refugee Travel Document", "Primary Travel Document", "mrz", ("REFUGEE TRAVEL DOCUMENT", "CONVENTION TRAVEL DOCUMENT", "PROTECTED PERSON TRAVEL DOCUMENT")),
    Rule("Schengen Visa", "Visa", "schengen", ("SCHENGEN", "VALID FOR", "NUMBER OF ENTRIES", "DURATION OF STAY", "TYPE OF VISA", "ETATS SCHENGEN")),
    Rule("UAE Residence Visa", "Residence", "uaeVisa", ("UNITED ARAB EMIRATES", "RESIDENCE", "RESIDENCE VISA", "EMIRATES ID", "UID", "FILE NUMBER", "SPONSOR")),
    Rule("Emirates ID", "Identity Document", "uaeVisa", ("EMIRATES ID", "IDENTITY CARD", "ID NUMBER", "UNITED ARAB EMIRATES")),
    Rule("Entry Permit", "Immigration Authorization", "uaeVisa", ("ENTRY PERMIT", "PERMIT NO", "VALID UNTIL", "PORT OF ENTRY", "SPONSOR")),
    Rule("Work Permit", "Immigration Authorization", "generic", ("WORK PERMIT", "EMPLOYER", "OCCUPATION", "LABOUR", "LABOR")),
    Rule("Study Permit", "Immigration Authorization", "generic", ("STUDY PERMIT", "STUDENT", "INSTITUTION", "SCHOOL")),
    Rule("Permanent Resident Card", "Residence", "generic", ("PERMANENT RESIDENT", "PR CARD", "RESIDENT CARD", "GREEN CARD", "CARD EXPIRES")),
    Rule("US Visa", "Visa", "generic", ("UNITED STATES OF AMERICA", "VISA", "CONTROL NUMBER", "ANNOTATION", "VISA CLASS")),
    Rule("UK Visa", "Visa", "generic", ("UNITED KINGDOM", "ENTRY CLEARANCE", "LEAVE TO ENTER", "VALID UNTIL", "CONDITIONS")),
    Rule("Visa", "Visa", "generic", ("VISA", "VISA NO", "VISA NUMBER", "VALID FROM", "VALID UNTIL", "PASSPORT NO")),
    Rule("Passport", "Primary Travel Document", "mrz", ("PASSPORT", "NATIONALITY", "DATE OF BIRTH", "DATE OF EXPIRY", "ISSUING COUNTRY")),
)
UNKNOWN_TYPE = "Unknown Travel / Immigration Document"
#: Points for a keyword, for one of over LONG characters, for three hits and for five; a zone's own score.
SHORT_POINTS, LONG_POINTS, LONG, THREE, FIVE, MRZ_SCORE, MOST = 10, 18, 14, 20, 25, 95, 99


def normalize(text: Column) -> Column:
    return collapse(F.upper(strip_accents(F.coalesce(text, F.lit("")))))


def _plain(keyword: str) -> str:
    import unicodedata

    return " ".join("".join(x for x in unicodedata.normalize("NFD", keyword) if not 0x300 <= ord(x) <= 0x36F).upper().split())


#: Rules up to which they are a constant of the plan; with more, texts go through an automaton.
PLAIN_RULES = 50
CLASSIFICATION = "struct<type:string,category:string,route:string,confidence:int,matchedKeywords:array<string>,alternatives:array<struct<type:string,confidence:int,route:string>>>"
_RULE = "array<struct<i:int,type:string,category:string,route:string,keywords:array<struct<k:string,plain:string,points:int>>>>"
_RANKED = "struct<k:int,i:int,type:string,category:string,route:string,found:array<string>>"


def _points(plain: str) -> int:
    return LONG_POINTS if len(plain) > LONG else SHORT_POINTS


#: Texts that the automaton goes through together: what it finds in them is held at once.
TEXTS = 256


class Rules:
    """Rules in their order, from a table of any size that the driver can hold: some tens of bytes a keyword, as each Python worker
    has them too."""

    def __init__(self, rules: tuple[Rule, ...]):
        kinds, size = [pa.array([getattr(r, c) for r in rules], pa.large_string()) for c in ("type", "category", "route")], [len(r.keywords) for r in rules]
        self._hold(*kinds, np.repeat(np.arange(len(rules)), size), pa.array([k for r in rules for k in r.keywords], pa.large_string()))

    def _hold(self, types: pa.Array, categories: pa.Array, routes: pa.Array, rule: np.ndarray, keywords: pa.Array) -> None:
        """rule: that of each keyword, rising."""
        self.types, self.categories, self.routes, self.rule, self.keywords = types, categories, routes, rule.astype(np.int32), keywords

    @classmethod
    def of(cls, table: DataFrame) -> Rules:
        """From a table (rule_ord, type, category, route, keyword, keyword_ord)."""
        rows = table.select("rule_ord", "type", "category", "route", "keyword", "keyword_ord").orderBy("rule_ord", "keyword_ord", "keyword").toArrow()
        number = rows["rule_ord"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        first = pa.array(np.flatnonzero(np.diff(number, prepend=-1)))
        out = cls.__new__(cls)
        out._hold(*(rows[c].take(first).combine_chunks().cast(pa.large_string()) for c in ("type", "category", "route")), number, rows["keyword"].combine_chunks().cast(pa.large_string()))
        return out

    def __len__(self) -> int:
        return len(self.types)

    @property
    def rules(self) -> tuple[Rule, ...]:
        cuts = np.searchsorted(self.rule, np.arange(len(self) + 1)).tolist()
        return tuple(Rule(*(c[i].as_py() for c in (self.types, self.categories, self.routes)), tuple(self.keywords[x:y].to_pylist())) for i, (x, y) in enumerate(zip(cuts, cuts[1:])))

    @cached_property
    def finder(self) -> tuple[Automaton | Windows, np.ndarray]:
        """What finds keywords, and each one's points."""
        plain = [_plain(k) for k in self.keywords.to_pylist()]
        points = np.array([_points(p) for p in plain], dtype=np.int8)
        return Automaton(plain) if sum(len(p.encode("utf-8", "surrogatepass")) for p in plain) <= MOST_BYTES else Windows(plain), points

    def ranked(self, texts: list[str | None]) -> list[list[tuple[int, int, list[str]]]]:
        """For each text the first four rules, as (score, rule, keywords found), by score and then order.

        A text may have a large part of all keywords, so they are held for one text, or a few, at a time.
        """
        finder, _ = self.finder
        if isinstance(finder, Windows):
            return [self._first(finder.one(t)) for t in texts]
        ranked = []
        for at in range(0, len(texts), TEXTS):
            part = texts[at : at + TEXTS]
            row, found = finder.found(part)
            ranked += [self._first(x) for x in np.split(found, np.searchsorted(row, np.arange(1, len(part))))]
        return ranked

    def _first(self, found: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """The first four rules of a text that has these keywords (rising)."""
        rule = self.rule[found]
        at = np.flatnonzero(np.diff(rule, prepend=-1))
        hit, n = rule[at].astype(np.int64), np.diff(np.append(at, len(rule)))
        score = (np.add.reduceat(self.finder[1][found], at, dtype=np.int64) if len(at) else np.zeros(0, dtype=np.int64)) + THREE * (n >= 3) + FIVE * (n >= 5)
        key = hit - score * (len(self) + 1)
        best = np.argpartition(key, 3)[:4] if len(key) > 4 else np.arange(len(key))
        best = best[np.argsort(key[best])].tolist()
        out = [(int(score[b]), int(hit[b]), self.keywords.take(pa.array(found[at[b] : at[b] + n[b]])).to_pylist()) for b in best]
        i, had = 0, set(hit[:4].tolist()) if len(out) < 4 else set()
        while len(out) < 4 and i < len(self):  # rules without a hit follow in their order
            if i not in had:
                out.append((0, i, []))
            i += 1
        return out


def rules_frame(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The table that Rules.of() reads."""
    rows = [(i, r.type, r.category, r.route, k, j) for i, r in enumerate(rules) for j, k in enumerate(r.keywords)]
    return spark.createDataFrame(rows, "rule_ord int, type string, category string, route string, keyword string, keyword_ord int")


def _ranked_by_plan(text: Column, rules: tuple[Rule, ...]) -> Column:
    """All rules, scored by one expression over a constant of them."""
    data = [{"i": i, "type": r.type, "category": r.category, "route": r.route, "keywords": [{"k": k, "plain": _plain(k), "points": _points(_plain(k))} for k in r.keywords]} for i, r in enumerate(rules)]
    table = F.from_json(F.lit(json.dumps(data, ensure_ascii=False)), _RULE)

    def scored(t: Column, r: Column) -> Column:
        def rank(found: Column) -> Column:
            n = F.size(found)
            score = F.aggregate(found, F.lit(0), lambda a, k: a + k["points"]) + F.when(n >= 3, THREE).otherwise(0) + F.when(n >= 5, FIVE).otherwise(0)
            return F.struct((-score).alias("k"), r["i"].alias("i"), r["type"].alias("type"), r["category"].alias("category"), r["route"].alias("route"), F.transform(found, lambda k: k["k"]).alias("found")).cast(_RANKED)

        return let(F.filter(r["keywords"], lambda k: t.contains(k["plain"])), rank)

    return let(text, lambda t: F.transform(table, lambda r: scored(t, r)))


def _ranked_by_automaton(text: Column, rules: Rules) -> Column:
    """The first four rules, found by the automaton or by windows, which are made once and sent to the executors."""
    rules.finder  # noqa: B018  made here

    @F.pandas_udf(f"array<{_RANKED}>")
    def rank(texts: pd.Series) -> pd.Series:
        told = lambda s, i, found: {"k": -s, "i": i, "type": rules.types[i].as_py(), "category": rules.categories[i].as_py(), "route": rules.routes[i].as_py(), "found": found}
        return pd.Series([[told(*x) for x in row] for row in rules.ranked(texts.tolist())])

    return rank(text)


def classify(text: Column, rules: Rules | tuple[Rule, ...] = RULES, mrz_format: Column | None = None, mrz_type: Column | None = None) -> Column:
    """struct(type, category, route, confidence, matchedKeywords, alternatives) of an already normalised text.

    Keywords match anywhere, also inside words. Equal scores keep the rules' order. Without any hit the type is unknown, but the
    route stays the first rule's. A zone, if given, counts as one more rule. Many rules are looked for by an automaton.
    """
    rules = rules if isinstance(rules, Rules) else Rules(rules)
    ranked = _ranked_by_plan(text, rules.rules) if len(rules.keywords) <= 4 * PLAIN_RULES and len(rules) <= PLAIN_RULES else _ranked_by_automaton(text, rules)
    if mrz_format is not None:
        is_zone = mrz_format.isNotNull() & (mrz_format != "NONE") & (mrz_format != "")
        kind = F.coalesce(F.nullif(mrz_type, F.lit("")) if mrz_type is not None else F.lit(None), F.lit("Passport"))
        zone = F.struct(F.lit(-MRZ_SCORE).alias("k"), F.lit(len(rules)).alias("i"), kind.alias("type"), F.lit("Primary Travel Document").alias("category"), F.lit("mrz").alias("route"), F.array(F.lit("MRZ")).alias("found")).cast(_RANKED)
        ranked = F.concat(ranked, F.when(is_zone, F.array(zone)).otherwise(F.array().cast(f"array<{_RANKED}>")))

    def told(r: Column) -> Column:
        best = F.get(r, F.lit(0))
        hit = best["k"] < 0
        others = F.transform(F.slice(r, 2, 3), lambda x: F.struct(x["type"].alias("type"), F.least(F.lit(MOST), -x["k"]).alias("confidence"), x["route"].alias("route")))
        return F.struct(F.when(hit, best["type"]).otherwise(UNKNOWN_TYPE).alias("type"), F.when(hit, best["category"]).otherwise("Other").alias("category"), best["route"].alias("route"), F.least(F.lit(MOST), -best["k"]).alias("confidence"), best["found"].alias("matchedKeywords"), others.alias("alternatives")).cast(CLASSIFICATION)

    return let(F.array_sort(ranked), told)
