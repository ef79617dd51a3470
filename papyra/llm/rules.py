"""Quality rules with adaptive thresholds (operator 11).

A document's measures are judged by what is usual in its language and source. For each group a quantile sketch of every
measure is kept: counts in log-linear buckets, which are exact up to 64 and within 1/64 beyond. Sketches of parts of the data
merge by adding counts, in any order with the same result, so that sketches of sources merge into those of languages and
these into one of the whole corpus. Quartiles from the sketches give fences; documents are joined with the fences of their
group, or of the next wider one where a group is small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_few, shingle_hashes, table, word_hashes

#: Words of the windows that count as repeated, and the two fixed rules: least words, and most repeated words in percent.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = b"#*$%&|<>"
#: Bits of a value that its bucket keeps.
SKETCH_BITS = 6
#: Documents with a word that a group needs to have fences of its own.
LEAST_DOCS = 50
#: Fences lie so many spreads beyond the quartiles; those of a source at most FAR spreads beyond its language's.
NEAR, FAR = 3, 6
#: Groups up to which their fences are sent to all executors.
BROADCAST_GROUPS = 20_000

#: Each measure: its value as a whole number, its least spread, and whether low values fail too.
MEASURES = {
    "word_length": ("1000 * word_chars div nullif(n_words, 0)", 1000, True),
    "symbols": ("10000 * n_symbols div nullif(n_words, 0)", 300, False),
    "dup_lines": ("10000 * n_dup_lines div nullif(n_lines, 0)", 1600, False),
    "repeated": ("10000 * n_repeat_words div nullif(n_words, 0)", 900, False),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
COUNTED = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)}>"


def counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; n_lines are its lines with a word. All are 0 for null, empty and blank texts."""
    b = (text or "").encode("utf-8", "surrogatepass")
    words = b.split()
    chars = len(text or "") - sum(b.count(bytes((c,))) for c in (32, *range(9, 14)))
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        _, place, often = np.unique(shingle_hashes(word_hashes(words), WINDOW), return_inverse=True, return_counts=True)
        starts = np.flatnonzero(often[place] > 1)
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        repeated = int((np.cumsum(edge) > 0).sum())
    return len(words), chars, sum(b.count(bytes((c,))) for c in SYMBOLS), len(lines), len(lines) - len(set(lines)), repeated


def counted(text: Column) -> Column:
    """counts() as a struct column."""

    @F.pandas_udf(COUNTED)
    def of_batch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    return of_batch(text)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def bucket(name: str) -> Column:
    """The lower end of the bucket that a whole number falls in."""
    cut = f"greatest(length(bin({name})) - {SKETCH_BITS}, 0)"
    return F.expr(f"shiftleft(shiftright({name}, {cut}), {cut})")


def sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): a sketch of each measure for each group. rows: keys and COUNTS. Documents without a word
    are in none."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(value).alias("value")) for m, (value, _, _) in MEASURES.items()]))
    values = rows.where("n_words > 0").select(*keys, each.alias("m")).select(*keys, "m.*")
    return values.groupBy(*keys, "measure", bucket("value").alias("bucket")).agg(F.count("*").alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of wider groups from those of narrower ones."""
    return parts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, docs, low, high): first and third quartile of each sketch, as the buckets that hold them."""
    group = [*keys, "measure"]
    # a group has a few thousand buckets at most, whatever the number of its documents
    ordered = parts.withColumn("upto", F.expr(f"sum(n) OVER (PARTITION BY {', '.join(group)} ORDER BY bucket)")).withColumn("docs", F.expr(f"sum(n) OVER (PARTITION BY {', '.join(group)})"))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bucket")))
    return ordered.groupBy(*group).agg(F.first("docs").alias("docs"), at(25).alias("low"), at(75).alias("high"))


def _by_measure(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row for each group: struct `name` of docs and the fences of all measures, near and far."""
    spreads = F.create_map(*[x for m, (_, least, _) in MEASURES.items() for x in (F.lit(m), F.lit(least).cast("long"))])
    spread = F.greatest(F.col("high") - F.col("low"), spreads[F.col("measure")])
    ends = F.struct((F.col("low") - NEAR * spread).alias("low"), (F.col("high") + NEAR * spread).alias("high"), (F.col("low") - FAR * spread).alias("far_low"), (F.col("high") + FAR * spread).alias("far_high"))
    picked = [F.max(F.when(F.col("measure") == m, ends)).alias(m) for m in MEASURES]
    wide = found.groupBy(*keys).agg(F.max("docs").alias("docs"), *picked)
    return wide.select(*keys, F.struct("docs", *MEASURES).alias(name))


def fences(rows: DataFrame, scratch: Scratch, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, fences): for each group of rows (lang, source, COUNTS) the low and high end of each measure."""
    own = scratch.cache(sketches(rows, ["lang", "source"]))
    of_lang = scratch.cache(merged(own, ["lang"]))
    corpus = _by_measure(quartiles(merged(of_lang.withColumn("corpus", F.lit(1)), ["corpus"]), ["corpus"]), ["corpus"], "c")
    langs = _by_measure(quartiles(of_lang, ["lang"]), ["lang"], "l").withColumn("corpus", F.lit(1)).join(F.broadcast(corpus), "corpus")
    wide = lambda f: F.when(F.col("l.docs") >= least_docs, F.col(f"l.{f}")).otherwise(F.col(f"c.{f}"))
    langs = langs.select("lang", F.struct(*[wide(m).alias(m) for m in MEASURES]).alias("l"))
    groups = _by_measure(quartiles(own, ["lang", "source"]), ["lang", "source"], "g").join(broadcast_if_few(langs, BROADCAST_GROUPS), "lang")
    ends = []
    for m in MEASURES:
        enough = F.col("g.docs") >= least_docs
        low = F.when(enough, F.greatest(f"g.{m}.low", f"l.{m}.far_low")).otherwise(F.col(f"l.{m}.low"))
        high = F.when(enough, F.least(f"g.{m}.high", f"l.{m}.far_high")).otherwise(F.col(f"l.{m}.high"))
        ends.append(F.struct(low.alias("low"), high.alias("high")).alias(m))
    return groups.select("lang", "source", F.struct(*ends).alias("fences"))


def failed_measures() -> Column:
    """Names of the measures that lie beyond their fences, in the order of MEASURES; of columns COUNTS and fences."""
    out = []
    for m, (value, _, both) in MEASURES.items():
        beyond = F.expr(value) > F.col(f"fences.{m}.high")
        out.append(F.when(beyond | (F.expr(value) < F.col(f"fences.{m}.low")) if both else beyond, F.lit(m)))
    return F.filter(F.array(*out), lambda x: x.isNotNull())


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """One row for each of docs: id_col, COUNTS, base_failed, failed (measures beyond their fences) and kept.

    Null and empty texts have no words and fail the fixed rules. Null languages are `und`, null sources one source. Repeated
    rows and ids are judged each by itself and counted each; an empty table gives no rows. A measure that equals its fence
    passes, and with no spread at all (all documents alike) everything passes.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), counted(F.col(text_col)).alias("c"))
    rows = scratch.cache(rows.select("id", "lang", "source", "c.*"))
    found = broadcast_if_few(scratch.cache(fences(rows, scratch, least_docs)), BROADCAST_GROUPS)
    judged = rows.join(found, ["lang", "source"], "left").select("id", *COUNTS, base_failed().alias("base_failed"), failed_measures().alias("failed"))
    return judged.select(F.col("id").alias(id_col), *COUNTS, "base_failed", "failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS) -> DataFrame:
    """The rows of docs, all columns, that judge() keeps. No ids are needed: each row is judged beside its text."""
    scratch = Scratch(docs.sparkSession)
    group = {"__lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), "__source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))}
    rows = docs.select(*[c.alias(k.strip("_")) for k, c in group.items()], counted(F.col(text_col)).alias("c")).select("lang", "source", "c.*")
    found = scratch.cache(fences(rows, scratch, least_docs)).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct("fences").alias("__f"))
    whole = F.struct(*[F.col(c) for c in docs.columns]).alias("__row")
    rows = docs.select(whole, *[c.alias(k) for k, c in group.items()], counted(F.col(text_col)).alias("c")).join(broadcast_if_few(found, BROADCAST_GROUPS), ["__lang", "__source"], "left")
    good = rows.select("__row", "c.*", "__f.*").where(~base_failed() & (F.size(failed_measures()) == 0))
    return good.select("__row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def _value(m: str) -> str:
    return MEASURES[m][0].replace(" div ", " // ")


_UNPIVOT = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {_value(m)} AS v FROM counted WHERE n_words > 0" for m in MEASURES)
_LEAST = " ".join(f"WHEN '{m}' THEN {least}" for m, (_, least, _) in MEASURES.items())
_BEYOND = ", ".join(f"CASE WHEN {_value(m)} > {m}.high{f' OR {_value(m)} < {m}.low' if both else ''} THEN '{m}' END" for m, (_, _, both) in MEASURES.items())


def _quartiles(name: str, keys: str) -> str:
    by = f"{keys}, measure" if keys else "measure"
    return f"""{name} AS (
  SELECT {by}, any_value(docs) AS docs, min(b) FILTER (upto * 100 >= docs * 25) AS q1, min(b) FILTER (upto * 100 >= docs * 75) AS q3 FROM (
    SELECT {by}, b, sum(n) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(n) OVER (PARTITION BY {by}) AS docs FROM (SELECT {by}, b, count(*) AS n FROM valued GROUP BY {by}, b)) GROUP BY {by}),
{name}_f AS (SELECT *, q1 - {NEAR} * s AS low, q3 + {NEAR} * s AS high, q1 - {FAR} * s AS far_low, q3 + {FAR} * s AS far_high FROM (SELECT *, greatest(q3 - q1, CASE measure {_LEAST} END) AS s FROM {name}))"""


OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) AS pos, unnest(ws) AS word FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d)),
win AS (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s, count(*) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM w),
rep AS (SELECT *, k = {WINDOW} AND count(*) OVER (PARTITION BY doc_id, k, s) > 1 AS r FROM win),
cov AS (SELECT doc_id, word, max(CAST(r AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS c FROM rep),
wc AS (SELECT doc_id, count(*) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM cov GROUP BY doc_id),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (
  SELECT d.doc_id, lang, source, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN wc ON d.doc_id = wc.doc_id LEFT JOIN lc ON d.doc_id = lc.doc_id),
valued AS (SELECT lang, source, measure, (v >> greatest(length(bin(v)) - {SKETCH_BITS}, 0)::BIGINT) << greatest(length(bin(v)) - {SKETCH_BITS}, 0)::BIGINT AS b FROM ({_UNPIVOT})),
{_quartiles('g', 'lang, source')}, {_quartiles('l', 'lang')}, {_quartiles('c', '')},
wide AS (SELECT l_f.lang, l_f.measure, CASE WHEN l_f.docs >= {LEAST_DOCS} THEN l_f.low ELSE c_f.low END AS low, CASE WHEN l_f.docs >= {LEAST_DOCS} THEN l_f.high ELSE c_f.high END AS high,
  CASE WHEN l_f.docs >= {LEAST_DOCS} THEN l_f.far_low ELSE c_f.far_low END AS far_low, CASE WHEN l_f.docs >= {LEAST_DOCS} THEN l_f.far_high ELSE c_f.far_high END AS far_high FROM l_f JOIN c_f ON l_f.measure = c_f.measure),
ends AS (SELECT g_f.lang, g_f.source, g_f.measure, CASE WHEN g_f.docs >= {LEAST_DOCS} THEN greatest(g_f.low, wide.far_low) ELSE wide.low END AS low, CASE WHEN g_f.docs >= {LEAST_DOCS} THEN least(g_f.high, wide.far_high) ELSE wide.high END AS high
  FROM g_f JOIN wide ON g_f.lang = wide.lang AND g_f.measure = wide.measure),
o AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, CASE WHEN n_words > 0 THEN concat_ws(',', {_BEYOND}) ELSE '' END AS failed
  FROM counted {' '.join(f"LEFT JOIN (SELECT * FROM ends WHERE measure = '{m}') {m} ON counted.lang = {m}.lang AND counted.source = {m}.source" for m in MEASURES)})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM o
"""
