"""Line dedup by distinct-site spread (operator 5).

A line is boilerplate if it stands on many distinct sites. For each line hash a HyperLogLog sketch of its sites is merged by
aggregation; lines whose estimate is clearly below or above the limit are decided by it, those near it by an exact distinct
count. Of a boilerplate line the first occurrence (smallest doc_id, then line number) stays and all others go, so that a
passage copied to many sites is still there once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_few, table

#: Distinct sites that make a line boilerplate.
SITES = 10
#: log2 of the sketch's registers: a standard error of some 3 percent; estimates within NEAR of the limit are counted exactly.
SKETCH_LOG2 = 10
NEAR = 0.25
#: Lines up to which they are sent to all executors.
BROADCAST_ROWS = 100_000


def _norm(line: Column) -> Column:
    """Lines are compared without the white space around them and with runs of it as one space."""
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """All rows and columns of docs, text without the removed lines, and n_lines and n_removed, which replace columns of these
    names.

    Lines end at \\n. Empty lines are never boilerplate. Null and empty texts stay as they are (n_lines 0 for null). A null
    site counts as one site of its own. A null id sorts first. Rows that share an id are told apart by their texts; rows alike in
    both are one occurrence, whose lines stay or go together.
    """
    found = _deduped(docs, id_col, text_col, site_col, sites)
    return found.drop("n_lines", "n_removed").withColumnsRenamed({"__lines": "n_lines", "__removed": "n_removed"})


def _deduped(source: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """source with its text deduplicated, and the columns __lines and __removed."""
    spark: SparkSession = source.sparkSession
    scratch = Scratch(spark)
    row = F.xxhash64(text_col)  # with the id it says which row: ids may be shared
    lines = source.select(F.col(id_col).alias("id"), row.alias("row"), F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", _norm(F.col("line"))).where("line <> ''")
    lines = lines.select("id", "row", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    lines = scratch.cache(lines)
    # a line that stands fewer times than the limit can't be on that many sites
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "pos", "row")).alias("first")).where(F.col("n") >= sites)
    often = scratch.keep(often.select("h1", "h2", "first"))
    # one sketch of sites for each line hash, merged by aggregation
    sketches = lines.join(broadcast_if_few(often.select("h1", "h2"), BROADCAST_ROWS), ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.hll_sketch_agg("site", SKETCH_LOG2).alias("sketch"))
    sketches = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - NEAR))
    spread = scratch.keep(often.join(sketches, ["h1", "h2"]))
    near = spread.where(F.col("estimate") < sites * (1 + NEAR)).select("h1", "h2")
    exact = lines.join(broadcast_if_few(near, BROADCAST_ROWS), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "site").count().groupBy("h1", "h2").agg(F.count("*").alias("exact"))
    boiler = spread.join(exact, ["h1", "h2"], "left").where(F.coalesce("exact", "estimate") >= sites).select("h1", "h2", "first")
    boiler = scratch.keep(boiler)
    gone = lines.join(broadcast_if_few(boiler, BROADCAST_ROWS), ["h1", "h2"]).where(~F.struct("id", "pos", "row").eqNullSafe(F.col("first")))
    gone = scratch.keep(gone.groupBy("id", "row").agg(F.collect_set("pos").alias("__gone")).withColumnsRenamed({"id": "__id", "row": "__row"}))
    out = source.join(gone, source[id_col].eqNullSafe(gone["__id"]) & (row == gone["__row"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    kept = F.array_join(F.filter(parts, lambda line, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    text = F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts))
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size(F.filter(parts, lambda line, i: F.array_contains(F.col("__gone"), i))))
    kept_cols = [text.alias(c) if c == text_col else F.col(c) for c in source.columns]
    return out.select(*kept_cols, n_lines.cast("int").alias("__lines"), n_removed.cast("int").alias("__removed"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")


OP5_SQL = f"""
WITH l AS (
  SELECT d.doc_id, md5(d.text) AS row, d.source, u.pos - 1 AS pos, trim(regexp_replace(list_extract(string_split(d.text, chr(10)), u.pos), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS line
  FROM documents d, unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS u(pos)),
b AS (SELECT line, min((doc_id, pos, row)) AS f FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT coalesce(source, '')) >= {SITES}),
r AS (SELECT doc_id, row, list(pos) AS gone FROM (SELECT DISTINCT l.doc_id, l.row, l.pos FROM l JOIN b ON l.line = b.line WHERE (l.doc_id, l.pos, l.row) IS DISTINCT FROM b.f) GROUP BY doc_id, row),
o AS (
  SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(r.gone), 0) AS INTEGER) AS n_removed,
    CASE WHEN r.gone IS NULL THEN d.text ELSE (
      SELECT coalesce(string_agg(list_extract(string_split(d.text, chr(10)), i), chr(10) ORDER BY i), '')
      FROM unnest(range(1, len(string_split(d.text, chr(10))) + 1)) AS t(i) WHERE NOT list_contains(r.gone, i - 1)) END AS text
  FROM documents d LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND md5(d.text) = r.row)
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5, text FROM o
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their boilerplate lines. A document that loses every line was a copy and goes; n_chars follows the text."""
    found = _deduped(docs)
    found = found.where(~((F.col("__removed") > 0) & (F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")) == "")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("__removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)
