"""URL filters with a path-template tree (operator 8).

Rules decide the pages they fit. For all others, each host's paths form a tree of segments: a segment that is rare among its
siblings, or whose labels don't differ from theirs by more than chance, is generalised into a wildcard. Pages that rules
decide are the labels; a template's purity is its share of blocked pages, smoothed towards its host's and that towards the
corpus's, and templates above the limit are rejected. All of it is grouped aggregation over distinct paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, is_empty, table

#: (host, path, verdict). The longest rule that fits wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A segment stays as it is from so many pages; one that can't be compared, as only it or only its siblings have labels, also
#: needs such a share of its parent's pages.
SUPPORT, SHARE = 5, 0.02
#: Labels of siblings differ from this many standard errors.
Z = 1.96
#: Pseudo-pages of the priors, and the smoothed purity from which a template is rejected.
PULL, REJECT = 4.0, 0.7
#: Bytes of a table's strings up to which it is sent to all executors.
BROADCAST_BYTES = 32 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def rule_column(rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path, else nulls. Of equally long ones the first by text."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _sent_if_small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the strings of df, which is kept, are few bytes in all."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind == "string"), F.lit(40))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, template, purity.

    A null url, or one without ://, has an empty host and path; no rule fits it, and its verdict comes from the empty host's
    only template. With no rule that fits any page every page is allowed. Repeated rows count as often as they occur. Only
    the id and the url are read. Paths of any depth are followed as far as a host has SUPPORT pages; no segment beyond can stay.
    """
    spark: SparkSession = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_column(rules)
    rows = rows.withColumns({"rule": rule, "says": verdict})
    # distinct paths with their pages and labels: what follows doesn't depend on how often a path occurs
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum((F.col("says") == "block").cast("long")).alias("b"), F.sum((F.col("says") == "allow").cast("long")).alias("a"))
    paths = paths.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("a", "b")})
    segments = F.split(F.substring("path", 2, 1 << 30), "/")
    tree = scratch.cache(paths.withColumn("segments", F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(segments)).withColumn("template", F.lit("")))
    level = 0
    while not is_empty(tree.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n")).where(F.col("n") >= SUPPORT)):
        here = tree.withColumn("segment", F.get("segments", F.lit(level)))
        child = scratch.cache(here.where("segment is not null").groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("a").alias("a")))
        parent = scratch.cache(child.groupBy("host", "template").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"), F.sum("a").alias("pa")))
        child = child.where(F.col("n") >= SUPPORT).join(_sent_if_small(parent), ["host", "template"])
        labelled, others = F.col("a") + F.col("b"), F.col("pa") + F.col("pb") - F.col("a") - F.col("b")
        rate = F.col("pb") / F.greatest(F.col("pa") + F.col("pb"), F.lit(1))
        error = F.sqrt(F.greatest(rate * (1 - rate), F.lit(1e-9)) * (1 / F.greatest(labelled, F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        z = F.abs(F.col("b") / F.greatest(labelled, F.lit(1)) - (F.col("pb") - F.col("b")) / F.greatest(others, F.lit(1))) / error
        # siblings with labels are compared; with labels on one side only they can't be told alike; without any they are
        stays = F.when((labelled > 0) & (others > 0), z >= Z).otherwise(((labelled > 0) != (others > 0)) & (F.col("n") >= SHARE * F.col("pn")))
        # only segments that stay are joined back; all others are wildcards
        stay = scratch.cache(child.where(stays).select("host", "template", "segment", F.col("segment").alias("as")))
        joined = here.join(_sent_if_small(stay), ["host", "template", "segment"], "left")
        step = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.coalesce("as", F.lit("*"))))
        old, tree = tree, scratch.write(joined.select("host", "path", "n", "b", "a", "segments", step.alias("template")))
        scratch.drop(old)
        level += 1
    rest = F.greatest(F.size("segments") - level, F.lit(0))
    tree = tree.withColumn("template", F.concat("template", F.repeat(F.lit("/*"), rest)))
    of_template = tree.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    of_host = of_template.groupBy("host").agg(F.sum("b").alias("hb"), F.sum("a").alias("ha"))
    blocked, labelled = of_host.agg(F.sum("hb"), F.sum(F.col("hb") + F.col("ha"))).first()
    prior = ((blocked or 0) + 0.5) / ((labelled or 0) + 1) if labelled else 0.0
    of_host = of_host.select("host", ((F.col("hb") + PULL * prior) / (F.col("hb") + F.col("ha") + PULL)).alias("hp"))
    of_template = of_template.join(_sent_if_small(scratch.cache(of_host)), "host").select("host", "template", ((F.col("b") + PULL * F.col("hp")) / (F.col("a") + F.col("b") + PULL)).alias("purity"))
    of_path = scratch.cache(tree.select("host", "path", "template").join(_sent_if_small(scratch.cache(of_template)), ["host", "template"]))
    out = rows.join(_sent_if_small(of_path), ["host", "path"])
    verdict = F.coalesce("says", F.when(F.col("purity") >= REJECT, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
