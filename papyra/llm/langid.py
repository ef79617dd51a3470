"""Language identification by Bayesian evidence fusion (operator 9).

For each document the log posteriors of the languages add up from four kinds of evidence:
- the text: a naive Bayes model over byte trigrams, whose counts are summed over all documents by declared language;
- the declared markup language: how often a text of a language declares which one, counted over all documents;
- the address suffix (the host's last label) and the host: priors by grouped aggregation, smoothed hierarchically, the
  host's towards its suffix's and the suffix's towards the corpus's.
Declared languages with too few documents for a model of their own share one. A text that fits it best is of the language it
declares, or if that is none of them of an undetermined one.
Documents name a language and a source; of web pages page_evidence() takes both from the markup and the address.
A document is rejected if it has no letters, or if no language reaches the posterior wanted, or if its text fits no
language better than it fits one made of evenly spread trigrams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_few, table
from .urls import split_url

#: Trigrams are hashed to so many features.
FEATURES = 1 << 14
#: Pseudo-counts of the priors, and of declarations.
HOST_PULL, SUFFIX_PULL, DECLARED_PULL = 20.0, 50.0, 5.0
#: Trigrams aren't independent: a text counts as a power of its number of trigrams.
TEMPER = 0.5
#: Least posterior of a language; least gain over evenly spread trigrams, in nats a trigram.
LEAST_POSTERIOR, LEAST_GAIN = 0.5, 0.5
#: Declared languages with fewer documents, in a corpus of any size, share a model.
LEAST_DOCUMENTS = 3
#: Models of one language at most; languages are far fewer, so this only bounds what is sent to executors. Others share a model.
MOST_LANGUAGES = 256
#: Priors of hosts (eight bytes each) up to which they are sent to all executors.
PRIORS = 2_000_000
#: The name of the languages that share a model.
UNDETERMINED = "und"


def _features(text: str) -> np.ndarray:
    """Hashed byte trigrams of a text, lower-cased A-Z, with digits and ASCII punctuation as blanks and blanks joined."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()
    if not words:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint32)
    x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((x * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64)


_BLANK = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def _count(languages: list[str]):
    number = {x: i for i, x in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), FEATURES), dtype=np.int64)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang in number and text:
                    total[number[lang]] += np.bincount(_features(text), minlength=FEATURES)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j], pa.int64())], names=["language", "feature", "n"])

    return run


def _likelihoods(logp: np.ndarray):
    even = -math.log(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gain, scores = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                x = _features(text or "")
                n.append(len(x))
                if not len(x):
                    gain.append(0.0)
                    scores.append([0.0] * len(logp))
                    continue
                mean = logp[:, x].mean(axis=1)
                gain.append(float(mean.max() - even))
                scores.append(((mean - mean.max()) * len(x) ** TEMPER).tolist())
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = list(batch.schema.names[:-1])
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(gain, pa.float64()), pa.array(scores, pa.list_(pa.float64()))], names=[*names, "n_trigrams", "gain", "text_log"])

    return run


def page_evidence(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages for identify(): doc_id, text, lang, source.

    text is the markup without comments, scripts, styles, tags and entities; lang what the html element declares; source the
    host of the address, without a port. A null markup has a null text and language; a url without :// has an empty host.
    """
    bare = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", " ")
    html = F.regexp_replace(bare, r"(?is)<(script|style)\b.*?</\1\s*>|<[a-z/!][^>]*>|&#?\w+;", " ")
    lang = F.regexp_extract(bare, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""", 1)
    host = F.regexp_replace(split_url(F.col(url_col))[0], r":\d*$", "")
    return pages.select(F.col(id_col).alias("doc_id"), html.alias("text"), lang.alias("lang"), host.alias("source"))


def _suffix(host: Column) -> Column:
    last = F.element_at(F.split(host, r"\."), -1)
    return F.when(host.contains("."), last).otherwise(F.lit(""))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source") -> DataFrame:
    """One row per row of docs: doc_id, row_key, language, posterior, text_language, n_trigrams, reason,
    rejected.

    row_key, a hash of id and text, tells rows with a null id apart. Null and empty texts, and texts without letters, are
    rejected (reason no_text, language null). A null declaration or a null host says nothing. With no declared
    language at all every document is rejected, and an empty table gives no rows. Ties go to the language first in
    alphabetical order. Repeated rows are judged alike.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    text = F.col(text_col)
    declared = F.lower(F.regexp_extract(F.col(declared_col).cast("string"), r"^\s*([A-Za-z]{2,3})", 1)) if declared_col else F.lit(None).cast("string")
    host = F.lower(F.coalesce(F.col(host_col).cast("string"), F.lit(""))) if host_col else F.lit("")
    source = docs.withColumns({"__declared": declared, "__host": host})
    counts = source.where(text.isNotNull()).groupBy("__declared").count()
    counts = counts.where("__declared <> ''").orderBy(F.desc("count"), "__declared").limit(MOST_LANGUAGES + 1).collect()
    languages = sorted(r[0] for r in counts[:MOST_LANGUAGES] if r["count"] >= LEAST_DOCUMENTS and r[0] != UNDETERMINED)
    own = F.col("__declared").isin(languages)
    if len(languages) < len(counts):
        languages.append(UNDETERMINED)
    # what a document declares, of the languages with models
    source = source.withColumn("__group", F.when(own, F.col("__declared")).when(F.col("__declared") != "", UNDETERMINED))
    k = len(languages)
    # trigram counts by declared language: a model of k times FEATURES numbers, for any corpus
    model = np.zeros((max(k, 1), FEATURES))
    if k:
        sums = source.select("__group", text).mapInArrow(_count(languages), "language int, feature int, n long").groupBy("language", "feature").agg(F.sum("n").alias("n")).toPandas()
        model[sums["language"].to_numpy(), sums["feature"].to_numpy()] = sums["n"].to_numpy()
    logp = np.log((model + 0.5) / (model.sum(axis=1, keepdims=True) + 0.5 * FEATURES)).astype(np.float32)
    narrow = source.select(*([F.col(id_col).alias("__id"), "__declared", "__group", "__host", text.alias("__text")]))
    narrow = narrow.withColumn("__key", F.xxhash64("__id", "__text"))
    schema = f"__id {dict(docs.dtypes)[id_col]}, __declared string, __group string, __host string, __key long, n_trigrams long, gain double, text_log array<double>"
    seen = narrow.select("__id", "__declared", "__group", "__host", "__key", "__text").mapInArrow(_likelihoods(logp), schema)
    names = F.array(*[F.lit(x) for x in languages]) if k else F.array().cast("array<string>")
    best = F.when((F.col("n_trigrams") > 0) & (F.lit(k) > 0), F.element_at(names, F.array_position("text_log", F.array_max("text_log")).cast("int")))
    seen = scratch.cache(seen.withColumn("text_language", best).withColumn("suffix", _suffix(F.col("__host"))))

    # priors: corpus -> suffix -> host
    known = seen.where(F.col("text_language").isNotNull())
    corpus = {r[0]: r[1] for r in known.groupBy("text_language").count().collect()}  # at most k rows
    total = sum(corpus.values())
    base = [(corpus.get(x, 0) + 1.0) / (total + k) for x in languages]
    tally = [F.sum(F.when(F.col("text_language") == x, 1.0).otherwise(0.0)) for x in languages]
    counted = known.groupBy("__host", "suffix").agg(F.array(*tally).alias("c") if k else F.array().cast("array<double>").alias("c"))
    prior0 = F.array(*[F.lit(x) for x in base]) if k else F.array().cast("array<double>")

    def smooth(own: Column, above: Column, pull: float) -> Column:
        n = F.aggregate(own, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(own, above, lambda c, p: (c + pull * p) / (n + pull))

    by_suffix = counted.groupBy("suffix").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(k)]).alias("cs") if k else F.array().cast("array<double>").alias("cs"))
    by_suffix = by_suffix.select("suffix", smooth(F.col("cs"), prior0, SUFFIX_PULL).alias("ps"))
    by_host = scratch.keep(counted.join(by_suffix, "suffix").select("__host", smooth(F.col("c"), F.col("ps"), HOST_PULL).alias("prior")))
    # declarations: P(declared | language), from texts that the trigrams decide
    pairs = known.groupBy("text_language", "__group").count().where("__group is not null").collect() if k else []  # at most k * k rows
    said = {(r[0], r[1]): r[2] for r in pairs}
    of = {x: sum(said.get((x, d), 0) for d in languages) for x in languages}
    entries = []
    for d in languages:
        logs = [math.log((said.get((x, d), 0) + DECLARED_PULL / k) / (of[x] + DECLARED_PULL)) for x in languages]
        entries += [F.lit(d), F.array(*[F.lit(v) for v in logs])]
    flat = F.array(*[F.lit(0.0) for _ in languages]) if k else F.array().cast("array<double>")
    spoken = F.coalesce(F.try_element_at(F.create_map(*entries), F.col("__group")), flat) if entries else flat

    joined = seen.join(broadcast_if_few(by_host, PRIORS // max(k, 1)), "__host", "left").withColumn("prior", F.coalesce("prior", prior0)).withColumn("said", spoken)
    logs = F.zip_with(F.zip_with("text_log", "said", lambda a, b: a + b), F.col("prior"), lambda a, p: a + F.log(p))
    joined = joined.withColumn("log", logs).withColumn("top", F.array_max("log"))
    mass = F.aggregate(F.transform("log", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    joined = joined.withColumn("posterior", F.when(F.col("text_language").isNotNull(), 1 / mass))
    lang = F.when(F.col("text_language").isNotNull(), F.element_at(names, F.array_position("log", F.col("top")).cast("int")))
    lang = F.when((lang == UNDETERMINED) & (F.col("__group") == UNDETERMINED), F.col("__declared")).otherwise(lang)
    reason = F.when(F.col("n_trigrams") == 0, "no_text").when(F.col("text_language").isNull(), "no_model").when(F.col("gain") < LEAST_GAIN, "no_language").when(F.col("posterior") < LEAST_POSTERIOR, "unsure")
    out = joined.select(F.col("__id").alias("doc_id"), F.col("__key").alias("row_key"), lang.alias("language"), "posterior", "text_language", "n_trigrams", reason.alias("reason"))
    return out.withColumn("rejected", F.col("reason").isNotNull())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "language", F.round("posterior", 6).alias("posterior"), "text_language", "n_trigrams", "rejected", "reason")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as they were.

    Null and empty texts and those without letters go; rows with a null id are judged like any other, and repeated rows stay or
    go together. A null language or source says nothing. An empty table stays empty.
    """
    found = identify(docs)
    bad = Scratch(spark).keep(found.where("rejected").select(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key")).distinct())
    bad = broadcast_if_few(bad)
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__doc"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == bad["__key"]), "left_anti")
