"""MinHash near-dedup by min-max hashing (operator 10).

Every permutation keeps its minimum and its maximum over a document's shingles, so 48 hash evaluations a shingle give 96
signature values. Four values (two permutations) make a band; documents that share a band meet in its bucket. At a
similarity of 0.75 a band agrees with probability 0.75^4, and all 24 bands miss with probability 0.0001.

Documents with one and the same shingle set are collapsed first and only the smallest doc_id goes on. Buckets are never
expanded into all pairs: first every member is compared with its bucket's smallest, then, in buckets whose members are
still in different components, members of different components are compared. A task holds a bucket's shingle sets, or those of two blocks
of a large bucket, tells by signature which pairs may be links, confirms them on the full sets, and passes on only links that
join components: never more than it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, Scratch, ascii_words, broadcast_if_few, components, is_empty, mix64, odd_constants, shingle_hashes, table, word_hashes

PERMUTATIONS = 48
BANDS = 24
#: Signature agreement below which a pair at the similarity wanted is all but impossible (under one in ten thousand).
MARGIN = 0.17
#: Shingles of a bucket's members that one task holds at a time (eight bytes each), twice for two blocks.
BLOCK_SHINGLES = 2_000_000

_MULTIPLY = odd_constants(PERMUTATIONS, 7)
_ADD = odd_constants(PERMUTATIONS, 8)

_SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>, sig binary"


def signatures(shingles: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, for each slice of shingles that begins at starts: (slices, 2 * PERMUTATIONS)."""
    out = np.empty((len(starts), 2 * PERMUTATIONS), dtype=np.uint64)
    for k in range(PERMUTATIONS):
        x = shingles * _MULTIPLY[k] + _ADD[k]
        out[:, 2 * k] = np.minimum.reduceat(x, starts)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(word_hashes(ascii_words(t)), words)) for t in part.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                keys, bands, sigs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if len(full):
                    starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                    sig = signatures(np.concatenate([sets[i] for i in full]), starts)
                    width = 2 * PERMUTATIONS // BANDS
                    band = np.zeros((len(full), BANDS), dtype=np.uint64)
                    for j in range(width):
                        band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + mix64(sig[:, j::width]))
                    band = mix64(band + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                    small = (mix64(sig) & np.uint64(0xFFFF)).astype(np.uint16)
                    for n, i in enumerate(full):
                        keys[i], bands[i], sigs[i] = xxhash.xxh3_128_digest(sets[i].tobytes()), band[n].tolist(), small[n].tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "bands", "sig"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [np.unique(shingle_hashes(word_hashes(ascii_words(t)), words)).astype(np.int64) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))], names=["id", "shingles"])

    return run


def _across(similarity: float, percent: int):
    """Of the members of one bucket, or of two blocks of it: links that join components, confirmed on the full sets."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        ids, block, lo, hi = pdf["id"].to_numpy(), pdf["block"].to_numpy(), pdf["lo"].iat[0], pdf["hi"].iat[0]
        comp = np.unique(pdf["comp"].to_numpy(), return_inverse=True)[1]
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint16).reshape(len(pdf), -1)
        sets = [np.ascontiguousarray(x, dtype=np.int64).view(np.uint64) for x in pdf["shingles"]]  # sorted as unsigned
        sizes = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        need = (similarity - MARGIN) * sig.shape[1]
        got_a, got_b = [], []
        for i in left:
            other = right[(comp[right] != comp[i]) & ((right > i) if lo == hi else True)]
            if len(other):
                other = other[(sig[other] == sig[i]).sum(axis=1) >= need]
            if not len(other):
                continue
            flat = np.concatenate([sets[j] for j in other])
            at = np.minimum(np.searchsorted(sets[i], flat), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[other])[:-1]]))
            for j in other[100 * both >= percent * (sizes[i] + sizes[other] - both)]:
                if comp[i] != comp[j]:
                    comp[comp == comp[j]] = comp[i]
                    got_a.append(ids[i])
                    got_b.append(ids[j])
        a, b = np.array(got_a, dtype=np.int64), np.array(got_b, dtype=np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return run


def _alike(similarity: float):
    least = (similarity - MARGIN) * 2 * PERMUTATIONS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            fit = pa.array((x == y).sum(axis=1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(fit), batch.column(1).filter(fit)], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * intersection >= percent * union of their shingle sets. Null and empty texts and
    texts without words have no shingles: they are their own component and are kept. Rows with a null id are linked with
    nothing, have a null component and are kept. Rows that share an id count as one document. Only id_col and text_col
    are read, so further columns don't matter.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    similarity = percent / 100
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = scratch.cache(docs.mapInArrow(_sketch(words), _SKETCH))
    named = sketch.where("set_key is not null and doc_id is not null")
    keys = scratch.keep(named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.min("doc_id").alias("id")))
    # one row for each set; a row's own id keeps its bands
    firsts = named.join(keys.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key"])
    firsts = scratch.keep(firsts.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sig"))
    member = firsts.select("id", "n_shingles", F.explode("bands").alias("bucket"))
    head = member.groupBy("bucket").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch.keep(member.join(head, "bucket"))
    star = buckets.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    sigs = firsts.select("id", "sig")

    active = scratch.keep(buckets.select(F.col("id").alias("doc_id")).distinct())
    text = docs.join(broadcast_if_few(active), "doc_id", "left_semi")
    sets = scratch.keep(text.mapInArrow(_sets(words), "id long, shingles array<long>"))

    def alike(pairs: DataFrame) -> DataFrame:
        x = sigs.select(F.col("id").alias("a"), F.col("sig").alias("x"))
        y = sigs.select(F.col("id").alias("b"), F.col("sig").alias("y"))
        return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_alike(similarity), "a long, b long")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
        both = pairs.join(y, "b").join(x, "a")
        both = both.withColumn("i", F.size(F.array_intersect("x", "y"))).withColumn("u", F.size("x") + F.size("y") - F.col("i"))
        return both.where(100 * F.col("i") >= percent * F.col("u")).select("a", "b").distinct()

    edges = scratch.keep(confirmed(scratch.keep(alike(star))))
    labels = components(edges, scratch)
    now = buckets.where("n > 2").join(labels, "id", "left").withColumn("comp", F.coalesce("component_id", "id")).select("bucket", "id", "comp", "n_shingles")
    mixed = now.groupBy("bucket").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.sum("n_shingles").alias("all")).where("c0 < c1")
    mixed = scratch.keep(mixed.select("bucket", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("blocks")))
    if not is_empty(mixed):
        now = now.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        now = now.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        now = now.select("bucket", "lo", "hi", "id", "comp", "block").join(sigs, "id").join(sets, "id")
        more = scratch.keep(now.groupBy("bucket", "lo", "hi").applyInPandas(_across(similarity, percent), "a long, b long").distinct())
        if not is_empty(more):
            edges = scratch.keep(edges.unionByName(more))
            labels = components(edges, scratch)
    final = keys.join(labels, keys["id"] == labels["id"], "left").select("set_key", F.coalesce("component_id", "rep").alias("component_id"))
    # rows without a set get keys of their own, so that they don't meet in one task
    own = F.coalesce("set_key", F.encode(F.concat(F.lit("-"), F.xxhash64("doc_id").cast("string")), "utf-8"))
    out = sketch.select("doc_id", "n_shingles", own.alias("set_key")).join(final, "set_key", "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, with its columns as they were.

    Rows without an id or without words stay; of rows that share an id, those with the smallest id of their group stay.
    """
    found = near_duplicates(docs)
    gone = broadcast_if_few(Scratch(spark).keep(found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()))
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


OP10_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
r AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT r.id, l.b FROM r JOIN l ON r.r = l.a),
c AS (SELECT id, min(r) AS component_id FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept FROM s JOIN c ON c.id = s.doc_id
"""
