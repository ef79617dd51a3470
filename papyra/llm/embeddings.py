"""Embedding near-dedup with a random-projection tree forest (operator 3).

Vectors of a label form the root of each tree. A node with too many vectors is split by random directions at the median of a
bounded sample of its own vectors; vectors close to the split go to both sides (spill). Splits are fitted by executors and
stay with their node, so that neither the number of labels nor of leaves matters to the driver. Vectors that share a leaf in
any tree are compared by their exact cosine, in blocks where a leaf can't be split further, and links are united.

A pair can meet in several leaves. It counts in the first of those that both are in, which the leaf's task tells from the lists
of leaves that vectors carry: so links are counted and united without a row for each of them, however large a cluster is.

The number of trees follows from how close together a label's vectors are: the closer, the likelier a split parts a pair.

Identical vectors are collapsed first: one of them takes part, and the others share its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_few, components, table

COSINE = 0.93
#: Vectors of a leaf wanted, and at most before it is split again; vectors of a block of a leaf that can't be split.
LEAF, MOST_LEAF, BLOCK = 400, 1200, 1200
#: Vectors of a node that its splits are fitted on, and levels that one round adds.
FIT, LEVELS = 2048, 6
#: Spill on each side of a split, as a share of the spread of projections of pairs at the cosine wanted.
SPILL = 0.5
#: The miss allowed, over all trees, for a pair at the cosine wanted.
MISS = 1e-4
ROUNDS = 12


def _directions(tree: int, turn: int, dim: int) -> np.ndarray:
    d = np.random.default_rng([tree, turn, 17]).standard_normal(((1 << LEVELS) - 1, dim))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column: vectors, as the bytes of their unit vectors in double precision; the others pass through."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        flat, ends = np.asarray(column.flatten(), dtype=np.float64), np.asarray(column.offsets)
        out = []
        for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0]):
            x = flat[a:b]
            with np.errstate(over="ignore", under="ignore"):
                norm = np.linalg.norm(x)
            if not 1e-100 < norm < 1e100:  # its square has left the range of numbers
                x = x / np.abs(x).max()
                norm = np.linalg.norm(x)
            out.append((x / norm).tobytes())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(out, pa.binary())], names=batch.schema.names)


def _unit(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def _spill(dim: int, cosine: float) -> float:
    """Of pairs at the cosine wanted the projections differ by this share of their usual difference."""
    return SPILL * math.sqrt(2 * (1 - cosine) / dim)


def _fit(turn: int, cosine: float):
    """The thresholds of a node's splits, level by level: its sample is split in the same way as its vectors will be."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n = _unit(pdf["embedding"]), int(pdf["n"].iat[0])
        tree = int(pdf["tree"].iat[0])
        levels = min(LEVELS, max(1, math.ceil(math.log2(n / LEAF))))
        d, margin = _directions(tree, turn, x.shape[1]), _spill(x.shape[1], cosine)
        at = np.full((1 << LEVELS) - 1, np.nan)
        rows = {0: np.arange(len(x))}
        for node in range((1 << levels) - 1):
            here = rows.pop(node, np.empty(0, dtype=int))
            if len(here) < 16:
                continue
            p = x[here] @ d[node]
            at[node] = np.median(p)
            rows[2 * node + 1], rows[2 * node + 2] = here[p <= at[node] + margin], here[p > at[node] - margin]
        return pd.DataFrame({"label": [pdf["label"].iat[0]], "tree": [tree], "leaf": [pdf["leaf"].iat[0]], "at": [at.tolist()]})

    return run


def _route(turn: int, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            has = pdf["at"].notna().to_numpy()
            out = [pdf.loc[~has, ["label", "tree", "leaf", "id", "embedding"]]]
            for (tree, leaf, _label), part in pdf[has].groupby(["tree", "leaf", "label"], sort=False):
                x = _unit(part["embedding"])
                at = np.asarray(part["at"].iat[0], dtype=np.float64)
                d, margin = _directions(int(tree), turn, x.shape[1]), _spill(x.shape[1], cosine)
                todo = [(0, np.arange(len(x)))]
                while todo:
                    node, here = todo.pop()
                    if node >= len(at) or np.isnan(at[node]):
                        end = part.iloc[here][["label", "tree", "leaf", "id", "embedding"]].copy()
                        end["leaf"] = (int(leaf) * 127 + node + 1) % (1 << 62)
                        out.append(end)
                        continue
                    p = x[here] @ d[node]
                    for child, side in ((2 * node + 1, here[p <= at[node] + margin]), (2 * node + 2, here[p > at[node] - margin])):
                        if len(side):
                            todo.append((child, side))
            yield pd.concat(out)

    return run


def _earlier(places: list[np.ndarray], here: int) -> np.ndarray:
    """Which of the leaves before this one, of those that two vectors at least are in, each vector is in."""
    before = [p[p < here] for p in places]
    rows = np.repeat(np.arange(len(before)), [len(p) for p in before])
    _, column, times = np.unique(np.concatenate(before) if before else np.empty(0, dtype=np.int64), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(times > 1)
    at = np.full(len(times), -1)
    at[shared] = np.arange(len(shared))
    out = np.zeros((len(before), len(shared)), dtype=np.float32)
    keep = at[column] >= 0
    out[rows[keep], at[column[keep]]] = 1
    return out


def _links(cosine: float):
    """Of a leaf, or of two blocks of it: each vector's new links, weighed by copies, and the smallest id it is linked to here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, block = _unit(pdf["embedding"]), pdf["block"].to_numpy()
        lo, hi, here = pdf["lo"].iat[0], pdf["hi"].iat[0], int(pdf["place"].iat[0])
        left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        near = x[left] @ x[right].T >= cosine
        if lo == hi:
            np.fill_diagonal(near, False)
        left, right, near = left[near.any(axis=1)], right[near.any(axis=0)], near[near.any(axis=1)][:, near.any(axis=0)]
        every = np.union1d(left, right)
        if not len(every):
            return pd.DataFrame({"id": [], "n": [], "root": []}, dtype="int64")
        ids, copies = pdf["id"].to_numpy()[every], pdf["copies"].to_numpy()[every]
        i, j = np.searchsorted(every, left), np.searchsorted(every, right)
        seen = _earlier([np.asarray(p) for p in pdf["places"].iloc[every]], here)
        first = near & (seen[i] @ seen[j].T == 0)
        n, root = np.zeros(len(every), dtype=np.int64), ids.copy()
        n[i] += first @ copies[j]
        if lo != hi:
            n[j] += first.T @ copies[i]
        most = np.iinfo(np.int64).max
        while True:  # the smallest id spreads along links
            new = root.copy()
            new[i] = np.minimum(new[i], np.where(near, root[j][None, :], most).min(axis=1))
            new[j] = np.minimum(new[j], np.where(near, new[i][:, None], most).min(axis=0))
            if (new == root).all():
                return pd.DataFrame({"id": ids, "n": n, "root": root})
            root = new

    return run


def kept_together(cosine: float, mean: float) -> float:
    """Chance that one split leaves a pair at a cosine together, among vectors whose mean cosine is given.

    Along a random direction a pair's middle and its half difference are normal, with variances in the proportion of
    1 + cosine - 2 * mean to 1 - cosine; the pair is parted if its middle is nearer to the split than half the difference
    less the spill. Summed over a grid of half differences.
    """
    half = math.sqrt((1 - cosine) / 2)
    middle = math.sqrt(max(1 + cosine - 2 * mean, 1e-9) / 2)
    grid = np.linspace(0, 6, 601)[1:]
    weight = np.exp(-grid * grid / 2)
    reach = np.maximum(grid * half - SPILL * 2 * half, 0) / middle
    parted = np.array([math.erf(r / math.sqrt(2)) for r in reach])
    return float(1 - (weight * parted).sum() / weight.sum())


def _mean_cosine(pdf: pd.DataFrame) -> pd.DataFrame:
    mean = _unit(pdf["embedding"]).mean(axis=0)
    return pd.DataFrame({"label": [pdf["label"].iat[0]], "mean": [float(mean @ mean)]})


def trees_for(most: int, kept: float) -> int:
    """Trees that bring the chance to miss a pair at the cosine wanted under MISS, for so many vectors under one label."""
    levels = max(0, math.ceil(math.log2(max(most, 1) / LEAF)))
    together = kept**levels
    return 1 if levels == 0 else max(2, math.ceil(math.log(MISS) / math.log(1 - together)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only vectors with equal labels that are not null are compared, and of equal dimension. Vectors that are null, empty, zero
    or hold null or non-finite components link with nothing, nor do rows with a null id, whose component is null; all these
    are kept. Rows that repeat an id and its vector are one vector; rows that share an id and have different vectors share the
    most links and the smallest component of them. Components so large or small that their squares leave the range of numbers
    are scaled. An empty table gives no rows. Only the three columns named are read.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark)
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding"), F.col(label_col).alias("raw_label"))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    valid = rows.where(F.col("embedding").isNotNull() & F.col("raw_label").isNotNull() & F.col("vec_id").isNotNull()).where(good)
    label = F.concat_ws(":", F.col("raw_label").cast("string"), F.size("embedding").cast("string"))
    valid = valid.select("vec_id", "embedding", label.alias("label")).withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.xxhash64(F.lit(1), "embedding", "label"))
    groups = valid.groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.countDistinct("vec_id").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    groups = scratch.keep(groups.select("k1", "k2", "id", "copies", "label", "embedding").mapInArrow(_packed, "k1 long, k2 long, id long, copies long, label string, embedding binary"))
    of_label = scratch.cache(groups.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > LEAF))
    most = of_label.agg(F.max("n")).first()[0] or 0
    share = F.least(F.lit(1.0), F.lit(float(FIT)) / F.col("n"))
    sample = groups.join(of_label, "label").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20))
    mean = sample.select("label", "embedding").groupBy("label").applyInPandas(_mean_cosine, "label string, mean double").agg(F.max("mean")).first()[0] or 0.0
    trees = trees_for(most, kept_together(cosine, min(mean, cosine)))
    leaf = groups.select("label", F.explode(F.array(*[F.lit(t) for t in range(trees)])).alias("tree"), F.lit(0).cast("long").alias("leaf"), "id", "embedding")
    held = None
    for turn in range(ROUNDS):
        counts = leaf.groupBy("label", "tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > MOST_LEAF)
        counts = scratch.keep(counts)
        inside = counts.agg(F.sum("n")).first()[0] or 0
        if not inside or (held is not None and inside > 0.9 * held):
            break
        held = inside
        share = F.least(F.lit(1.0), F.lit(float(FIT)) / F.col("n"))
        sample = leaf.join(counts, ["label", "tree", "leaf"]).where(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(1 << 20)) < share * (1 << 20))
        plans = scratch.keep(sample.groupBy("label", "tree", "leaf").applyInPandas(_fit(turn, cosine), "label string, tree int, leaf long, at array<double>"))
        routed = leaf.join(plans, ["label", "tree", "leaf"], "left").select("label", "tree", "leaf", "id", "embedding", "at")
        old, leaf = leaf, scratch.write(routed.mapInPandas(_route(turn, cosine), "label string, tree int, leaf long, id long, embedding binary"))
        scratch.drop(old)
    place = leaf.select("id", F.xxhash64("label", "tree", "leaf").alias("place"))
    large = scratch.cache(place.groupBy("place").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK))
    held_by = place.groupBy("id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    spread = groups.select("id", "copies", "embedding").join(held_by, "id").withColumn("place", F.explode("places"))
    spread = spread.join(broadcast_if_few(large), "place", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("int"))
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).select("place", "lo", "hi", "block", "id", "copies", "places", "embedding")
    met = scratch.cache(spread.groupBy("place", "lo", "hi").applyInPandas(_links(cosine), "id long, n long, root long"))
    labels = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch)
    linked = met.groupBy("id").agg(F.sum("n").alias("more"))
    of_group = groups.select("k1", "k2", "id", "copies").join(linked, "id", "left").join(labels, "id", "left")
    of_group = of_group.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n"), F.coalesce("component_id", "id").alias("c"))
    found = valid.select("vec_id", "k1", "k2").join(of_group, ["k1", "k2"]).groupBy("vec_id").agg(F.max("n").alias("n"), F.min("c").alias("c"))
    out = rows.select("vec_id").join(found, "vec_id", "left")
    comp = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP3_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT DISTINCT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT r.id, l.b FROM r JOIN l ON r.r = l.a),
c AS (SELECT id, min(r) AS component_id FROM r GROUP BY id)
SELECT x.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, x.vec_id = c.component_id AS kept FROM embeddings x LEFT JOIN n ON n.a = x.vec_id JOIN c ON c.id = x.vec_id
"""
