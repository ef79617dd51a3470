"""Quality classifier (operator 2).

Statistics of a whole text are standardised and mapped to random Fourier features, which approximate a Gaussian kernel.
Tasks sum the normal equations of their rows, the sums meet in one, and ridge weights follow. The ridge scores are then made
probabilities by isotonic regression over training rows that the weights were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_few, table

#: Random Fourier features, ridge penalty for each training row, and the kernel's width in standard deviations.
FEATURES, RIDGE, WIDTH = 256, 1e-3, 4.0
SEED = 11
#: Training rows at most (a sample by hash beyond), in so many tasks; and one in HOLD of them calibrates.
TRAIN_ROWS, TASKS, HOLD = 400_000, 8, 5

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "most_frequent_word", "repeated_neighbour", "distinct_pairs",
    "upper", "digit", "space", "ascii_punctuation", "sentence_marks", "odd_symbols", "non_ascii", "byte_entropy",
    "line_words", "distinct_lines", "capitalised_words", "words_with_letters", "marked_word_ends", "longest_word",
)

_CLASS = np.zeros(256, dtype=np.int64)
for _b in range(256):
    _CLASS[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b in (32, *range(9, 14)) else 4 if _b in b".,;:?'\"-()" else 5 if _b < 128 and not chr(_b).isalnum() else 6 if _b >= 128 else 0


def statistics(text: str | None) -> list[float]:
    """The figures named in STATISTICS; for a null, empty or blank text all those about words are 0."""
    b = (text or "").encode("utf-8", "surrogatepass")
    raw = np.bincount(np.frombuffer(b, dtype=np.uint8), minlength=256)
    n = max(len(b), 1)
    cls = np.bincount(_CLASS, weights=raw, minlength=7) / n
    p = raw[raw > 0] / n
    words = b.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ids = {}
    numbers = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    most = np.bincount(numbers).max() if len(words) else 0
    pairs = numbers[:-1] * (len(ids) + 1) + numbers[1:]
    lines = [x for x in b.split(b"\n") if x.strip()]
    last = np.fromiter((w[-1] for w in words), dtype=np.int64, count=len(words))
    first = np.fromiter((w[0] for w in words), dtype=np.int64, count=len(words))
    return [
        np.log1p(len(b)), np.log1p(len(words)), lengths.mean() if len(words) else 0, lengths.std() if len(words) else 0, len(ids) / k, most / k,
        float((numbers[:-1] == numbers[1:]).sum()) / k, len(np.unique(pairs)) / max(len(pairs), 1) if len(pairs) else 0,
        cls[1], cls[2], cls[3], cls[4] + cls[5], cls[4], cls[5], cls[6], float(-(p * np.log2(p)).sum()),
        np.log1p(len(words) / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), float((_CLASS[first] == 1).sum()) / k,
        float(np.isin(_CLASS[first], (0, 1, 6)).sum()) / k, float((_CLASS[last] == 5).sum()) / k, np.log1p(lengths.max()) if len(words) else 0,
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last column: the text; the others pass through."""
    for batch in batches:
        rows = [statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        flat = pa.array(np.asarray(rows, dtype=np.float64).ravel())
        stats = pa.FixedSizeListArray.from_arrays(flat, len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), stats], names=[*batch.schema.names[:-1], "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


class Classifier:
    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        self.w = rng.normal(0, 1 / WIDTH, (len(mean), FEATURES))
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights = np.zeros(FEATURES + 1)
        self.knots, self.values = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), self.knots, self.values), 0.0, 1.0)


def _normal_equations(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = FEATURES + 1
        xx, xy, n = np.zeros((d, d)), np.zeros(d), 0
        for batch in batches:
            x, y = model.features(_matrix(batch.column(1))), np.asarray(batch.column(0), dtype=np.float64)
            xx, xy, n = xx + x.T @ x, xy + x.T @ y, n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([xx.tobytes()], pa.binary()), pa.array([xy.tobytes()], pa.binary())], names=["n", "xx", "xy"])

    return run


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y by x (pool adjacent violators); equal x are pooled first. Means are drawn a little
    to one half, as by one row of either label, so that no score is certain."""
    keys, inverse, n = np.unique(x, return_inverse=True, return_counts=True)
    s = np.bincount(inverse, weights=y)
    blocks: list[list[float]] = []  # first x, last x, sum, rows
    for k, total, m in zip(keys, s, n):
        blocks.append([k, k, total, m])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0], last[1], blocks[-1][2] + last[2], blocks[-1][3] + last[3]]
    knots, values = [], []
    for a, b, total, m in blocks:
        v = (total + 1) / (m + 2)
        knots += [a, b]
        values += [v, v]
    return np.array(knots) + np.arange(len(knots)) * 1e-12, np.maximum.accumulate(np.array(values))


def _apply(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = _matrix(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(model.score(stats), pa.float64())], names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels of rows whose crc32(id as text) mod folds is fold are never learned from; other labels that are 0 or 1 are, and
    all else is ignored, as are ids with both labels. Without two labels to learn from every score is 0.5. Null, empty and
    very long texts are scored like any other; a null id is held out. Repeated rows get equal scores and are learned from as
    often as they occur.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark)
    kind = dict(docs.dtypes)[id_col]
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    stats = scratch.cache(source.mapInArrow(_statistics, f"doc_id {kind}, stats array<double>"))
    code = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = F.coalesce(code % folds == fold, F.lit(True))
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").where(~held)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    n = known.count()
    if n > TRAIN_ROWS:  # a bounded sample, the same for the same labels
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * TRAIN_ROWS * 0.99 / n))
    rows = scratch.keep(stats.join(known if n > TRAIN_ROWS else broadcast_if_few(known, TRAIN_ROWS), "doc_id").select(F.col("y").cast("double").alias("y"), "stats", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HOLD)) == 0).alias("calibrates")).repartition(TASKS))
    width = len(STATISTICS)
    sums = rows.agg(F.count("*").alias("n"), F.array(*[F.avg(F.col("stats")[i]) for i in range(width)]).alias("mean"), F.array(*[F.stddev_pop(F.col("stats")[i]) for i in range(width)]).alias("sd"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    model = Classifier(np.array(sums["mean"] if sums["n"] else [0.0] * width, dtype=float), np.array(sums["sd"] if sums["n"] else [1.0] * width, dtype=float))
    if sums["n"] and sums["lo"] != sums["hi"]:
        parts = rows.where("not calibrates").select("y", "stats").mapInArrow(_normal_equations(model), "n long, xx binary, xy binary").collect()  # TASKS rows of half a MB
        d = FEATURES + 1
        xx, xy, m = sum(np.frombuffer(p["xx"]).reshape(d, d) for p in parts), sum(np.frombuffer(p["xy"]) for p in parts), sum(p["n"] for p in parts)
        penalty = RIDGE * max(m, 1) / FEATURES * np.eye(d)
        penalty[-1, -1] = 1e-9
        model.weights = np.linalg.solve(xx + penalty, xy)
        calibration = rows.where("calibrates").select("y", "stats").toPandas()  # bounded by TRAIN_ROWS / HOLD
        if len(calibration):
            model.knots, model.values = isotonic(model.ridge(np.array(calibration["stats"].tolist())), calibration["y"].to_numpy())
    scored = stats.mapInArrow(_apply(model), f"doc_id {kind}, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
