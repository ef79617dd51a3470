"""What the operators share: shared-folder tables, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, and the similarity of near duplicates, unless a contract says otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.75

#: Rows and bytes of an Arrow batch at most: whole texts can be long, and a batch stands in memory several times.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}
#: Ids up to which a set of them is sent to all executors; larger ones are joined by a shuffle.
BROADCAST_IDS = 500_000

#: Edges that one task unites in memory.
TASK_EDGES = 250_000

_fallback: list[str] = []
#: The list that collecting() gathers new Scratches in, if any.
_collector: ContextVar[list[Scratch] | None] = ContextVar("collector", default=None)


@contextmanager
def collecting() -> Iterator[list[Scratch]]:
    """Gathers the Scratches that are made within, for a caller that frees them once it has written what was built with them."""
    made: list[Scratch] = []
    token = _collector.set(made)
    try:
        yield made
    finally:
        _collector.reset(token)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written or collected within frees the files of its shuffles when it ends, not when the driver next collects garbage.

    For results that nothing else shares shuffles with, and that don't need them again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="papyra-"))
    return f"file://{_fallback[0]}"


class Scratch:
    """Intermediate results of one operator.

    keep() and cache() hold a result that several later steps read on the executors' disks, with its lineage, so that what a
    lost executor held is worked out again. What a Scratch holds is its own until free(). After keep() later plans begin at the result anew, as plans that hold plans grow
    with each step; cache() is for results that come straight from a scan. write() cuts lineage too, for steps that repeat: a
    table in the shared folder.
    """

    def __init__(self, spark: SparkSession):
        for key, most in ARROW_BATCH.items():
            spark.conf.set(key, str(most))
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/papyra-{uuid.uuid4().hex}", 0
        self.held: list[DataFrame] = []
        self.tables: set[str] = set()
        made = _collector.get()
        if made is not None:
            made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        rows = self.cache(df)._jdf.queryExecution().toRdd()
        return DataFrame(self.spark._jsparkSession.internalCreateDataFrame(rows, df._jdf.schema(), False), self.spark)

    def cache(self, df: DataFrame) -> DataFrame:
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.tables.add(path)
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete what write() made and nothing later reads."""
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path in self.tables:
                self.tables.remove(path)
                _delete(self.spark, path)

    def free(self) -> None:
        """Let go of all that this Scratch holds; what was built with it can't be read any more."""
        while self.held:
            self.held.pop().unpersist()
        while self.tables:
            _delete(self.spark, self.tables.pop())


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z only; words are runs without \\x20 and \\x09-\\x0D. bytes.split and bytes.lower do exactly that."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(h: np.ndarray) -> np.ndarray:
    """The finaliser of a well-known 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_POSITION = odd_constants(64, 20240229)


def word_hashes(words: list[bytes]) -> np.ndarray:
    f = xxhash.xxh3_64_intdigest
    return np.fromiter((f(w) for w in words), dtype=np.uint64, count=len(words))


def shingle_hashes(hashes: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit hashes of the k-word shingles in order; with fewer words, the whole sequence as one."""
    n = len(hashes)
    if n == 0:
        return hashes
    if n < k:
        return mix64((hashes * _POSITION[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    out = np.zeros(n - k + 1, dtype=np.uint64)
    for j in range(k):
        out += hashes[j : n - k + 1 + j] * _POSITION[j]
    return mix64(out + np.uint64(k))


def shingle_set(text: str | None, k: int = SHINGLE_WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(ascii_words(text)), k))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of 64-bit numbers, the first of which rises: its steps, and all byte planes one after the other, compressed."""
    cols = [np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in cols)
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int, k: int) -> np.ndarray:
    """What pack() packed, as k rows of n 64-bit numbers."""
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=8 * n * k, codec="zstd", asbytes=True), dtype=np.uint8)
    out = planes.reshape(k, 8, n).transpose(0, 2, 1).copy(order="C").view(np.int64).reshape(k, n)
    out[0] = np.cumsum(out[0])
    return out


def broadcast_if_few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A broadcast hint if df, which is counted, has few rows of a few bytes each."""
    return F.broadcast(df) if df.count() <= most else df


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest id of each of their components."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(parent.setdefault(u, u)), root(parent.setdefault(v, v))
            if a != b:
                parent[max(a, b)] = min(a, b)
    rows = [(x, root(x)) for x in parent]
    rows = [r for r in rows if r[0] != r[1]]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])


def components(edges: DataFrame, scratch: Scratch, task_edges: int = TASK_EDGES) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component_id), the smallest id reachable, for every id in an edge.

    Each task reduces TASK_EDGES edges or so to stars. One task's stars are the answer; those of several are joined by
    alternating large-star and small-star steps, each an aggregation and a join by node, so that no component is ever
    gathered in one place and the number of steps is logarithmic. Self-loops and repeated edges are fine.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    tasks = -(-scratch.keep(e).count() // task_edges)
    e = scratch.keep(e.coalesce(max(tasks, 1)).mapInArrow(_forest, "u long, v long").distinct())
    state = None
    while tasks > 1:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = scratch.write(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.write(small)
        scratch.drop(e, large)
        e, before = small, state
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            break
    rows = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    return rows.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component_id"))).groupBy("id").agg(F.min("component_id").alias("component_id"))
