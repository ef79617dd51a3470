"""Verdicts over a stream of pages, whose documents may arrive apart. An extension: nothing above depends on it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import DataType, StructType

from papyra.operators.classify import RULES, Rule, Rules
from papyra.operators.compare import compare_records
from papyra.operators.primary import primary_pages
from papyra.operators.secondary import secondary_pages

SCHEMA = "case_id string, role string, page_number int, full_text string, mrz_text string, arrived timestamp"
ROLES = ("primary", "secondary")
#: What the state tells of a case: its best page of each role, how often that was told before, and whether it is the last word.
TOLD = "case_id string, primary string, secondary string, revision int, final boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_pages(spark: SparkSession, path: str, late: str = "1 hour", files: int | None = None) -> DataFrame:
    """Pages from a folder of JSON files, each page once within the time that pages may be late. files: most for a batch."""
    reader = spark.readStream.schema(SCHEMA)
    pages = (reader.option("maxFilesPerTrigger", files) if files else reader).json(path).withWatermark("arrived", late)
    return pages.dropDuplicatesWithinWatermark(["case_id", "role", "page_number"])


class BestPages(StatefulProcessor):
    """For each case the best page of each role, until time is up.

    The highest score wins, of equal ones the lowest page. A case is told as soon as both roles are there, and again when a better
    page comes. `wait` milliseconds after its first page the case is told for the last time if it never was complete, and
    forgotten. Pages repeated or worse change nothing.
    """

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "role string", "page int, score int, record string")
        self.told = handle.getValueState("told", "times int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        changed = False
        for batch in rows:
            if not self.best.exists():
                first = int(batch["arrived"].min().timestamp() * 1000)
                self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.wait)
            for role, page, score, record in batch[["role", "page_number", "score", "record"]].itertuples(index=False):
                had = self.best.getValue((role,)) if self.best.containsKey((role,)) else None
                if had is None or (-score, page) < (-had[1], had[0]):
                    self.best.updateValue((role,), (int(page), int(score), record))
                    changed = True
        if changed and all(self.best.containsKey((r,)) for r in ROLES):
            yield self._tell(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if not self.told.exists():
            yield self._tell(key, True)
        self.best.clear()
        self.told.clear()

    def _tell(self, key, final: bool) -> pd.DataFrame:
        times = self.told.get()[0] + 1 if self.told.exists() else 1
        self.told.update((times,))
        records = [self.best.getValue((r,))[2] if self.best.containsKey((r,)) else None for r in ROLES]
        return pd.DataFrame({"case_id": [key[0]], "primary": [records[0]], "secondary": [records[1]], "revision": [times], "final": [final]})

    def close(self) -> None:
        pass


def _record_type(frame: DataFrame) -> DataType:
    return frame.schema["record"].dataType


def scored_pages(pages: DataFrame, as_of: dt.date, rules: Rules | tuple[Rule, ...] = RULES) -> tuple[DataFrame, StructType, StructType]:
    """Each page's score and record (JSON), by its own role, and the types of both kinds of records. Nothing is held for this:
    they follow from the page alone."""
    carry = ["case_id", "role", "page_number", "arrived", "score", "record"]
    one = primary_pages(pages.where(F.col("role") == "primary"), as_of)
    two = secondary_pages(pages.where(F.col("role") == "secondary"), rules)
    as_json = lambda df: df.select(*[F.to_json("record", {"ignoreNullFields": "false"}).alias("record") if c == "record" else F.col(c) for c in carry])
    return as_json(one).unionByName(as_json(two)), _record_type(one), _record_type(two)


def milliseconds(wait: str) -> int:
    """A time as in `1 hour`."""
    return int(pd.Timedelta(wait).total_seconds() * 1000)


def verdicts_of(told: DataFrame, one: DataType, two: DataType, as_of: dt.date) -> DataFrame:
    """Verdicts of what BestPages told: case_id, revision, complete, decision, riskLevel, score, reason, fields, alerts.

    A case without both documents when its time was up has no decision; reason says which one is missing.
    """
    pairs = told.select("case_id", "revision", F.from_json("primary", one).alias("primary"), F.from_json("secondary", two).alias("secondary"))
    complete = F.col("primary").isNotNull() & F.col("secondary").isNotNull()
    judged = compare_records(pairs.withColumn("complete", complete), as_of)
    missing = F.concat(F.when(F.col("primary").isNull(), "primary").otherwise("secondary"), F.lit(" document did not arrive"))
    if_complete = lambda c: F.when(F.col("complete"), F.col(c)).alias(c)
    reason: Column = F.when(F.col("complete"), F.col("reason")).otherwise(missing).alias("reason")
    return judged.select("case_id", "revision", "complete", if_complete("decision"), if_complete("riskLevel"), if_complete("score"), reason, if_complete("fields"), if_complete("alerts"))


def verify_stream(pages: DataFrame, as_of: dt.date, sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None, wait: str = "1 hour", rules: Rules | tuple[Rule, ...] = RULES) -> StreamingQuery:
    """Verdicts to sink, batch by batch, of pages with a watermark on `arrived`.

    A case's documents may come in any batches: the best page of each role is kept for `wait` after its first page. Revisions
    count a case's verdicts; the last one counts.
    """
    spark = pages.sparkSession
    scored, one, two = scored_pages(pages, as_of, rules)
    told = scored.groupBy("case_id").transformWithStateInPandas(BestPages(milliseconds(wait)), TOLD, "Append", "EventTime")

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # the state's answers, which the sink may read more than once
        try:
            sink(verdicts_of(batch, one, two, as_of), number)
        finally:
            batch.unpersist()

    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)  # keyed state with timers needs it; a query keeps what it was started with
    try:
        return told.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(_PROVIDER, before)


def join_streams(primary: DataFrame, secondary: DataFrame, within: str = "1 hour") -> DataFrame:
    """Both documents of a case that arrive within a time of each other: two streams of records with watermarks on `arrived`."""
    a, b = primary.alias("a"), secondary.alias("b")
    near = (F.col("a.case_id") == F.col("b.case_id")) & (F.col("b.arrived") >= F.col("a.arrived") - F.expr(f"interval {within}")) & (F.col("b.arrived") <= F.col("a.arrived") + F.expr(f"interval {within}"))
    return a.join(b, near, "inner")
