"""Live bars that late trades update for ever: a table of mergeable parts of bars, no watermark.

Every micro-batch appends what its trades add to each one-minute bar (first and last trade by order, extremes, sums). A
bar of any length is the merger of its parts, so it does not matter in which batch, or in which order, a trade came.
Now and then the parts appended since are folded into a base by day; only days that got any are written anew.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickbars.functions import bar_window, event_order, minutes, ntz, time_bucket
from tickbars.operators.bars import finish_bars
from tickbars.session import exists, remove
from tickbars.streaming.state import BatchFn, Versions

KEYS = ("Symbol", "Timestamp")
_PART = """Symbol STRING, Timestamp TIMESTAMP_NTZ, first_at DECIMAL(38,0), last_at DECIMAL(38,0), Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE,
    Volume DOUBLE, Trades BIGINT, BuyerMakerCount BIGINT, pq DOUBLE, newest TIMESTAMP_NTZ, first_batch BIGINT, last_batch BIGINT"""
#: Batches whose parts are read one by one before they are folded.
FOLD_EVERY = 16


def bar_parts(trades: DataFrame, batch_id: int) -> DataFrame:
    """What the trades of a batch add to each one-minute bar; clock rows give parts without a symbol."""
    at = event_order(F.col("Timestamp"), F.coalesce("TradeID", F.lit(0)))
    parts = trades.groupBy("Symbol", bar_window(F.col("Timestamp"), 1).alias("_bar")).agg(
        F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.min_by("Price", at).alias("Open"), F.max("Price").alias("High"),
        F.min("Price").alias("Low"), F.max_by("Price", at).alias("Close"), F.sum("Quantity").alias("Volume"), F.count(F.lit(1)).alias("Trades"),
        F.sum(F.col("IsBuyerMaker").cast("int")).cast("bigint").alias("BuyerMakerCount"), F.sum(F.col("Price") * F.col("Quantity")).alias("pq"),
        F.max("Timestamp").cast("timestamp_ntz").alias("newest"))
    return parts.withColumns({"Timestamp": F.col("_bar").cast("timestamp_ntz"), "first_at": F.col("first_at").cast("decimal(38,0)"),
                              "last_at": F.col("last_at").cast("decimal(38,0)"), "first_batch": F.lit(batch_id).cast("bigint"),
                              "last_batch": F.lit(batch_id).cast("bigint")}).drop("_bar")


def merged_parts(parts: DataFrame, period_minutes: int = 1) -> DataFrame:
    """One part per symbol and period."""
    return parts.groupBy("Symbol", time_bucket(F.col("Timestamp"), period_minutes).alias("_bar")).agg(
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("Open", "first_at").alias("Open"), F.max("High").alias("High"),
        F.min("Low").alias("Low"), F.max_by("Close", "last_at").alias("Close"), F.sum("Volume").alias("Volume"), F.sum("Trades").alias("Trades"),
        F.sum("BuyerMakerCount").alias("BuyerMakerCount"), F.sum("pq").alias("pq"), F.max("newest").alias("newest"),
        F.min("first_batch").alias("first_batch"), F.max("last_batch").alias("last_batch")).withColumnRenamed("_bar", "Timestamp")


class LiveBars:
    """The table of parts below a folder, and the batch functions that keep it.

    ``delay`` says how long after its end, by the newest time of the feed, a bar counts as closed. It decides only when
    a bar is first reported: later trades still change it, and it is reported again.
    """

    def __init__(self, path: str, delay: str = "1 minute", fold_every: int = FOLD_EVERY) -> None:
        self.path, self.delay, self.fold_every = path, F.expr(f"INTERVAL {delay}"), fold_every
        self._newest = Versions(f"{path}/newest")

    # Reading

    def _deltas(self, spark: SparkSession, first: int, end: int | None) -> DataFrame:
        rows = spark.read.schema(f"{_PART}, batch_id BIGINT").parquet(f"{self.path}/deltas").filter((F.col("batch_id") >= first) & F.col("Symbol").isNotNull())
        return (rows if end is None else rows.filter(F.col("batch_id") < end)).drop("batch_id")

    def _days(self, spark: SparkSession, fold: int) -> DataFrame:
        """Which fold holds each day, as of a fold."""
        return spark.read.parquet(f"{self.path}/manifest/as_of={fold}")

    def _last_fold(self, spark: SparkSession) -> int:
        if not exists(spark, f"{self.path}/manifest"):
            return 0
        return spark.read.parquet(f"{self.path}/manifest").agg(F.max("as_of")).first()[0] or 0

    def _base(self, spark: SparkSession, days: DataFrame) -> DataFrame:
        rows = spark.read.schema(f"{_PART}, fold INT, day DATE").parquet(f"{self.path}/days")
        return rows.join(days, ["fold", "day"], "left_semi").drop("fold", "day")

    def _parts(self, spark: SparkSession, batch_id: int | None = None) -> DataFrame:
        """All parts up to a batch, or those of all batches so far."""
        fold = self._last_fold(spark) if batch_id is None else batch_id // self.fold_every * self.fold_every
        recent = self._deltas(spark, fold, None if batch_id is None else batch_id + 1)
        return self._base(spark, self._days(spark, fold)).unionByName(recent) if fold else recent

    def bars(self, spark: SparkSession, period_minutes: int = 1) -> DataFrame:
        """All bars as they are now, open ones too."""
        return self._shown(self._parts(spark), period_minutes)

    def _shown(self, parts: DataFrame, period_minutes: int, others: tuple[str, ...] = ()) -> DataFrame:
        return finish_bars(merged_parts(parts, period_minutes).withColumnRenamed("pq", "_pq"), period_minutes, others)

    # Writing

    def _fold(self, spark: SparkSession, batch_id: int) -> None:
        """Fold the batches before this one into the base. The manifest comes last: without it nothing has changed."""
        before = batch_id - self.fold_every
        if exists(spark, f"{self.path}/manifest/as_of={batch_id}/_SUCCESS"):
            return
        recent = self._deltas(spark, before, batch_id).withColumn("day", F.to_date("Timestamp"))
        touched = recent.select("day").distinct()
        days = self._days(spark, before) if before else spark.createDataFrame([], "day DATE, fold INT")
        old = self._base(spark, days.join(touched, "day", "left_semi")).withColumn("day", F.to_date("Timestamp")) if before else recent.limit(0)
        merged_parts(old.unionByName(recent).drop("day")).withColumn("day", F.to_date("Timestamp")) \
            .repartitionByRange("day", *KEYS).write.mode("overwrite").partitionBy("day").parquet(f"{self.path}/days/fold={batch_id}")
        now = touched.withColumn("fold", F.lit(batch_id))
        days.select("day", "fold").join(touched, "day", "left_anti").unionByName(now).write.mode("overwrite").parquet(f"{self.path}/manifest/as_of={batch_id}")
        self._clear(spark, batch_id)

    def _clear(self, spark: SparkSession, fold: int) -> None:
        """Remove what no fold but those before the last one needs; whoever reads by the last one still may."""
        last, first = fold - self.fold_every, fold - 2 * self.fold_every
        for b in range(max(first, 0), last):
            remove(spark, f"{self.path}/deltas/batch_id={b}")
        if first > 0:
            for day, old in self._days(spark, first).select("day", "fold").exceptAll(self._days(spark, last).select("day", "fold")).collect():  # days of one fold
                remove(spark, f"{self.path}/days/fold={old}/day={day}")
            remove(spark, f"{self.path}/manifest/as_of={first}")

    def batch(self, period_minutes: int = 1, on_changed: BatchFn | None = None, on_closed: BatchFn | None = None) -> BatchFn:
        """A ``foreachBatch`` function over trades, with clock rows (nothing but a time) among them if need be.

        ``on_changed`` gets every bar the batch touched, as it is now, with the first and the last batch that did.
        ``on_closed`` gets the bars that closed, and those closed before that late trades have changed. A batch that is
        run again gives the same.
        """
        def run(trades: DataFrame, batch_id: int) -> None:
            spark = trades.sparkSession
            if batch_id and batch_id % self.fold_every == 0:
                self._fold(spark, batch_id)
            here = f"{self.path}/deltas/batch_id={batch_id}"
            bar_parts(trades, batch_id).write.mode("overwrite").parquet(here)
            own = spark.read.schema(_PART).parquet(here)
            before = self._newest.before(spark, batch_id)
            now = own.agg(F.max("newest").alias("newest"))
            self._newest.write(now if before is None else now.unionByName(before).agg(F.max("newest").alias("newest")), batch_id)

            bucket = time_bucket(F.col("Timestamp"), period_minutes)
            touched = own.filter(F.col("Symbol").isNotNull()).select("Symbol", bucket.alias("_bucket")).distinct()
            parts = self._parts(spark, batch_id)
            again = parts.withColumn("_bucket", bucket).join(touched, ["Symbol", "_bucket"], "left_semi").drop("_bucket")
            if on_changed:
                on_changed(self._shown(again, period_minutes, ("first_batch", "last_batch")), batch_id)
            if on_closed:
                then = before.first()[0] if before is not None else None
                on_closed(self._closed(parts, again, period_minutes, then, self._newest.at(spark, batch_id).first()[0]), batch_id)
        return run

    def _closed(self, parts: DataFrame, again: DataFrame, period_minutes: int, then: datetime | None, now: datetime | None) -> DataFrame:
        """Bars that ended between two times of the feed, and those of ``again`` that had ended before."""
        def ended(at: datetime | None) -> Column:
            return F.lit(False) if at is None else F.col("Timestamp") + minutes(period_minutes) <= ntz(at) - self.delay

        def may_end_after(at: datetime | None) -> Column:  # on parts, so that files of older bars are skipped
            return F.lit(True) if at is None else F.col("Timestamp") >= ntz(at) - self.delay - minutes(period_minutes)

        new = self._shown(parts.filter(may_end_after(then)), period_minutes).filter(ended(now) & ~ended(then))
        return new.unionByName(self._shown(again, period_minutes).filter(ended(then)))
