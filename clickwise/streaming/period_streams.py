"""Rules over consecutive periods on streams (G5, G6): a bounded tail per series is carried.

Two kinds of tail, both written per batch id, so a replayed batch reads what
stood before it:

* a ring of period values (E2, E5, E7, D8): each batch is aggregated per
  series and period, added to the carried periods, and the rule is judged
  again from the first period the batch changed. Only the last periods that
  a rule reaches back to, plus the allowed lateness, are kept.
* raw counter samples (E3, E4): an increase needs the sample before, so the
  last samples of each series are kept, and one older as a baseline.

Rows older than the allowed lateness change nothing; they are written to
``late``. A period that later batches change again is written again: of the
rows of a key, the newest batch holds (``latest_rows``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickwise.operators import monitoring as M
from clickwise.streaming.runners import _batch_dir, latest_state, trigger


def latest_rows(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """Of the rows written for a key, those of the newest batch."""
    df = spark.read.parquet(root).withColumn("batch_id", F.col("batch_id").cast("long"))
    cols = [c for c in df.columns if c not in (*keys, "batch_id")]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])


def _seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n).cast("decimal(18,6)"))


@dataclass(frozen=True)
class PeriodRule:
    """A rule over periods.

    ``partial`` gives (series..., period_start, values...) of some rows;
    ``add`` says how the values of two such frames combine; ``judge`` turns
    periods into results with time column ``result_col``. A result reaches
    ``reach`` periods back (``behind`` of them may start before the changed one).
    """

    series: list[str]
    period_seconds: int
    reach: int
    partial: Callable[[DataFrame], DataFrame]
    add: dict[str, Callable]
    judge: Callable[[DataFrame], DataFrame]
    result_col: str = "period_start"
    behind: int = 0


def alarm_rule(series: list[str], ts_col: str, value_col: str, stat: str, op: str, threshold: float, periods: int,
               period_seconds: int = 60) -> PeriodRule:
    """E2, and E7 when ``value_col`` is the iterator age."""
    return PeriodRule(series, period_seconds, periods - 1,
                      lambda df: M.alarm_periods(df, series, ts_col, value_col, period_seconds),
                      {"max": F.max, "min": F.min, "sum": F.sum, "count": F.sum},
                      lambda p: M.alarm_states(p, series, stat, op, threshold, periods, period_seconds))


def quorum_rule(by: list[str], ts_col: str, period_seconds: int, status_col: str = "checker_status") -> PeriodRule:
    """D8; a gap is filled once the period after it arrives."""
    return PeriodRule(by, period_seconds, 0, lambda df: M.quorum_periods(df, by, ts_col, period_seconds, status_col),
                      {"checkers": F.sum, "healthy_checkers": F.sum}, lambda p: M.quorum_status(p, by, period_seconds))


def rate_rule(key_col: str, ts_col: str, limit: int = 2000, window_seconds: int = 300, slide_seconds: int = 30) -> PeriodRule:
    """E5; a slide counts in the windows that start up to a window before it."""
    n = window_seconds // slide_seconds
    return PeriodRule([key_col], slide_seconds, n - 1, lambda df: M.rate_slides(df, key_col, ts_col, slide_seconds),
                      {"requests": F.sum}, lambda p: M.rate_windows(p, key_col, limit, window_seconds, slide_seconds), "window_start", n - 1)


def _start(stream: DataFrame, run, checkpoint: str, test: bool):
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger(test)).start()


def start_period_stream(stream: DataFrame, rule: PeriodRule, state_root: str, out_root: str, checkpoint: str,
                        late_periods: int = 2, test: bool = False):
    """``rule`` over micro-batches; equals the batch operator on all rows but the late ones.

    ``out_root/results`` has the judged periods, ``out_root/late`` the period
    values of rows over ``late_periods`` behind their series' newest period.
    """
    s, size = rule.series, rule.period_seconds

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = rule.partial(batch)
        values = list(rule.add)
        ring = latest_state(spark, state_root, batch_id)
        if ring is None:
            ring = new.limit(0)
        marked = ring.select(*s, "period_start", *values, F.lit(False).alias("_new")).unionByName(
            new.select(*s, "period_start", *values, F.lit(True).alias("_new")))
        # A series' newest carried period closes those too far behind it; on its first batch nothing is late.
        newest = ring.groupBy(*s).agg(F.max("period_start").alias("_newest"))
        marked = marked.join(newest, s, "left")
        is_late = F.col("_new") & F.coalesce(F.col("period_start") < F.col("_newest") - _seconds(late_periods * size), F.lit(False))
        marked = marked.withColumn("_late", is_late).persist()
        try:
            late = marked.where("_late").select(*s, "period_start", *values)
            late.write.mode("overwrite").parquet(_batch_dir(f"{out_root}/late", batch_id))
            merged = marked.where("not _late").groupBy(*s, "period_start").agg(
                *[f(c).alias(c) for c, f in rule.add.items()], F.max("_new").alias("_new"), F.max("_newest").alias("_newest"))
            merged = merged.persist()
            # Judge again from the first changed period; filled gaps start right after the last one carried.
            first = merged.where("_new").groupBy(*s).agg(
                F.least(F.min("period_start"), F.max("_newest") + _seconds(size)).alias("_first"))
            judged = rule.judge(merged.select(*s, "period_start", *values))
            out = judged.join(first, s).where(F.col(rule.result_col) >= F.col("_first") - _seconds(rule.behind * size)).drop("_first")
            out.write.mode("overwrite").parquet(_batch_dir(f"{out_root}/results", batch_id))
            top = merged.groupBy(*s).agg(F.max("period_start").alias("_top"))
            keep = merged.join(top, s).where(F.col("period_start") >= F.col("_top") - _seconds((rule.reach + late_periods) * size))
            keep.select(*s, "period_start", *values).write.mode("overwrite").parquet(_batch_dir(state_root, batch_id))
            merged.unpersist()
        finally:
            marked.unpersist()
    return _start(stream, run, checkpoint, test)


def start_counter_stream(samples: DataFrame, judge: Callable[[DataFrame], DataFrame], group: list[str], series_col: str,
                         state_root: str, out_root: str, checkpoint: str, ts_col: str = "ts", value_col: str = "value",
                         period_seconds: int = 60, reach_periods: int = 10, late_periods: int = 2, test: bool = False):
    """E3 or E4 (``judge``) on cumulative samples ``(group..., series_col, ts, value)``.

    ``reach_periods`` is the trailing window plus the hold. The tail is cut
    by event time: per group all samples of the periods that a new sample
    can still reach, and of every series the last one before them, from
    which its next increase is counted.
    """
    cols = [*group, series_col, ts_col, value_col]

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tail = latest_state(spark, state_root, batch_id)
        new = batch.select(*cols)
        if tail is None:
            tail = new.limit(0)
        newest = tail.groupBy(*group).agg(F.max(M.period_start(F.col(ts_col), period_seconds)).alias("_newest"))
        marked = tail.select(*cols, F.lit(False).alias("_new")).unionByName(new.withColumn("_new", F.lit(True))).join(newest, group, "left")
        period = M.period_start(F.col(ts_col), period_seconds)
        is_late = F.col("_new") & F.coalesce(period < F.col("_newest") - _seconds(late_periods * period_seconds), F.lit(False))
        marked = marked.withColumn("_late", is_late).withColumn("_period", period).persist()
        try:
            marked.where("_late").select(*cols).write.mode("overwrite").parquet(_batch_dir(f"{out_root}/late", batch_id))
            rows = marked.where("not _late")
            first = rows.where("_new").groupBy(*group).agg(F.min("_period").alias("_first"))
            out = judge(rows.select(*cols)).join(first, group).where(F.col("period_start") >= F.col("_first")).drop("_first")
            out.write.mode("overwrite").parquet(_batch_dir(f"{out_root}/results", batch_id))
            edge = rows.groupBy(*group).agg((F.max("_period") - _seconds((reach_periods + late_periods) * period_seconds)).alias("_edge"))
            rows = rows.join(edge, group)
            fresh = rows.where(F.col("_period") >= F.col("_edge")).select(*cols)
            base = rows.where(F.col("_period") < F.col("_edge")).groupBy(*group, series_col).agg(
                F.max_by(F.struct(ts_col, value_col), ts_col).alias("_b")).select(*group, series_col, f"_b.{ts_col}", f"_b.{value_col}")
            fresh.unionByName(base).write.mode("overwrite").parquet(_batch_dir(state_root, batch_id))
        finally:
            marked.unpersist()
    return _start(samples, run, checkpoint, test)


def start_error_rate_stream(samples: DataFrame, group: list[str], state_root: str, out_root: str, checkpoint: str,
                            threshold: float = 0.05, window_periods: int = 5, hold_periods: int = 5, late_periods: int = 2, test: bool = False):
    """E3 on a stream of ``(group..., status_class, ts, value)``."""
    return start_counter_stream(
        samples, lambda df: M.error_rate_alert(df, group, threshold=threshold, window_periods=window_periods, hold_periods=hold_periods),
        group, "status_class", state_root, out_root, checkpoint, reach_periods=window_periods + hold_periods, late_periods=late_periods, test=test)


def start_latency_stream(samples: DataFrame, group: list[str], state_root: str, out_root: str, checkpoint: str,
                         threshold: float = 2.0, window_periods: int = 5, hold_periods: int = 5, late_periods: int = 2, test: bool = False):
    """E4 on a stream of ``(group..., le, ts, value)``."""
    return start_counter_stream(
        samples, lambda df: M.latency_alert(df, group, threshold=threshold, window_periods=window_periods, hold_periods=hold_periods),
        group, "le", state_root, out_root, checkpoint, reach_periods=window_periods + hold_periods, late_periods=late_periods, test=test)
