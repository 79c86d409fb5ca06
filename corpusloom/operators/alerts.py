"""Roll-ups and alert expressions over event tables: rates, quantiles, ratios and conditions that last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queue depth and how long it must last: thirty minutes, as the rule is described; a parameter.
QUEUE_DEPTH, QUEUE_MINUTES = 500, 30


def usage_daily(events: DataFrame, tenant: str, at: str, **sums: Column) -> DataFrame:
    """Sums by tenant and UTC day."""
    return events.groupBy(F.col(tenant), F.to_date(at).alias("day")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def usage_window(usage: DataFrame, first: str, last: str) -> DataFrame:
    """Days between two, both included, newest first."""
    return usage.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy(F.desc("day"))


def sliding(events: DataFrame, at: str, width: str, slide: str, *by: str) -> DataFrame:
    """Events in each window of ``width`` that starts every ``slide``: start, keys and n."""
    return events.groupBy(F.window(at, width, slide).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def sliding_rate(events: DataFrame, at: str, minutes: int = 5, slide: str = "1 minute", *by: str) -> DataFrame:
    """Events a second over sliding minutes."""
    return sliding(events, at, f"{minutes} minutes", slide, *by).withColumn("rate", F.col("n") / F.lit(60.0 * minutes))


def quantile(events: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """Exact interpolated quantile."""
    return events.groupBy(*by).agg(F.percentile(value, F.lit(q)).alias("quantile"))


def bucket_quantile(buckets: DataFrame, q: float, by: list[str], le: str = "le", count: str = "count") -> DataFrame:
    """A quantile from cumulative histogram buckets, interpolated within the bucket it falls in; the last finite bound if that
    is the open one."""
    w = Window.partitionBy(*by).orderBy(le)
    rows = buckets.withColumns({"_low": F.coalesce(F.lag(le).over(w), F.lit(0.0)), "_before": F.coalesce(F.lag(count).over(w), F.lit(0)), "_all": F.max(count).over(Window.partitionBy(*by))})
    hit = rows.where((F.col(count) >= q * F.col("_all")) & (F.col("_all") > 0)).groupBy(*by).agg(F.min_by(F.struct(le, "_low", "_before", count, "_all"), le).alias("b"))
    inside = F.col("b._low") + (F.col(f"b.{le}") - F.col("b._low")) * F.try_divide(q * F.col("b._all") - F.col("b._before"), F.col(f"b.{count}") - F.col("b._before"))
    return hit.select(*by, F.when(F.col(f"b.{le}") == float("inf"), F.col("b._low")).otherwise(inside).alias("quantile"))


def share_daily(events: DataFrame, at: str, part: Column) -> DataFrame:
    """day, share of events that are ``part``, and drop, how much less than the day before's."""
    days = events.groupBy(F.to_date(at).alias("day")).agg((F.count_if(part) / F.count("*")).alias("share"))
    # one row a day reaches the window
    before = F.lag(F.struct("day", "share")).over(Window.orderBy("day"))
    return days.withColumn("_b", before).select("day", "share", F.when(F.col("_b.day") == F.date_sub("day", 1), F.col("_b.share") - F.col("share")).alias("drop"))


def error_ratio(events: DataFrame, at: str, minutes: int, failed: Column, *by: str) -> DataFrame:
    """Share of failures in tumbling windows; the denominator is at least 1e-9."""
    w = F.window(at, f"{minutes} minutes").alias("w")
    rows = events.groupBy(w, *by).agg(F.count_if(failed).alias("failed"), F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("start"), *by, "failed", "n", (F.col("failed") / F.greatest(F.col("n").cast("double"), F.lit(1e-9))).alias("ratio"))


def sustained(samples: DataFrame, at: str, holds: Column, minutes: int = QUEUE_MINUTES, by: list[str] | None = None) -> DataFrame:
    """Runs of samples in which a condition holds without a break, from the first to the last, of at least ``minutes``: keys,
    since, until, minutes. Gaps and islands: a run is what lies between two samples where it does not hold.

    Samples go by day, so that one long series is many tasks' work; only the days' runs are then put together in order.
    """
    by = by or []
    day = Window.partitionBy(*by, "_day")
    so_far = day.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = F.when(F.col("_h"), 0).otherwise(1)
    rows = samples.withColumns({"_h": F.coalesce(holds, F.lit(False)), "_day": F.to_date(at)})
    rows = rows.withColumns({"_run": F.sum(broken).over(so_far), "_breaks": F.sum(broken).over(day)})
    own = F.when(F.col("_h"), F.col(at))
    # a run within a day, and whether it reaches the day's first and last sample; where nothing holds, a row without a run
    pieces = rows.groupBy(*by, "_day", "_run").agg(F.min(own).alias("since"), F.max(own).alias("until"), F.first("_breaks").alias("_breaks"))
    pieces = pieces.where(F.col("since").isNotNull() | (F.col("_run") == F.col("_breaks")))
    order = Window.partitionBy(*by).orderBy("_day", "_run")
    goes_on = F.lag((F.col("_run") == F.col("_breaks")) & F.col("since").isNotNull()).over(order) & (F.col("_run") == 0)
    joined = pieces.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    runs = joined.where("since is not null").groupBy(*by, "_run").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_run")
    return runs.withColumn("minutes", F.timestamp_diff("MINUTE", F.col("since"), F.col("until"))).where(F.col("minutes") >= minutes)


def reuse_ratio(runs: DataFrame, *by: str) -> DataFrame:
    """Chunks reused among those reused or written."""
    return runs.groupBy(*by).agg(F.try_divide(F.sum("reused").cast("double"), F.sum(F.col("reused") + F.col("written")).cast("double")).alias("ratio"))
