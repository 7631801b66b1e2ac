"""Stance trends over time: volumes, closed-form kernel regression, and fitters by group."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.functions.labels import stance_score
from opinara.operators.reshape import daily_spine, explode_pairs, grouping_explode
from opinara.plans import fitters
from opinara.storage import shared, tasks

GROUP = ("target", "filter_type", "filter_value")
#: Hours of a unit of a time scale; months are 30 days, years 365. Fixed values.
UNIT_HOURS = {"h": 1, "d": 24, "w": 168, "mo": 720, "y": 8760}


def scale_hours(time_scale: str) -> int:
    m = re.fullmatch(r"(\d+)(h|d|w|mo|y)", time_scale)
    if not m:
        raise ValueError(f"unknown time scale {time_scale!r}")
    return int(m[1]) * UNIT_HOURS[m[2]]


def time_units(ts: Column, start: Column, time_scale: str) -> Column:
    """Whole hours since midnight of ``start``, in units of the scale."""
    return F.timestamp_diff("HOUR", start.cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / F.lit(float(scale_hours(time_scale)))


def document_to_targets(df: DataFrame, min_count: int = 5, time_column: str = "createtime", target_type: str = "noun-phrases") -> DataFrame:
    """Long rows with a score for targets found in more than ``min_count`` rows."""
    rows = explode_pairs(df).where(F.col("Target").isNotNull())
    often = rows.groupBy("Target").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_count).select("Target")
    kept = rows.join(often, "Target", "left_semi").withColumn("stance_score", stance_score(F.col("Stance"), target_type))
    return kept.withColumnRenamed(time_column, "createtime")


def grouped(long: DataFrame, filters: dict[str, str], min_filter_count: int = 5) -> DataFrame:
    """(target, filter_type, filter_value, createtime, y) for groups of at least ``min_filter_count`` rows."""
    rows = grouping_explode(long, filters).select(*GROUP, "createtime", "y")
    big = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_filter_count).drop("_n")
    return rows.join(big, list(GROUP), "left_semi")


def spans_of(groups: DataFrame) -> DataFrame:
    return groups.groupBy(*GROUP).agg(F.min(F.to_date("createtime")).alias("d0"), F.max(F.to_date("createtime")).alias("d1"))


def daily_volume(groups: DataFrame) -> DataFrame:
    """(group, day, volume): a row for each day of a group's span, 0 where nothing happened."""
    days = daily_spine(spans_of(groups)).select(*GROUP, "day")
    counts = groups.groupBy(*GROUP, F.to_date("createtime").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, [*GROUP, "day"], "left").select(*GROUP, "day", F.coalesce("n", F.lit(0)).cast("long").alias("volume"))


#: Beyond so many bandwidths a Gaussian weight is lost in the rounding of a double.
REACH = 9.0


def trend_kernelreg(groups: DataFrame, bandwidth: float, time_scale: str = "1d") -> DataFrame:
    """Gaussian local-linear regression in closed form, on each day of a group's span, clipped to [-1, 1].

    Observations of one hour are summed first and written: the kernel depends on the hour alone. Hours and days of a
    group meet where they are at most :data:`REACH` bandwidths apart, by a join on stretches of that length; so the work grows with the span.
    """
    hours = scale_hours(time_scale)
    bins = shared(hourly(groups, time_scale).select(*GROUP, "d0", "d1", "x", "w", "sy"))
    spans = bins.groupBy(*GROUP).agg(F.first("d0").alias("d0"), F.first("d1").alias("d1"))
    h = float(bandwidth)
    reach = REACH * h
    days = daily_spine(spans).withColumn("t", F.datediff("day", "d0") * F.lit(24.0) / hours).withColumn("part", F.floor(F.col("t") / reach))
    near = bins.withColumn("part", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda k: F.floor(F.col("x") / reach) + k)))
    u = F.col("x") - F.col("t")
    k = F.exp(-(u * u) / (2 * h * h)) / (math.sqrt(2 * math.pi) * h)
    met = days.join(near.drop("d0"), [*GROUP, "part"]).where(F.abs(u) <= reach)
    s = met.groupBy(*GROUP, "day").agg(
        F.sum(k * F.col("w")).alias("s0"), F.sum(k * u * F.col("w")).alias("s1"), F.sum(k * u * u * F.col("w")).alias("s2"), F.sum(k * F.col("sy")).alias("v0"), F.sum(k * u * F.col("sy")).alias("v1")
    )
    n = bins.groupBy(*GROUP).agg(F.sum("w").alias("n"))
    c = lambda name: F.col(name) / F.col("n")
    det = c("s0") * c("s2") - c("s1") * c("s1")
    mean = F.when(F.abs(det) > 1e-10, (c("s2") * c("v0") - c("s1") * c("v1")) / det).otherwise(0.0)
    trend = s.join(n, list(GROUP)).select(*GROUP, "day", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)).alias("trend_mean"))
    # a bin's hours since the first midnight give its day
    volume = bins.groupBy(*GROUP, F.date_add("d0", F.floor(F.col("x") * hours / 24 + 1e-9).cast("int")).alias("day")).agg(F.sum("w").alias("volume"))
    return days.select(*GROUP, "day").join(volume, [*GROUP, "day"], "left").join(trend, [*GROUP, "day"], "left").select(*GROUP, "day", F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.coalesce("trend_mean", F.lit(0.0)).alias("trend_mean"))


def trend_rolling(groups: DataFrame, days: int = 7) -> DataFrame:
    """Centred rolling mean of daily mean stances over ``days`` rows; null in groups with fewer."""
    daily = groups.groupBy(*GROUP, F.to_date("createtime").alias("day")).agg(F.avg("y").alias("m"))
    w = Window.partitionBy(*GROUP).orderBy("day").rowsBetween(-(days // 2), days // 2)
    n = F.count(F.lit(1)).over(Window.partitionBy(*GROUP))
    return daily.select(*GROUP, "day", F.when(n >= days, F.avg("m").over(w)).alias("trend_mean"))


def hourly(groups: DataFrame, time_scale: str) -> DataFrame:
    """(group, d0, d1, x, w, sy, n_neg, n_pos): sums by hour, made before anything is joined; x is the hour in units of the scale since the group's first midnight."""
    hour = F.date_trunc("hour", F.col("createtime")).cast("timestamp_ntz")
    sums = groups.groupBy(*GROUP, hour.alias("createtime")).agg(
        F.count(F.lit(1)).alias("w"), F.sum("y").alias("sy"), F.count_if(F.col("y") < 0).alias("n_neg"), F.count_if(F.col("y") > 0).alias("n_pos")
    )
    bins = shared(sums)
    x = time_units(F.col("createtime"), F.col("d0"), time_scale)
    return bins.join(spans_of(bins), list(GROUP)).select(*GROUP, "d0", "d1", x.alias("x"), "w", "sy", "n_neg", "n_pos")


def trend_fit(groups: DataFrame, method: str, time_scale: str = "1d", **kw) -> DataFrame:
    """Trends by a fitter of :mod:`opinara.plans.fitters`.

    Observations are summed by hour first, so a group's size is bounded by the calendar and
    not by its rows; all bins are fitted, at a cost that grows with their number (for kernels, inducing points bound the solves). Small groups are fitted many
    at a time. A fit that fails gives one row with its error instead of failing the job.
    """
    run = fitters.batch_runner(method, scale_hours(time_scale), kw)
    schema = "target string, filter_type string, filter_value string, day date, trend_mean double, trend_lower double, trend_upper double, params string, error string"
    bins = hourly(groups, time_scale)
    return bins.repartition(tasks(bins), *GROUP).sortWithinPartitions(*GROUP, "x").mapInArrow(run, schema)


def fit_params(trend: DataFrame) -> DataFrame:
    """(group, method parameters as a map): one row for each fitted group of :func:`trend_fit`."""
    one = trend.where("params IS NOT NULL").groupBy(*GROUP).agg(F.first("params").alias("p"))
    return one.select(*GROUP, F.from_json("p", "map<string,double>").alias("params"))


def stance_normal(groups: DataFrame) -> DataFrame:
    """Location and variance of each group's stances under the classifier's error model."""
    counts = groups.groupBy(*GROUP).agg(F.count_if(F.col("y") < 0).alias("n_neg"), F.count_if(F.col("y") == 0).alias("n_zero"), F.count_if(F.col("y") > 0).alias("n_pos"))

    @F.pandas_udf("stance_loc double, stance_var double")
    def fit(neg, zero, pos):
        return fitters.static_normal(neg, zero, pos)

    return counts.select(*GROUP, fit("n_neg", "n_zero", "n_pos").alias("f")).select(*GROUP, "f.*")


def infer_stance_trends(
    document_df: DataFrame, time_column: str = "createtime", target_type: str = "noun-phrases", filter_columns: tuple[str, ...] = (), min_count: int = 5, time_scale: str = "1mo", method: str = "gp", **kw
) -> DataFrame:
    """Trends of all targets of ``Targets``/``Stances`` documents, overall and for each filter value."""
    long = document_to_targets(document_df, min_count, time_column, target_type).select(F.col("Target").alias("target"), "createtime", F.col("stance_score").alias("y"), *filter_columns)
    groups = grouped(long, {c: c for c in filter_columns}, min_count)
    return trend_fit(groups, method, time_scale, **kw)


def interpolated(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """``rows`` with gaps in ``value`` (null or NaN) filled on a line between the rows before and after, by place in ``order``; at the ends the nearest value holds. All gaps stay null."""
    w = Window.partitionBy(*by).orderBy(order)
    clean = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    at = rows.withColumn("_i", F.row_number().over(w)).withColumn("_k", F.when(clean.isNotNull(), F.struct(F.col("_i").alias("i"), clean.alias("v"))))
    before = F.last("_k", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_k", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    near = at.withColumns({"_a": before, "_b": after})
    a, b = F.col("_a"), F.col("_b")
    line = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / (b["i"] - a["i"])
    filled = F.when(a.isNull(), b["v"]).when(b.isNull() | (a["i"] == b["i"]), a["v"]).otherwise(line)
    return near.withColumn(value, filled).drop("_i", "_k", "_a", "_b")
