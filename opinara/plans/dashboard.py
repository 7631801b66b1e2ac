"""Dashboard and plot tables over long stance rows (target, createtime, author, y) and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_statistics(long: DataFrame, min_count: int = 20) -> DataFrame:
    y = F.col("y")
    g = long.groupBy("target").agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.avg(F.abs(y)).alias("mean_abs"),
        F.count_if(y == 1).alias("n_favor"), F.count_if(y == -1).alias("n_against"), F.count_if(y == 0).alias("n_neutral"),
    )
    return g.where(F.col("n") >= min_count)


def page(df: DataFrame, order: list, number: int, per_page: int) -> DataFrame:
    return df.orderBy(*order).offset(number * per_page).limit(per_page)


def text_search(targets: DataFrame, query: str, regex: bool = False) -> DataFrame:
    if not query.strip():
        return targets.where(F.lit(False))
    low = F.lower("target")
    return targets.where(low.rlike(query.lower()) if regex else F.contains(low, F.lit(query.lower())))


def trends_for(trend: DataFrame, target: str, filter_type: str = "all", values: list[str] | None = None) -> DataFrame:
    df = trend.where((F.col("target") == target) & (F.col("filter_type") == filter_type) & F.col("trend_mean").isNotNull() & ~F.isnan("trend_mean"))
    return df.where(F.col("filter_value").isin(values)) if values else df


def fill_bounds(trend: DataFrame) -> DataFrame:
    """Where all lower bounds of a series are NaN, bounds are the mean."""
    w = Window.partitionBy("target", "filter_type", "filter_value")
    none = F.bool_and(F.isnan("trend_lower")).over(w)
    return trend.withColumns({c: F.when(none, F.col("trend_mean")).otherwise(F.col(c)) for c in ("trend_lower", "trend_upper")})


def target_filters(trend: DataFrame) -> DataFrame:
    return trend.select("target", "filter_type", "filter_value").distinct()


def transitions(long: DataFrame, every_days: int, min_posts: int = 10, min_flow: int = 3) -> DataFrame:
    """How often authors' most frequent target changes from one overlapping window (two steps long) to the next."""
    busy = long.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_posts).select("author")
    step = F.floor(F.datediff(F.to_date("createtime"), F.lit("2000-01-01").cast("date")) / every_days).cast("long")
    first = long.agg(F.min(step).alias("_f"))
    rows = long.join(busy, "author", "left_semi").select("author", "target", F.explode(F.array(step, step - 1)).alias("w"))
    rows = rows.join(F.broadcast(first)).where("w >= _f")
    n = rows.groupBy("author", "w", "target").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("author", "w").agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("to_target"))
    lagged = top.withColumn("from_target", F.lag("to_target").over(Window.partitionBy("author").orderBy("w")))
    changed = lagged.where("from_target <> to_target").groupBy("w", "from_target", "to_target").agg(F.count(F.lit(1)).alias("transition_count"))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("w") * every_days).cast("int"))
    return changed.where(F.col("transition_count") >= min_flow).select(day.alias("createtime"), "from_target", "to_target", "transition_count")


def transitions_monthly(long: DataFrame, min_posts: int = 10, min_flow: int = 3) -> DataFrame:
    """:func:`transitions` between calendar windows of two months, one starting each month."""
    busy = long.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_posts).select("author")
    month = F.trunc("createtime", "month")
    first = long.agg(F.min(month).alias("_f"))
    rows = long.join(busy, "author", "left_semi").select("author", "target", F.explode(F.array(month, F.add_months(month, -1))).alias("w"))
    n = rows.join(F.broadcast(first)).where("w >= _f").groupBy("author", "w", "target").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("author", "w").agg(F.min_by("target", F.struct(-F.col("n"), "target")).alias("to_target"))
    lagged = top.withColumn("from_target", F.lag("to_target").over(Window.partitionBy("author").orderBy("w")))
    changed = lagged.where("from_target <> to_target").groupBy(F.col("w").alias("createtime"), "from_target", "to_target").agg(F.count(F.lit(1)).alias("transition_count"))
    return changed.where(F.col("transition_count") >= min_flow)


def stream_table(trend: DataFrame, targets: list[str]) -> DataFrame:
    """A row for each (filter_value, day), two columns for each target: mean and volume.

    A missing mean is the series' next one, else its last one, else the mean of the column; a missing volume is 0, and volumes are
    rolling means of three days, 0 where incomplete. A series has a row a day, so a window's partition is bounded by the calendar.
    """
    wide = trend.groupBy("filter_value", "day").pivot("target", targets).agg(F.first("trend_mean").alias("mean"), F.first("volume").alias("volume"))
    w = Window.partitionBy("filter_value").orderBy("day")
    ahead, behind, three = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-2, 0)
    c = lambda t, what: F.col(f"`{t}_{what}`")
    filled = wide.select("filter_value", "day", *[F.coalesce(F.first(c(t, "mean"), True).over(ahead), F.last(c(t, "mean"), True).over(behind)).alias(f"{t}_mean") for t in targets],
        *[F.when(F.count(F.lit(1)).over(three) == 3, F.avg(F.coalesce(c(t, "volume"), F.lit(0))).over(three)).otherwise(0.0).alias(f"{t}_volume") for t in targets])
    means = filled.agg(*[F.avg(c(t, "mean")).alias(f"_{i}") for i, t in enumerate(targets)])
    joined = filled.join(F.broadcast(means))  # one row
    return joined.select("filter_value", "day", *[F.coalesce(c(t, "mean"), F.col(f"_{i}"), F.lit(0.0)).alias(f"{t}_mean") for i, t in enumerate(targets)], *[c(t, "volume").alias(f"{t}_volume") for t in targets])


def stream_plot(trend: DataFrame, targets: list[str]) -> DataFrame:
    """(filter_value, day, year, x, y, u, v): two principal components of :func:`stream_table` and their change from day to day."""
    wide = stream_table(trend, targets)
    # columns are renamed: a target's name may hold a full stop
    names = [f"_c{i}" for i in range(2 * len(targets))]
    at = pca(wide.toDF("filter_value", "day", *names), names).select("filter_value", "day", F.col("components")[0].alias("x"), F.col("components")[1].alias("y"))
    flow = flow_field(at, "filter_value", "day")
    return flow.select("filter_value", "day", F.year("day").alias("year"), "x", "y", "u", "v")


def semantic_map(long: DataFrame, top: int = 30) -> DataFrame:
    g = long.groupBy("target").agg(F.avg("y").alias("mean_stance"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "target").limit(top)


def stream_features(trend: DataFrame, targets: list[str]) -> DataFrame:
    """A row for each (filter_value, day), columns for the targets: rolling means of three days, 0 where incomplete."""
    wide = trend.groupBy("filter_value", "day").pivot("target", targets).agg(F.first("trend_mean"))
    w = Window.partitionBy("filter_value").orderBy("day").rowsBetween(-2, 0)
    full = F.count(F.lit(1)).over(w) == 3
    return wide.select("filter_value", "day", *[F.when(full, F.avg(F.coalesce(F.col(f"`{t}`"), F.lit(0.0))).over(w)).otherwise(0.0).alias(t) for t in targets])


def flow_field(points: DataFrame, by: str, order: str, keep: list[str] | None = None) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return points.select(by, order, *(keep or []), "x", "y", (F.col("x") - F.lag("x").over(w)).alias("u"), (F.col("y") - F.lag("y").over(w)).alias("v"))


def total_variation(long: DataFrame, a: str, b: str) -> DataFrame:
    """Half the absolute difference of two groups' target shares. ``a`` and ``b`` are SQL conditions."""
    n = long.groupBy("target").agg(F.count_if(F.expr(a)).alias("na"), F.count_if(F.expr(b)).alias("nb"))
    t = n.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    return n.join(F.broadcast(t)).agg((F.sum(F.abs(F.col("na") / F.col("ta") - F.col("nb") / F.col("tb"))) / 2).alias("total_variation"))


def stance_breakdown(stats: DataFrame) -> DataFrame:
    return stats.select("target", *[F.round(100 * F.col(f"n_{k}") / F.col("n"), 1).alias(f"pct_{k}") for k in ("favor", "neutral", "against")])


def pca(df: DataFrame, columns: list[str], k: int = 2) -> DataFrame:
    """Principal components of feature columns, with the model's JVM implementation."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    v = VectorAssembler(inputCols=columns, outputCol="_f").transform(df)
    return PCA(k=k, inputCol="_f", outputCol="_p").fit(v).transform(v).withColumn("components", vector_to_array("_p")).drop("_f", "_p")


def projection(points: DataFrame, top: int = 10_000) -> DataFrame:
    """The most frequent targets of a 2-D projection."""
    return points.orderBy(F.desc("n"), "target").limit(top)


def significant_flows(flow: DataFrame, first: int = 200, least: float = 0.05) -> DataFrame:
    """The ``first`` longest flows that are longer than ``least``, longest first; ties by all columns."""
    length = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    return flow.where(length > least).orderBy(F.desc(length), *flow.columns).limit(first)


def top_loadings(loadings: dict[str, list[float]], component: int, top: int = 3) -> list[tuple[str, float]]:
    """The features of largest absolute loading on a component."""
    return sorted(((k, v[component]) for k, v in loadings.items()), key=lambda x: (-abs(x[1]), x[0]))[:top]


def transition_totals(flows: DataFrame) -> DataFrame:
    """Flows by unordered pair: both directions are summed."""
    return flows.groupBy(F.least("from_target", "to_target").alias("a"), F.greatest("from_target", "to_target").alias("b")).agg(F.sum("transition_count").alias("n"))


def focus_shift(shares: DataFrame, least: float = 0.1) -> DataFrame:
    """Targets whose share changed by at least ``least``, largest change first. shares: target, before, after."""
    return shares.withColumn("shift", F.col("after") - F.col("before")).where(F.abs("shift") >= least).orderBy(F.desc(F.abs("shift")), "target")


def colour_range(stats: DataFrame) -> DataFrame:
    """The colour scale's end: the largest absolute mean, or 1 once that is over a half."""
    return stats.agg(F.max(F.abs("mean_stance")).alias("m")).select(F.when(F.col("m") > 0.5, 1.0).otherwise(F.col("m")).alias("vmax"))


def scaled_sizes(stats: DataFrame, low: float, high: float) -> DataFrame:
    """Counts scaled to [low, high]."""
    r = stats.agg(F.min("n").alias("_lo"), F.max("n").alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), (F.col("n") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return stats.join(F.broadcast(r)).withColumn("size", low + (high - low) * span).drop("_lo", "_hi")

def without_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows that have no NaN in ``columns`` (all of floating point); nulls stay."""
    for c in columns or [c for c, t in df.dtypes if t in ("double", "float")]:
        df = df.where(~F.coalesce(F.isnan(c), F.lit(False)))
    return df


def timeline(rows: DataFrame, time: str, value: str) -> DataFrame:
    """Rows without NaN values, with the time as ISO text and its position between the first, 0, and the last, 1 (0 where all are at once)."""
    kept = without_nan(rows, [value]).withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    span = kept.agg(F.min("_t").alias("_a"), F.max("_t").alias("_b"))
    at = F.when(F.col("_b") > F.col("_a"), (F.col("_t") - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(0.0)
    return kept.join(F.broadcast(span)).withColumns({"iso": F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), "position": at}).drop("_t", "_a", "_b")
