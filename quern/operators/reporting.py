"""Report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_sd(df: DataFrame, by: list[str], values: dict[str, Column], scale: float = 1.0, digits: int = 4) -> DataFrame:
    """Mean and sample standard deviation of each value, and the rows of each group, nulls counted."""
    aggs = []
    for name, c in values.items():
        c = F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        aggs += [F.round(F.avg(c) * scale, digits).alias(f"{name}_mean"), F.round(F.stddev_samp(c) * scale, digits).alias(f"{name}_sd")]
    return df.groupBy(*by).agg(*aggs, F.count("*").alias("n"))


def mean_sd_text(mean: Column, sd: Column) -> Column:
    """Presentation only: "mean ± sd" with two decimals, "—" without values, "nan" for a single one."""
    return F.when(mean.isNull(), F.lit("—")).otherwise(F.concat(F.format_string("%.2f", mean), F.lit(" ± "), F.when(sd.isNull(), F.lit("nan")).otherwise(F.format_string("%.2f", sd))))


def long_metrics(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """(by..., metric_label, mean, std, n): one row per group and metric."""
    tall = df.unpivot(by, metrics, "metric_label", "value")
    return tall.groupBy(*by, "metric_label").agg(F.round(F.avg("value"), 4).alias("mean"), F.round(F.stddev_samp("value"), 4).alias("std"), F.count("value").alias("n"))


def _in_order(df: DataFrame, c: str, values: list, table: DataFrame) -> DataFrame:
    """``table`` for the given values of ``c`` in their order (place), null where one is absent."""
    order = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"{c} {df.schema[c].dataType.simpleString()}, place int")
    return order.join(table, c, "left")


def pivot_counts(df: DataFrame, row: str, column: str, values: list[str], rows: list | None = None) -> DataFrame:
    """Counts of each value by row, absent ones 0; rows without a key are dropped. With ``rows``, these rows in this
    order (place), and nulls for those that are absent altogether."""
    out = df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).count().na.fill(0, values)
    return out if rows is None else _in_order(df, row, rows, out)


def class_counts(df: DataFrame, c: str, values: list) -> DataFrame:
    """Counts of given classes in their order, null where a class is absent."""
    return _in_order(df, c, values, df.groupBy(c).count()).withColumnRenamed("count", "n")


def compare(df: DataFrame, by: list[str], evaluator: str, evaluators: list[str], metrics: list[str]) -> DataFrame:
    """Means of every metric side by side for each evaluator, null where one has no rows, and the difference of the
    first two."""
    out = df.groupBy(*by).pivot(evaluator, evaluators).agg(*[F.round(F.avg(m), 4).alias(m) for m in metrics])
    names = {(e, m): f"{e}_{m}" if len(metrics) > 1 else e for e in evaluators for m in metrics}
    shown = [F.col(names[e, m]).alias(f"{m}_{e}") for m in metrics for e in evaluators]
    return out.select(*by, *shown, *[F.round(F.col(names[evaluators[0], m]) - F.col(names[evaluators[1], m]), 4).alias(f"{m}_difference") for m in metrics])


def profile(samples: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Start, end, peak and rise of a sampled value in each run."""
    first, peak = F.min_by(value, ts), F.max(value)
    return samples.groupBy(by).agg(F.round(first, 4).alias("start"), F.round(F.max_by(value, ts), 4).alias("end"), F.round(peak, 4).alias("peak"), F.round(peak - first, 4).alias("delta"))


def stage_times(samples: DataFrame, by: str, stage: str, value: str, stages: list[str], accumulate: bool = True, ts: str | None = None) -> DataFrame:
    """Seconds by stage: repeated stages add up, or the last one stands."""
    agg = F.sum(value) if accumulate else F.max_by(value, ts)
    out = samples.groupBy(by).pivot(stage, stages).agg(agg)
    return out.select(by, *[F.round(s, 4).alias(s) for s in stages])


def merge_reports(generation: DataFrame, *others: DataFrame, keys: list[str]) -> DataFrame:
    """Left joins on the keys, null keys equal, columns of the left kept where names clash."""
    out = generation
    for other in others:
        keep = [c for c in other.columns if c in keys or c not in out.columns]
        right = other.select(*[F.col(c).alias(f"_{c}" if c in keys else c) for c in keep])
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(right, same, "left").drop(*[f"_{k}" for k in keys])
    return out
