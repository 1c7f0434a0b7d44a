"""Aggregations over matching rows from a JSON-like description.

Buckets: terms, histogram, date_histogram, range, filter. Metrics: avg, sum, min, max, value_count, stats,
extended_stats, percentiles (exact, or "approximate"), cardinality. Fixed intervals: ms, s, m, h, d, w. More buckets
than allowed are refused, not cut. {"name": {"terms": {"field": ..}, "aggs": {..}}} nests. Each bucket
aggregation is one grouped plan over rows; nested ones add grouping columns, so that nothing is grouped twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("avg", "sum", "min", "max", "value_count", "stats", "extended_stats", "percentiles", "cardinality")


def metric_columns(name: str, kind: str, spec: dict) -> list[Column]:
    f = F.col(spec["field"])
    simple = {"avg": F.avg(f), "sum": F.sum(f), "min": F.min(f), "max": F.max(f), "value_count": F.count(f)}
    if kind in simple:
        return [simple[kind].alias(name)]
    if kind == "cardinality":
        return [(F.approx_count_distinct(f, spec["rsd"]) if "rsd" in spec else F.countDistinct(f)).alias(name)]
    if kind == "percentiles":
        # exact ones hold a group's distinct values; approximate ones a sketch, whatever the group's size
        found = (lambda p: F.percentile_approx(f, p / 100, spec.get("accuracy", 10000))) if spec.get("approximate") else (lambda p: F.percentile(f, p / 100))
        return [found(p).alias(f"{name}_{str(p).replace('.', '_')}") for p in spec.get("percents", [1, 5, 25, 50, 75, 95, 99])]
    stats = [F.count(f).alias(f"{name}_count"), F.min(f).alias(f"{name}_min"), F.max(f).alias(f"{name}_max"), F.avg(f).alias(f"{name}_avg"), F.sum(f).alias(f"{name}_sum")]
    if kind == "extended_stats":
        stats += [F.var_pop(f).alias(f"{name}_variance"), F.stddev_pop(f).alias(f"{name}_std_deviation"), F.sum(f * f).alias(f"{name}_sum_of_squares")]
    return stats


def bucket_key(kind: str, spec: dict) -> Column:
    f = F.col(spec["field"])
    if kind == "terms":
        return f if "missing" not in spec else F.coalesce(f, F.lit(spec["missing"]))
    if kind == "histogram":
        step, offset = float(spec["interval"]), float(spec.get("offset", 0))
        return F.floor((f - offset) / step) * step + offset
    if kind == "date_histogram":
        interval = spec.get("calendar_interval") or spec["fixed_interval"]
        if interval in ("year", "quarter", "month", "week", "day", "hour", "minute"):
            return F.date_trunc(interval, f)
        amount, unit = re.fullmatch(r"(\d+)(ms|[smhdw])", interval).groups()
        step = int(amount) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[unit]
        return F.timestamp_millis(F.floor(F.unix_millis(f.cast("timestamp")) / step) * step)
    if kind == "range":
        out = None
        for r in spec["ranges"]:
            low, high = r.get("from"), r.get("to")
            test = F.lit(True) if low is None else f >= low
            test = test if high is None else test & (f < high)
            label = r.get("key") or f"{'*' if low is None else low}-{'*' if high is None else high}"
            out = F.when(test, label) if out is None else out.when(test, label)
        return out
    raise ValueError(f"unknown bucket aggregation {kind!r}")


def aggregate(rows: DataFrame, spec: dict, bucket_limit: int = 65000) -> dict[str, DataFrame]:
    """A DataFrame for each named aggregation: bucket columns, doc_count, metrics."""
    return {name: _one(rows, name, body, [], bucket_limit) for name, body in spec.items()}


def _one(rows: DataFrame, name: str, body: dict, outer: list[str], limit: int) -> DataFrame:
    nested = body.get("aggs", {})
    kind = next(k for k in body if k != "aggs")
    spec = body[kind]
    if kind in METRICS:
        return rows.groupBy(*outer).agg(*metric_columns(name, kind, spec))
    if kind == "filter":
        return _one(rows.where(spec), name, {"value_count": {"field": rows.columns[0]}}, outer, limit)
    keyed = rows.withColumn(name, bucket_key(kind, spec)).where(F.col(name).isNotNull())
    keys = [*outer, name]
    metrics = [c for n, b in nested.items() for k in b if k in METRICS for c in metric_columns(n, k, b[k])]
    out = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *metrics)
    if "min_doc_count" in spec:
        out = out.where(F.col("doc_count") >= spec["min_doc_count"])
    if kind == "terms":
        size, order = spec.get("size", 10), spec.get("order", {"_count": "desc"})
        if size > limit:
            raise ValueError(f"{size} buckets of {name} asked for, {limit} allowed")
        by, way = next(iter(order.items()))
        column = {"_count": "doc_count", "_key": name}.get(by, by)
        best = F.desc(column) if way == "desc" else F.asc(column)
        if outer:
            place = F.row_number().over(Window.partitionBy(*outer).orderBy(best, name))
            out = out.withColumn("_r", place).where(F.col("_r") <= size).drop("_r")
        else:
            out = out.orderBy(best, name).limit(size)
    for inner, b in nested.items():
        if next(k for k in b if k != "aggs") not in METRICS:
            deeper = _one(keyed, inner, b, keys, limit).withColumnRenamed("doc_count", f"{inner}_doc_count")
            out = out.join(deeper, keys, "left")
    return out


def agg(spec: dict) -> Column:
    """Metrics as one aggregate function, for groupBy().agg(): {"name": {"avg": {"field": ..}}, ..} gives a JSON text of
    names and values. Buckets need a plan of their own (`aggregate`)."""
    columns = []
    for name, body in spec.items():
        kind = next(iter(body))
        if kind not in METRICS:
            raise ValueError(f"{kind!r} is no metric")
        columns += metric_columns(name, kind, body[kind])
    return F.to_json(F.struct(*columns))


def facet_top_k(matches: DataFrame, order: list, k: int) -> DataFrame:
    """The first k matches, each with the number of all matches. The number is one row, joined on."""
    total = matches.agg(F.count(F.lit(1)).alias("total"))
    return matches.orderBy(*order).limit(k).crossJoin(F.broadcast(total))
