"""Joins of points and intervals.

Spark plans a join on ``key = key and start <= point < end`` as an equi-join
on the key alone, so each point meets every interval of its key. Here an
interval is listed under each bucket of the axis that it touches and joins
points of that bucket: the equi-join has a selective key, and large keys
spread over their buckets. Intervals are half-open, [start, end).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_of(place: Column, width: int) -> Column:
    return F.floor(place / F.lit(width)).cast("long")


def buckets_touched(start: Column, end: Column, width: int) -> Column:
    """Buckets of [start, end); none where it is empty."""
    return F.when(end > start, F.sequence(bucket_of(start, width), bucket_of(end - 1, width))).otherwise(F.array().cast("array<bigint>"))


def point_in_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with the intervals of their keys that hold them.

    ``how``: inner or left. A point in several intervals has a row for each.
    ``width`` of a bucket should be near the usual length of an interval.
    Columns of the two sides besides ``keys`` must differ.
    """
    left = points.withColumn("__bucket", bucket_of(F.col(point), width))
    right = intervals.withColumn("__bucket", F.explode(buckets_touched(F.col(start), F.col(end), width)))
    held = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*keys, "__bucket"]]
    condition = held
    for c in same:
        condition = condition & c
    out = left.alias("l").join(right.alias("r"), condition, how)
    rest = [F.col(f"r.{c}") for c in intervals.columns if c not in keys]
    return out.select(*[F.col(f"l.{c}") for c in points.columns], *rest)


def first_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, name: str, width: int, ids: list[str], missing: int = -1) -> DataFrame:
    """``ids`` of the points with the smallest ``name`` of an interval that
    holds them, else ``missing``."""
    met = point_in_interval(points, intervals, keys, point, start, end, width, "left")
    return met.groupBy(*ids).agg(F.coalesce(F.min(name), F.lit(missing)).alias(name))


def padded_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, name: str, width: int, pad: int, ids: list[str], low: str | None = None, high: str | None = None, missing: int = -1) -> DataFrame:
    """As ``first_interval``; points outside all intervals try intervals
    widened by ``pad``, not beyond [``low``, ``high``) where those are given.

    Only points without an interval take part in the second join.
    """
    own = first_interval(points, intervals, keys, point, start, end, name, width, ids, missing)
    there = points.select(*dict.fromkeys([*ids, *keys, point])).join(own.filter(F.col(name) == missing).select(*ids), ids)
    wide_start, wide_end = F.col(start) - pad, F.col(end) + pad
    if low:
        wide_start = F.greatest(wide_start, F.col(low))
    if high:
        wide_end = F.least(wide_end, F.col(high))
    wide = intervals.withColumn(start, wide_start).withColumn(end, wide_end)
    second = first_interval(there, wide, keys, point, start, end, name, width, ids, missing)
    return own.filter(F.col(name) != missing).unionByName(second)


def contained(inner: DataFrame, outer: DataFrame, keys: list[str], start: str, end: str, outer_start: str, outer_end: str, name: str, width: int, ids: list[str]) -> DataFrame:
    """``ids`` of inner intervals that lie inside an outer one, with the
    largest such ``name``."""
    met = point_in_interval(inner, outer, keys, start, outer_start, outer_end, width)
    return met.filter(F.col(end) <= F.col(outer_end)).groupBy(*ids).agg(F.max(name).alias(name))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int) -> DataFrame:
    """Pairs of intervals that overlap, with ``overlap_start`` and
    ``overlap_end``.

    Both sides are listed by bucket; a pair is kept in the bucket where its
    overlap starts, so it comes once without a distinct.
    """
    (a, b), (c, d) = left_span, right_span
    one = left.withColumn("__bucket", F.explode(buckets_touched(F.col(a), F.col(b), width)))
    two = right.withColumn("__bucket", F.explode(buckets_touched(F.col(c), F.col(d), width)))
    met = one.join(two, [*keys, "__bucket"])
    begin, stop = F.greatest(a, c), F.least(b, d)
    met = met.filter((begin < stop) & (bucket_of(begin, width) == F.col("__bucket")))
    return met.withColumn("overlap_start", begin).withColumn("overlap_end", stop).drop("__bucket")


def nearest_within(points: DataFrame, targets: DataFrame, keys: list[str], point: str, target: str, radius: int, ids: list[str], low: str | None = None, high: str | None = None) -> DataFrame:
    """``ids`` with the nearest target within ``radius`` (ties: the smaller),
    not beyond [``low``, ``high``] of the point's row where given."""
    spread = targets.withColumn("__s", F.col(target) - radius).withColumn("__e", F.col(target) + radius + 1)
    met = point_in_interval(points, spread, keys, point, "__s", "__e", 2 * radius + 1)
    if low:
        met = met.filter(F.col(target) >= F.col(low))
    if high:
        met = met.filter(F.col(target) <= F.col(high))
    best = F.min(F.struct(F.abs(F.col(target) - F.col(point)).alias("d"), F.col(target).alias("t")))
    return met.groupBy(*ids).agg(best["t"].alias(target))
