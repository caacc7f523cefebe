"""Ordered analytics: fills, rates, edges, run lengths, islands, as-of and spline lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import scalar as S


def backward_fill(df: DataFrame, by: list[str], order: list[Column], value: str, least: int = 3) -> DataFrame:
    """Zeros take the next non-zero value of their series, if the series has `least` rows; the last row is never filled."""
    after = W.partitionBy(*by).orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    return df.withColumn(value, F.when(n >= least, F.coalesce(F.first(F.nullif(F.col(value), F.lit(0)), ignorenulls=True).over(after), F.col(value))).otherwise(F.col(value)))


def forward_fill(df: DataFrame, by: list[str], order: list[Column], value: str, default) -> DataFrame:
    before = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(before), F.lit(default)))


def rising_edges(df: DataFrame, by: list[str], order: list[Column], mask: str, name: str) -> DataFrame:
    """Bits that are set now and were not in the row before; before the first row none is."""
    was = F.lag(mask, 1, 0).over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.col(mask).bitwiseAND(F.col(mask).bitwiseXOR(was)))


def run_length_decode(df: DataFrame, duration: str, value: str, keep: list[str]) -> DataFrame:
    """Each value as often as its duration says; a duration of 0 still gives one."""
    return df.select(*keep, F.explode(F.sequence(F.lit(1), F.greatest(F.col(duration).cast("int"), F.lit(1)))).alias("frame"), F.col(value))


def islands(df: DataFrame, by: list[str], position: str, reach: int, name: str = "island") -> DataFrame:
    """Numbers the clusters of rows whose positions lie at most `reach` apart, from 0."""
    w = W.partitionBy(*by).orderBy(position)
    gap = F.when(F.col(position) - F.lag(position).over(w) > reach, 1).otherwise(0)
    return df.withColumn("__gap", gap).withColumn(name, F.sum("__gap").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__gap")


def runs(df: DataFrame, by: list[str], order: list[Column], value: str) -> DataFrame:
    """Runs of equal values: (by, run, value, n, start) with run from 0 and start the place of the run's first row, from 1."""
    w = W.partitionBy(*by).orderBy(*order)
    marked = df.withColumn("__new", F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)).withColumn("__at", F.row_number().over(w))
    numbered = marked.withColumn("run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*by, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"), F.min("__at").alias("start"))


def last_per_period(df: DataFrame, by: list[str], period: Column, order: list[Column]) -> DataFrame:
    """The last row of each period, with the period's start as `period`."""
    p = df.withColumn("period", period)
    return p.withColumn("__r", F.row_number().over(W.partitionBy(*by, "period").orderBy(*order))).filter("__r = 1").drop("__r")


def trailing_rate(df: DataFrame, by: list[str], seconds: str, value: str, hours: float, target: float) -> DataFrame:
    """Slope from the last row at or before (end - hours), else the first row, to the last row; days to the target, infinite when not rising."""
    end = df.groupBy(*by).agg(F.max(F.struct(seconds, value)).alias("e"))
    early = F.struct(F.col(seconds).alias("s"), F.col(value).alias("v"))
    base = df.join(end, by).groupBy(*by).agg(F.first("e").alias("e"), F.max(F.when(F.col(seconds) <= F.col("e")[seconds] - hours * 3600, early)).alias("old"), F.min(early).alias("first"))
    base = base.withColumn("b", F.coalesce("old", "first"))
    slope = F.try_divide(F.col("e")[value] - F.col("b.v"), (F.col("e")[seconds] - F.col("b.s")) / 86400.0)
    return base.select(*by, slope.alias("per_day"), F.when(slope > 0, (target - F.col("e")[value]) / slope).otherwise(F.lit(float("inf"))).alias("days_left"))


def asof(probes: DataFrame, keys: DataFrame, by: list[str], at: str, key_at: str, values: list[str], strict: bool = False) -> DataFrame:
    """probes with the last key at or before (before, if strict) each: prev_* and next_* of key_at and values.

    One shuffle by `by`: both sides are laid end to end and carried forward and back by windows.
    """
    packed = F.struct(F.col(key_at).alias("at"), *(F.col(v).alias(v) for v in values))
    a = keys.select(*by, F.col(key_at).alias("__at"), F.lit(1 if strict else 0).alias("__side"), packed.alias("__key"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in probes.columns if c not in by))
    b = probes.select(*by, F.col(at).alias("__at"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast(a.schema["__key"].dataType).alias("__key"), *(c for c in probes.columns if c not in by)).withColumn("__probe", F.lit(True))
    w = W.partitionBy(*by).orderBy("__at", "__side")
    both = a.withColumn("__probe", F.lit(False)).unionByName(b)
    found = both.withColumn("__prev", F.last("__key", True).over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("__next", F.first("__key", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    shown = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("__prev", "prev"), ("__next", "next")) for c in ("at", *values)]
    return found.filter("__probe").select(*probes.columns, *shown)


def keyframes(probes: DataFrame, keys: DataFrame, by: list[str], at: str, key_at: str, value: str, slope: str | None = None) -> DataFrame:
    """Keyframe values at the probes: the first before the first key, the last from the last key on, else a cubic between."""
    found = asof(probes, keys, by, at, key_at, [value, *([slope] if slope else [])])
    c = lambda n: F.col(n).cast("double")
    m0, m1 = (c(f"prev_{slope}"), c(f"next_{slope}")) if slope else (F.lit(0.0), F.lit(0.0))
    between = S.hermite(c(at), c("prev_at"), c(f"prev_{value}"), m0, c("next_at"), c(f"next_{value}"), m1)
    made = F.when(F.col("prev_at").isNull(), c(f"next_{value}")).when(F.col("next_at").isNull() | (F.col("prev_at") == F.col(at)), c(f"prev_{value}")).otherwise(between)
    return found.select(*probes.columns, made.alias("value"))


def frame_passed(now, rate, start, end, frame) -> Column:
    """Whether one-shot playback from `now` by `rate` passes `frame`; the start and the end hold it."""
    now, rate, start, end, frame = (x if isinstance(x, Column) else F.lit(x) for x in (now, rate, start, end, frame))
    later = F.greatest(now + rate, start)
    later = F.when(later >= end, end - 0.001).otherwise(later)
    return F.when(now <= later, (now <= frame) & (frame < later)).otherwise((later <= frame) & (frame < now))


def frame_passed_on(attribute: str, now, rate, start, end, loop, frame) -> Column:
    """Whether playback from `now` by `rate` passes `frame`. attribute: once, loop or ping_pong.

    Looped playback that leaves [start, end) comes in again at `loop`, moved by whole lengths of what lies between; a length of 0 moves nothing."""
    now, rate, start, end, loop, frame = (x if isinstance(x, Column) else F.lit(x) for x in (now, rate, start, end, loop, frame))
    within = lambda low, high: (low <= frame) & (frame < high)
    later = now + rate
    plain = lambda to: F.when(now <= to, within(now, to)).otherwise(within(to, now))
    if attribute == "once":
        return frame_passed(now, rate, start, end, frame)
    if attribute == "ping_pong":
        return plain(F.greatest(F.when(later >= end, end - 0.001).otherwise(later), start))
    if attribute != "loop":
        raise ValueError(f"unknown attribute {attribute}")
    below, above = loop - start, end - loop
    raised = F.when((later < start) & (below > 0), later + below * F.ceil((start - later) / F.nullif(below, F.lit(0.0)))).otherwise(later)
    lowered = F.when((later >= end) & (above > 0), later - above * (F.floor((later - end) / F.nullif(above, F.lit(0.0))) + 1)).otherwise(later)
    return (
        F.when(now < start, within(raised, loop)).when(now >= end, within(loop, lowered))
        .when(later < start, within(start, now) | within(raised, loop)).when(later >= end, within(now, end) | within(loop, lowered)).otherwise(plain(later))
    )
