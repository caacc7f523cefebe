"""Whether two versions of a unit's data flow compute the same: classes of values refined to a fixpoint, units side by side.

A unit has a control graph of blocks and a graph of values: each value has content, operands at places, and may be an observable
effect. Values of both versions begin in classes by content; each round a value's class becomes a hash of its own class and the
multiset of its operands' (place, class), so loops need no order. A unit whose number of classes stands still has settled and leaves
the rounds; a round's work follows the units that are still refined. Units of few rows, of which there may be very many, are shuffled
once and refined within tasks, many side by side; larger ones go in rounds over tables, where operands are summed up as hashes before they are
shuffled, so a value with very many of them is never gathered.
"""

from __future__ import annotations

import logging
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import ship

log = logging.getLogger(__name__)

VALUE = ["unit", "version", "value"]


def _multiset(*columns: Column | str) -> list[Column]:
    """Two order-free sums of hashes of the rows' columns; repeated rows count. Sums of 64-bit hashes fit decimal(38,0) up to 10**18 rows."""
    return [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (0, 1)]


#: Values and operands of a unit up to which it is refined within a task; rows that a task refines side by side, and those it is dealt.
SMALL_UNIT, SIDE_BY_SIDE, TASK_ROWS = 10_000, 50_000, 500_000


def _codes(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 of the distinct rows of whole-number columns."""
    found = columns[0]
    for column in columns[1:]:
        pair = np.unique(found, return_inverse=True)[1].astype(np.int64) * (int(column.max()) + 1) + column
        found = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    return found


def _settled(rows: pd.DataFrame) -> pd.DataFrame:
    """Classes of whole units' rows, values (place null) and operands, by rounds over all of them until no class parts any more."""
    code = lambda x: pd.factorize(x, use_na_sentinel=False)[0].astype(np.int64)
    unit = code(rows["unit"])
    side = _codes(unit, code(rows["version"]))
    kinds = rows["kind"].to_numpy()
    is_value = kinds == 0
    names = code(np.concatenate([rows["value"].to_numpy(), rows["operand"].to_numpy()]))
    of, to = _codes(np.concatenate([side, side]), names).reshape(2, -1)
    seat = np.full(len(rows) * 2, -1)  # where a value stands among the values
    seat[of[is_value]] = np.arange(is_value.sum())
    at, met, place = seat[of[~is_value]], np.where(kinds == 2, -1, seat[to])[~is_value], code(rows["place"])[~is_value]
    found = at >= 0
    at, met, place = at[found], met[found], place[found]
    classes = _codes(unit[is_value], code(rows["content"])[is_value])
    n = classes.max() + 1 if len(classes) else 0
    while n:
        # Operands in order of value and their (place, class); those of a value are put together one after the other.
        kind = _codes(place, np.where(met >= 0, classes[met], n)) if len(at) else at
        order = np.lexsort((kind, at))
        owner, kind = at[order], kind[order]
        first = np.r_[True, owner[1:] != owner[:-1]] if len(owner) else np.zeros(0, bool)
        rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0)) if len(owner) else owner
        new, by_rank = classes.copy(), np.argsort(rank, kind="stable")
        bounds = np.r_[0, np.cumsum(np.bincount(rank))] if len(rank) else np.zeros(1, int)
        fresh = n
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            some = by_rank[a:b]
            who = owner[some]
            made = _codes(new[who], kind[some])
            new[who] = made + fresh
            fresh += made.max() + 1
        new = np.unique(new, return_inverse=True)[1].astype(np.int64)
        classes, before, n = new, n, new.max() + 1
        if n == before:
            break
    made = rows.loc[is_value, VALUE].copy()
    made["class"] = [str(x) for x in classes.tolist()]
    return made


def _within_tasks(values: DataFrame, operands: DataFrame) -> DataFrame:
    """The classes of small units: a unit's rows lie in one task, in order of units."""
    c = F.col
    # No column that names something has nulls, which would make floats of whole numbers: what an operand lacks is told by its kind.
    rows = values.select(*VALUE, c("content").cast("string"), F.lit(0).cast("long").alias("place"), c("value").cast(operands.schema["operand"].dataType).alias("operand"), F.lit(0).alias("kind"))
    rows = rows.unionAll(operands.select(*VALUE, F.lit(None).cast("string"), F.xxhash64("place"), F.coalesce("operand", "value"), F.when(c("operand").isNull(), 2).otherwise(1))).filter("unit IS NOT NULL")
    rows = rows.withColumn("content", F.coalesce("content", F.lit("")))

    def run(batches):
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b)
            if size < SIDE_BY_SIDE:
                continue
            all_ = pd.concat(held, ignore_index=True)
            last = int((all_["unit"] != all_["unit"].iloc[-1]).sum())
            if last:  # the last unit may go on
                yield _settled(all_.iloc[:last].reset_index(drop=True))
            held = [all_.iloc[last:]]
            size = len(held[0])
        if size:
            yield _settled(pd.concat(held, ignore_index=True))

    schema = ", ".join([*(f"{n} {values.schema[n].dataType.simpleString()}" for n in VALUE), "class string"])
    tasks = 1 + (values.count() + operands.count()) // TASK_ROWS
    return rows.repartition(tasks, "unit").sortWithinPartitions("unit").mapInPandas(run, schema)


def refined_classes(values: DataFrame, operands: DataFrame, write, discard, rounds: int = 200) -> DataFrame:
    """(unit, version, value, class) of values (unit, version, value, content), classes being equal where values of one unit can't be told apart.

    operands: (unit, version, value, place, operand); places that are equal are interchangeable. A missing operand is a class of its own. write(df, name)
    makes a table in the folder that all executors share, discard(df) deletes one."""
    ship(values.sparkSession)
    size = values.select("unit").unionAll(operands.select("unit")).groupBy("unit").agg(F.count(F.lit(1)).alias("n"))
    large = write(size.filter(F.col("n") > SMALL_UNIT).select("unit"), "large-units")
    if large.isEmpty():
        discard(large)
        return write(_within_tasks(values, operands), "classes-settled")
    small = write(_within_tasks(values.join(large, "unit", "left_anti"), operands.join(large, "unit", "left_anti")), "classes-settled")
    rest = _refined_in_rounds(values.join(large, "unit", "left_semi"), operands.join(large, "unit", "left_semi"), write, discard, rounds)
    return small.unionAll(rest)


def _refined_in_rounds(values: DataFrame, operands: DataFrame, write, discard, rounds: int) -> DataFrame:
    """As refined_classes, by rounds over tables."""

    def counted(classes: DataFrame, before: DataFrame | None) -> DataFrame:
        now = classes.groupBy("unit").agg(F.count_distinct("class").alias("n"))
        was = now.withColumn("before", F.lit(0).cast("long")) if before is None else now.join(before.select("unit", F.col("n").alias("before")), "unit")
        return write(was, "class-counts")

    states, counts, finished = [write(values.select(*VALUE, F.md5(F.coalesce(F.col("content").cast("string"), F.lit("")).cast("binary")).alias("class")), "classes")], [], []
    counts.append(counted(states[0], None))
    for k in range(rounds):
        active = counts[-1].filter("n > before").select("unit")
        if active.isEmpty():
            break
        now = states[-1].join(active, "unit", "left_semi")
        seen = operands.join(active, "unit", "left_semi").join(now.select("unit", "version", F.col("value").alias("operand"), F.col("class").alias("c")), ["unit", "version", "operand"], "left")
        a, b = _multiset("place", F.coalesce("c", F.lit("")))
        met = seen.groupBy(*VALUE).agg(a.alias("a"), b.alias("b"))
        part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
        states.append(write(now.join(met, VALUE, "left").select(*VALUE, F.md5(F.concat_ws("/", "class", part("a"), part("b")).cast("binary")).alias("class")), "classes"))
        counts.append(counted(states[-1], counts[-1]))
        left = counts[-1].filter("n = before").select("unit")
        if not left.isEmpty():
            finished.append(states[-1].join(left, "unit", "left_semi"))
        log.info("round %d of classes refined", k + 1)
    else:
        raise RuntimeError(f"classes did not settle in {rounds} rounds")
    found = write(reduce(DataFrame.unionAll, finished, values.select(*VALUE, F.lit("").alias("class")).limit(0)), "classes-settled")
    discard(*states, *counts)
    return found


def _first_difference(j: DataFrame, differs: Column, reason: Column, order: list[str]) -> DataFrame:
    """(unit, reason) of the first row, by order, that differs."""
    return j.filter(differs).groupBy("unit").agg(F.min(F.struct(*order, reason.alias("reason"))).alias("d")).select("unit", F.col("d.reason").alias("reason"))


def verdicts(blocks: DataFrame, values: DataFrame, operands: DataFrame, versions: tuple[str, str], write, discard) -> DataFrame:
    """(unit, verdict, reason) of every unit in blocks (unit, version, block, kind, successors array) of two versions.

    values: (unit, version, value, content, block, pos, effect: its number among the block's effects, or null).
    UNSUPPORTED: the control graphs differ (number of blocks, then the first block of other kind or successors). DIFFERENT: the first
    effect, by block and number, whose class differs or that one version lacks. Else EQUIVALENT: L1 if contents are the same in order, L2 if not."""
    first, second = (blocks.filter(F.col("version") == v) for v in versions)
    number = blocks.groupBy("unit").agg(*(F.count_if(F.col("version") == v).alias(n) for v, n in zip(versions, "pq", strict=True)))
    shape = lambda side, n: side.select("unit", "block", F.struct("kind", "successors").alias(n))
    shapes = _first_difference(shape(first, "p").join(shape(second, "q"), ["unit", "block"], "full_outer"), ~F.col("p").eqNullSafe(F.col("q")), F.concat(F.lit("block "), F.col("block").cast("string")), ["block"])
    units = number.join(shapes.withColumnRenamed("reason", "shape"), "unit", "left")
    cfg = F.when(F.col("p") != F.col("q"), F.concat(F.col("p").cast("string"), F.lit(" vs "), F.col("q").cast("string"), F.lit(" blocks"))).otherwise(F.col("shape"))
    units = write(units.select("unit", cfg.alias("cfg")), "unit-shapes")

    same = units.filter("cfg IS NULL").select("unit")
    classes = refined_classes(values.join(same, "unit", "left_semi"), operands.join(same, "unit", "left_semi"), write, discard)
    effects = values.filter("effect IS NOT NULL").join(classes, VALUE).select("unit", "version", "block", "effect", "class")
    side = lambda v, n: effects.filter(F.col("version") == v).select("unit", "block", "effect", F.col("class").alias(n))
    j = side(versions[0], "p").join(side(versions[1], "q"), ["unit", "block", "effect"], "full_outer")
    told = _first_difference(j, ~F.col("p").eqNullSafe(F.col("q")), F.concat(F.lit("block "), F.col("block").cast("string"), F.lit(" effect "), F.col("effect").cast("string")), ["block", "effect"])

    a, b = _multiset("block", "pos", "content")
    orders = values.groupBy("unit", "version").agg(F.struct(a, b).alias("o")).groupBy("unit").agg((F.count_distinct("o") == 1).alias("same_order"))
    out = units.join(told.withColumnRenamed("reason", "told"), "unit", "left").join(orders, "unit", "left")
    verdict = F.when(F.col("cfg").isNotNull(), "UNSUPPORTED").when(F.col("told").isNotNull(), "DIFFERENT").otherwise("EQUIVALENT")
    level = F.when(F.coalesce("same_order", F.lit(True)), "L1").otherwise("L2")
    return out.select("unit", verdict.alias("verdict"), F.coalesce("cfg", "told", level).alias("reason"))
