"""Differences between two sides: keys, counts, attributes, order, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import scalar as S


def outer_delta(a: DataFrame, b: DataFrame, on: list[str], value: str) -> DataFrame:
    """(on, a, b, delta) of keys of either side where the values differ; a missing side is 0."""
    j = a.select(*on, F.col(value).alias("a")).join(b.select(*on, F.col(value).alias("b")), on, "full_outer")
    return j.select(*on, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b")).withColumn("delta", F.col("b") - F.col("a")).filter("delta <> 0")


def lost_gained(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """(on, side): keys of one side only."""
    x, y = a.select(*on).distinct(), b.select(*on).distinct()
    return x.join(y, on, "left_anti").withColumn("side", F.lit("lost")).unionByName(y.join(x, on, "left_anti").withColumn("side", F.lit("gained")))


def changed(a: DataFrame, b: DataFrame, on: list[str], attributes: list[str]) -> DataFrame:
    """Keys of both sides with a different attribute, with both values."""
    x = a.select(*on, *(F.col(c).alias(f"{c}_a") for c in attributes))
    y = b.select(*on, *(F.col(c).alias(f"{c}_b") for c in attributes))
    differ = F.lit(False)
    for c in attributes:
        differ = differ | ~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b"))
    return x.join(y, on).filter(differ)


#: Rows that one task sorts, so that its memory does not grow with the table.
TASK_ROWS = 1_000_000


def multiset_difference(a: DataFrame, b: DataFrame, by: list[str], item: str, tasks: int | None = None) -> DataFrame:
    """(by, item, side, n): occurrences that one side has more than the other, counted for both at once, nulls being alike. With `tasks` the rows
    of one `by` lie together in one of so many tasks, and stay so in what is made of them."""
    both = a.select(*by, item, F.lit(1).cast("long").alias("d")).unionAll(b.select(*by, item, F.lit(-1).cast("long")))
    both = both.repartition(tasks, *by) if tasks else both
    j = both.groupBy(*by, item).agg(F.sum("d").alias("d")).filter("d <> 0")
    return j.select(*by, item, F.when(F.col("d") > 0, "left").otherwise("right").alias("side"), F.abs("d").alias("n"))


def order_verdict(a: DataFrame, b: DataFrame, by: list[str], item: str, order_a: list[Column], order_b: list[Column]) -> DataFrame:
    """(by, n, violations): on the items that both sides of a group have, how many stand at another place."""
    common = a.select(*by, item).distinct().join(b.select(*by, item).distinct(), [*by, item], "left_semi")
    place = lambda d, order, name: d.join(common, [*by, item], "left_semi").withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).select(*by, item, name)
    j = place(a, order_a, "pa").join(place(b, order_b, "pb"), [*by, item])
    return j.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pa") != F.col("pb")).alias("violations"))


def bag_verdict(a: Column, b: Column) -> Column:
    """same, order (the same bag in another order), diff, or the side that is missing."""
    return F.when(a.isNull(), "right").when(b.isNull(), "left").when(a == b, "same").when(F.array_sort(a) == F.array_sort(b), "order").otherwise("diff")


def regressions(a: DataFrame, b: DataFrame, on: list[str], metrics: list[str]) -> DataFrame:
    """(on, metric, from, to, kind): metrics that fell or rose between sides; a missing side is 0."""
    stack = lambda d, name: d.select(*on, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics))).alias("e")).select(*on, "e.metric", F.col("e.v").alias(name))
    j = stack(a, "from").join(stack(b, "to"), [*on, "metric"], "full_outer").select(*on, "metric", F.coalesce("from", F.lit(0.0)).alias("from"), F.coalesce("to", F.lit(0.0)).alias("to"))
    return j.filter(F.col("from") != F.col("to")).withColumn("kind", F.when(F.col("from") > F.col("to"), "regression").otherwise("progression"))


def status_of(before: DataFrame, after: DataFrame, on: list[str], score: str) -> DataFrame:
    """(on, status): better, same or worse of before's keys; MISSING where after has none; after's own keys are left out."""
    j = before.select(*on, F.col(score).alias("was")).join(after.select(*on, F.col(score).alias("now")), on, "left")
    return j.select(*on, F.when(F.col("now").isNull(), "MISSING").when(F.col("now") > F.col("was"), "better").when(F.col("now") < F.col("was"), "worse").otherwise("same").alias("status"))


def linked(left: DataFrame, right: DataFrame, link: str, position: str, value: str) -> DataFrame:
    """(left position, right position, lv, rv): left rows with the right row that they link to; right rows without a link are appended."""
    r = right.select(F.col(position).alias("right_at"), F.col(value).alias("rv"))
    l = left.select(F.col(position).alias("left_at"), F.col(link).alias("right_at"), F.col(value).alias("lv"))
    joined = l.join(r, "right_at", "left").select("left_at", "right_at", "lv", "rv")
    extra = r.join(l.filter("right_at IS NOT NULL"), "right_at", "left_anti").select(F.lit(None).cast("long").alias("left_at"), "right_at", F.lit(None).cast(left.schema[value].dataType).alias("lv"), "rv")
    return joined.unionByName(extra)


def unambiguous(df: DataFrame, owner: str, name: str, value: str) -> DataFrame:
    """(name, value) of the names that have one value in all owners."""
    return df.groupBy(name).agg(F.min(value).alias(value), F.max(value).alias("__m")).filter(F.col(value) == F.col("__m")).drop("__m")


def missing_with_reason(wanted: DataFrame, defined: DataFrame, seen: DataFrame, on: list[str]) -> DataFrame:
    """(on, reason) of wanted keys that are defined nowhere: INLINED if seen elsewhere, else NOBODY."""
    lost = wanted.select(*on).distinct().join(defined.select(*on), on, "left_anti")
    marks = seen.select(*on).distinct().withColumn("__seen", F.lit(True))
    return lost.join(marks, on, "left").select(*on, F.when(F.col("__seen"), "INLINED").otherwise("NOBODY").alias("reason"))


def adjacent_mismatches(a: DataFrame, b: DataFrame, by: list[str], item: str, order: list[Column]) -> DataFrame:
    """(a, b, n): different items at the same place of both sides, counted."""
    place = lambda d, n: d.select(*by, F.col(item).alias(n), F.row_number().over(W.partitionBy(*by).orderBy(*order)).alias("__p"))
    j = place(a, "a").join(place(b, "b"), [*by, "__p"]).filter("a <> b")
    return j.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def compared(a: DataFrame, b: DataFrame, on: list[str], rules: list[tuple[Column, str]], default: str) -> DataFrame:
    """(on, status) of what both sides have: the label of the first rule that holds. Rules are over a's columns as a_<name> and b's as b_<name>."""
    side = lambda d, p: d.select(*on, *(F.col(n).alias(f"{p}_{n}") for n in d.columns if n not in on))
    return side(a, "a").join(side(b, "b"), on).select(*on, S.classify(rules, default).alias("status"))


def set_verdicts(a: DataFrame, b: DataFrame, unit: str, weak: Column, meaning: list[str]) -> DataFrame:
    """(unit, verdict, why) of the multisets of items (unit, kind, item) of both sides. A difference in a kind of `meaning` is SEMANTIC, but INLINE where only
    weak calls are among the differing calls, there are some, and neither data nor comparisons differ; else one in kind `op` is ARITH; else CLEAN."""
    count = lambda d, n: d.groupBy(unit, "kind", "item").agg(F.count(F.lit(1)).alias(n))
    differs = count(a, "na").join(count(b, "nb"), [unit, "kind", "item"], "full").withColumn("d", ~F.col("na").eqNullSafe(F.col("nb")))
    is_call = F.col("kind") == "call"
    per = differs.groupBy(unit).agg(
        F.array_sort(F.collect_set(F.when(F.col("d") & F.col("kind").isin(meaning), F.col("kind")))).alias("why"), F.bool_or(F.col("d") & (F.col("kind") == "op")).alias("op"),
        F.bool_or(F.col("d") & is_call).alias("calls"), F.bool_and(~(F.col("d") & is_call) | weak).alias("all_weak"), F.bool_or(F.col("d") & F.col("kind").isin("data", "cmp")).alias("strong"),
    )
    inline = F.col("calls") & F.col("all_weak") & ~F.col("strong")
    verdict = F.when(F.size("why") > 0, F.when(inline, "INLINE").otherwise("SEMANTIC")).when(F.col("op"), "ARITH").otherwise("CLEAN")
    return per.select(unit, verdict.alias("verdict"), "why")


def sibling_candidates(rows: DataFrame) -> DataFrame:
    """(a, b, tag), a < b, of rows (id, method, owner, size) that may be siblings: '=' with the same method, owner and size, '~' with the same method and
    size of other owners, '%' with the same size and owner and other methods that begin and end with the same of several camel words."""
    words = F.regexp_extract_all("method", F.lit("[A-Z]?[a-z0-9]+|[A-Z]+"), F.lit(0))
    x = rows.withColumn("words", words).withColumn("ends", F.when(F.size("words") > 1, F.concat_ws("/", F.get("words", F.lit(0)), F.element_at("words", -1)))).drop("words")
    a, b = (x.select(*(F.col(n).alias(f"{n}_{k}") for n in ("id", "method", "owner", "ends")), "size") for k in "ab")

    def pairs(tag, on, more=None):
        keys = [F.col(f"{n}_a") == F.col(f"{n}_b") for n in on] + [a["size"] == b["size"], F.col("id_a") < F.col("id_b")]
        found = a.join(b, keys)
        return (found if more is None else found.filter(more)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), F.lit(tag).alias("tag"))

    same = pairs("=", ["method", "owner"])
    loose = pairs("~", ["method"], F.col("owner_a") != F.col("owner_b"))
    return same.unionAll(loose).unionAll(pairs("%", ["owner", "ends"], F.col("method_a") != F.col("method_b")))


def paired_leftovers(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """(by, place, left, right): what each side has more of than the other, occurrence by occurrence in order of `item`, side by side for display; null where a
    side has no more."""
    tasks = 1 + (a.count() + b.count()) // TASK_ROWS
    over = multiset_difference(a, b, by, item, tasks).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    placed = over.withColumn("place", F.row_number().over(W.partitionBy(*by, "side").orderBy(item, "i")))
    return placed.groupBy(*by, "place").agg(*(F.max(F.when(F.col("side") == s, F.col(item))).alias(s) for s in ("left", "right")))


def combined_edits(edits: DataFrame, unit: str, site: str, edit: str, gain: str, extra: list[str], scored) -> DataFrame:
    """(unit, kept, score): edits with a gain are tried by falling gain, smaller `edit` first; one is kept where its site has none and the unit, scored anew with it, is better.

    scored(edits) is the score of the unit with a list of edits, structs of edit, site, gain and extra, from nothing else. Edits of a unit are few: one row holds them."""
    o = F.struct((-F.col(gain)).alias("o"), *(F.col(x) for x in dict.fromkeys([edit, site, gain, *extra])))
    lists = edits.filter(F.col(gain) > 0).groupBy(unit).agg(F.array_sort(F.collect_list(o)).alias("all"))
    none = F.filter("all", lambda e: F.lit(False))

    def tried(s, e):
        more = F.concat(s["kept"], F.array(e))
        new = scored(more)
        good = ~F.exists(s["kept"], lambda k: k[site].eqNullSafe(e[site])) & (new > s["score"] + 1e-6)
        return F.struct(F.when(good, more).otherwise(s["kept"]).alias("kept"), F.when(good, new).otherwise(s["score"]).alias("score"))

    done = lists.select(unit, F.aggregate("all", F.struct(none.alias("kept"), scored(none).alias("score")), tried).alias("s"))
    return done.select(unit, F.transform("s.kept", lambda k: k[edit]).alias("kept"), "s.score")
