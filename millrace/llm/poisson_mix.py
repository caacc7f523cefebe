"""Mixing sources to target weights by Poisson replication, in DataFrame functions alone.

Each row gets a uniform draw from a hash of its id and a seed; the draw is inverted through the distribution function
of a Poisson variable whose mean is the source's repetition rate, target share / present share. The row is exploded
by that count and all copies are dealt and sorted by another hash, which shuffles them globally.

Share is measured in `size_col`. Sources without a target share (or without size) have rate 0 and leave no copy.
A null source is a source of its own. Rows with a null id draw as the empty id. Repeated rows draw alike; each is
kept by its count. Rates above PART are drawn as a sum of independent parts, so no term underflows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut

#: A mean above this is drawn in several parts.
PART = 16.0
#: Terms of the distribution function of one part; beyond them lies less than 2**-52.
TERMS = 80
#: Sources whose rates are broadcast at most; more are joined by shuffles.
BROADCAST_SOURCES = 10_000
#: Parts that a source's rows are dealt into beyond that.
SALTS = 64


def uniform(id_col: Column, seed: str | Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(id '/' seed)."""
    text = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("/"), seed if isinstance(seed, Column) else F.lit(seed))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, size_col: str, source_col: str, total: float) -> DataFrame:
    """(src, rate, parts, terms array<double>) of each source: terms are the distribution function of one part."""
    sizes = docs.select(F.col(f"`{source_col}`").alias("src"), F.coalesce(F.col(f"`{size_col}`"), F.lit(0)).cast("bigint").alias("chars")).groupBy("src").agg(F.sum("chars").alias("size"))
    sizes = cut(sizes, "mix-sizes")
    if weights is None:
        wanted = sizes.withColumn("want", F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(temperature))).otherwise(0.0))
    else:
        of = F.lit(0.0)
        for name, weight in weights.items():
            of = F.when(F.col("src").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(of)
        wanted = sizes.withColumn("want", F.when(F.col("size") > 0, of).otherwise(0.0))
    sums = wanted.agg(F.sum("want").alias("w"), F.sum("size").alias("s"))
    rate = F.when((F.col("size") > 0) & (F.col("w") > 0), F.col("want") / F.col("w") * (F.col("s") * F.lit(total)) / F.col("size")).otherwise(0.0)
    # sums is one row; rounding makes the rate the same in whatever order it was summed
    rated = wanted.crossJoin(F.broadcast(sums)).select("src", F.round(rate, 9).alias("rate"))
    rated = rated.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("mean", F.col("rate") / F.col("parts"))
    # p(0) = e**-mean, p(k) = p(k-1) * mean / k, summed up.
    step = lambda acc, k: F.struct((acc.p * F.col("mean") / k).alias("p"), F.concat(acc.c, F.array(F.element_at(acc.c, -1) + acc.p * F.col("mean") / k)).alias("c"))
    first = F.exp(-F.col("mean"))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), F.struct(first.alias("p"), F.array(first).alias("c")), step, lambda acc: acc.c)
    return rated.select("src", "rate", "parts", terms.alias("terms"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, *, temperature: float = 0.5, total: float = 1.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars") -> DataFrame:
    """The rows of docs, each as often as its draw says, with `mix_copy` (from 1), `mix_rate` and `mix_key`, in global random order.

    weights: target share by source; None: shares follow size**temperature, whatever the sources are.
    total: wanted size of the mixture as a multiple of the size of docs.

    Columns of docs may have any other names: inside they are known by their places. mix_key also takes in the row's place in the
    input, so that rows repeated under one id are dealt out like others; which copies there are depends on the ids alone.
    """
    kept = [c for c in docs.columns if c not in ("mix_copy", "mix_rate", "mix_key")]
    rates = cut(source_rates(docs, weights, temperature, size_col, source_col, total), "mix-rates")
    column = lambda c: F.col(f"`{c}`")
    rows = docs.select(*(column(c).alias(f"c{j}") for j, c in enumerate(kept)), column(id_col).cast("string").alias("id_text"), column(source_col).alias("own_src"), F.monotonically_increasing_id().alias("place"))
    same = F.col("own_src").eqNullSafe(F.col("src"))
    if rates.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(rates), same)
    else:  # a source may hold a third of all rows: its rows are dealt over salted copies of its rate
        salted = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("row_salt", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("row_salt") == F.col("rate_salt")))
    # Each part's draw is made once; the distribution function is then searched with it.
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda part: uniform(F.col("id_text"), F.concat(F.lit(f"{seed}/"), part.cast("string"))))
    count = F.aggregate(draws, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col("terms"), lambda c: c <= u)))
    counted = joined.filter(F.col("rate") > 0).withColumn("n_copies", count).filter("n_copies > 0")
    copies = counted.select(*(f"c{j}" for j in range(len(kept))), "id_text", "place", "rate", F.explode(F.sequence(F.lit(1), F.col("n_copies"))).alias("copy"))
    keyed = copies.withColumn("key", F.xxhash64(F.coalesce("id_text", F.lit("")), "copy", F.lit(seed), "place"))
    return keyed.repartition("key").sortWithinPartitions("key").select(*(F.col(f"c{j}").alias(c) for j, c in enumerate(kept)), F.col("copy").alias("mix_copy"), F.col("rate").alias("mix_rate"), F.col("key").alias("mix_key"))
