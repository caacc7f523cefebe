"""Approximate containment and token tables over texts."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.functions import text as T
from millrace.session import ship


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos from 0, kind, token, line) of lexed texts of distinct keys."""
    found = df.select(F.col(key).alias("k"), F.posexplode(T.pieces(F.col(text))).alias("i", "token"))
    ordered = W.partitionBy("k").orderBy("i")
    newlines = F.length("token") - F.length(F.replace("token", F.lit("\n")))
    line = 1 + F.sum(newlines).over(ordered.rowsBetween(W.unboundedPreceding, 0)) - newlines
    kept = found.withColumns({"kind": T.piece_kind(F.col("token")), "line": line.cast("int")}).filter(~F.col("kind").isin(*T.DROPPED))
    return kept.select(F.col("k").alias(key), (F.row_number().over(ordered) - 1).alias("pos"), "kind", "token", "line")


def normal_forms(df: DataFrame, key: str, text: str, parameters: str, local_names: str, informative: bool = True) -> DataFrame:
    """(key, normal, informative) of source texts: the tokens of their normal form, and those of them that are names and no keywords, if asked for; parameters
    and local_names are array columns. A null text or list is empty."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            none = lambda x: () if x is None else x
            made = [T.normal_tokens(T.tokens(t), set(none(p)), set(none(n))) for t, p, n in zip(b["t"], b["p"], b["n"], strict=True)]
            yield pd.DataFrame({"k": b["k"], "normal": made, **({"informative": [T.informative(m) for m in made]} if informative else {})})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(parameters).alias("p"), F.col(local_names).alias("n"))
    return rows.mapInPandas(run, f"k {kind}, normal array<string>" + (", informative array<string>" if informative else "")).withColumnRenamed("k", key)


#: Tokens of a pattern, beyond those that an alignment may miss, that are looked up: as many must stand together.
HITS = 4
#: Words of all patterns that are brought to the texts as a broadcast at most.
BROADCAST_WORDS = 200_000


def _near(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_WORDS else df


def _misses(n: Column, least: float) -> Column:
    return F.floor((1 - least) * n + 1e-9).cast("int")


def copy_windows(patterns: DataFrame, texts: DataFrame, pattern_key: str, text_key: str, tokens: str, least: float, write, insert: float = 0.3, widest: int = 12) -> DataFrame:
    """(pattern_key, text_key, start, size) of stretches of the texts, places from 0, in one of which any place of the pattern of similarity `least` lies.

    patterns and texts: keys and arrays of tokens. An alignment of that similarity misses at most (1 - least) of the pattern's tokens, so of
    HITS more than these at least HITS stand in the text as they are. Those that are fewest in all texts are taken, in each pattern, and looked up
    in the texts. Where one stands, and its place in the pattern, give a diagonal; an alignment's diagonals lie within what it may leave out and
    insert, so they share one of two overlapping cells of twice that width. Cells with HITS different places of the pattern give the stretches.
    LOCAL and PARAMETER are no such tokens; a pattern that has no more others than it may miss has no stretch."""
    n = F.size(tokens)
    plain = patterns.filter(n > 0).select(F.col("pattern").alias("pattern"), n.alias("n"), F.posexplode(tokens).alias("i", "w"))
    given = plain.groupBy("pattern").agg(F.count_if(F.col("w") == T.PARAMETER).alias("spans"))
    plain = write(plain.filter(~F.col("w").isin(T.LOCAL, T.PARAMETER)).join(given, "pattern"), "pattern-words")
    standing = texts.select(F.col("text").alias("text"), F.posexplode(tokens).alias("j", "w"))
    wanted = write(plain.select("w").distinct(), "wanted-words")
    held = write(standing.select("w").join(_near(wanted), "w", "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("held")), "word-counts")
    rank = F.row_number().over(W.partitionBy("pattern").orderBy(F.coalesce("held", F.lit(0)), "w", "i"))
    ranked = plain.join(held, "w", "left").withColumns({"rank": rank, "all": F.count(F.lit(1)).over(W.partitionBy("pattern"))})
    misses = _misses(F.col("n"), least)
    hits = F.least(F.lit(HITS), F.col("all") - misses).cast("int")
    slack = (F.ceil(F.col("n") * ((1 - least) / insert)) + F.col("spans") * (widest - 1)).cast("int")
    rare = ranked.filter((F.col("all") > misses) & (F.col("rank") <= misses + hits)).select("pattern", "n", hits.alias("hits"), slack.alias("slack"), (slack + misses + 1).alias("width"), "i", "w")
    rare = write(rare, "rare-words")
    met = standing.join(_near(rare), "w").withColumn("cell", F.floor((F.col("j") - F.col("i")) / F.col("width")).cast("int"))
    met = met.withColumn("cell", F.explode(F.array(F.col("cell") - 1, F.col("cell"))))
    met = met.groupBy("pattern", "text", "n", "slack", "width", "hits", "cell").agg(F.count_distinct("i").alias("met")).filter("met >= hits")
    first = F.greatest(F.col("cell") * F.col("width") - F.col("slack"), F.lit(0))
    last = (F.col("cell") + 2) * F.col("width") + F.col("n") + F.col("slack")
    return met.select(F.col("pattern").alias(pattern_key), F.col("text").alias(text_key), first.alias("start"), (last - first).alias("size"))


def near_copies(patterns: DataFrame, texts: DataFrame, pattern_key: str, text_key: str, tokens: str, informative: str, least: float, share: float, write) -> DataFrame:
    """(pattern_key, text_key, similarity) where the pattern (keys, tokens, informative tokens) is aligned in the text (keys, tokens) with a similarity of at
    least `least`, and `share` of its informative tokens, repeats counted, stand anywhere in the text. Patterns without an informative token have no copies.

    Only stretches that copy_windows names are aligned. write(df, name) makes tables of known size."""
    patterns = write(patterns.filter(F.size(informative) > 0).select(F.col(pattern_key).alias("pattern"), F.col(tokens).alias("p"), F.col(informative).alias("told")), "patterns")
    texts = texts.select(F.col(text_key).alias("text"), F.col(tokens).alias("p"))
    windows = write(copy_windows(patterns, texts, "pattern", "text", "p", least, write), "copy-windows")
    cut = texts.withColumnRenamed("p", "t").join(_near(windows), "text").select("pattern", "text", F.slice("t", F.col("start") + 1, F.col("size")).alias("t"))
    found = aligned(cut.join(_near(patterns), "pattern").select("pattern", "text", "p", "t"), "p", "t", least)
    found = write(found.groupBy("pattern", "text").agg(F.max("similarity").alias("similarity")), "aligned")
    # The share is asked of what is left: few pairs.
    told = patterns.select("pattern", F.size("told").alias("all"), F.explode("told").alias("w")).groupBy("pattern", "all", "w").agg(F.count(F.lit(1)).alias("times"))
    words = texts.join(_near(write(found.select("text").distinct(), "copied-texts")), "text", "left_semi").select("text", F.explode(F.array_distinct("p")).alias("w"))
    shared = found.join(told, "pattern").join(words, ["text", "w"]).groupBy("pattern", "text", "all").agg(F.sum("times").alias("met"))
    enough = shared.filter(F.col("met") >= F.col("all") * share - 1e-9).select("pattern", "text")
    found = found.join(enough, ["pattern", "text"], "left_semi")
    return found.select(F.col("pattern").alias(pattern_key), F.col("text").alias(text_key), "similarity")


def aligned(pairs: DataFrame, pattern: str, text: str, least: float) -> DataFrame:
    """pairs with cost, start, end_at and similarity of the alignment, those of at least `least`; pattern and text are arrays of tokens.

    A text with fewer of the pattern's tokens than the similarity asks for is not aligned."""
    ship(pairs.sparkSession)
    keep = [c for c in pairs.columns if c not in (pattern, text)]
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep), "cost double, start int, end_at int, similarity double"])

    def run(batches):
        for b in batches:
            found = []
            for p, t in zip(b[pattern], b[text], strict=True):
                bag = Counter(t)
                most = sum(n if w in (T.LOCAL, T.PARAMETER) else min(n, bag[w]) for w, n in Counter(p).items())
                found.append(T.align(list(p), list(t)) if most >= least * len(p) - 1e-9 else (0.0, 0, 0, -1.0))
            out = b[keep].copy()
            for i, c in enumerate(("cost", "start", "end_at", "similarity")):
                out[c] = [f[i] for f in found]
            yield out[out["similarity"] >= least]

    return pairs.mapInPandas(run, schema)


def sequence_diffs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with inserted, deleted and replaced of two arrays."""
    ship(pairs.sparkSession)
    keep = [c for c in pairs.columns if c not in (a, b)]
    schema = ", ".join([*(f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in keep), "inserted int, deleted int, replaced int"])

    def run(batches):
        for x in batches:
            found = [T.sequence_diff(list(p), list(q)) for p, q in zip(x[a], x[b], strict=True)]
            yield x[keep].assign(inserted=[f["insert"] for f in found], deleted=[f["delete"] for f in found], replaced=[f["replace"] for f in found])

    return pairs.mapInPandas(run, schema)
