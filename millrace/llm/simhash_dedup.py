"""Near-duplicates by SimHash over word shingles, found with deletion-variant signatures.

Fingerprints of 64 bits that differ in at most 3 bits agree in all but one bit on one of two 32-bit segments. Each
distinct fingerprint is indexed under the one-wildcard variants of both segments (the segment with bit i taken out);
equality on a variant gives candidates, which are verified by their Hamming distance. In a bucket only the links
that connect its members are put out, so a large group of copies gives rows in proportion to its members, not to its pairs.
Members of a bucket of more than BLOCK are parted again: of four bytes of the other segment one is equal in both
fingerprints of a link, so each member goes to four smaller buckets; what is still too large is dealt in pairs of blocks. Components come from large-star/small-star rounds.

Equal fingerprints are one node from the start, so exact copies are never paired. Null and wordless texts have
fingerprint zero and link like any other. component_id is the smallest non-null doc_id of the component.

With a similarity, texts whose sets of five-word shingles reach that Jaccard similarity are linked too. Those that share a band of
MinHash values are compared by their signatures (SIGNATURE values, two bytes each) in bounded groups, and what may be similar is put together in
components; each set then goes once to its component, and links are verified on the sets. Components of more than GROUP_BYTES of sets
are dealt in pairs of blocks of that size.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, discard, give_back, lower_words, map_texts, mix, segment_sums, word_hashes
from millrace.session import ship

BITS = 3
SEED = 42
BLOCK = 1024
#: Fingerprints whose variants one task makes.
VARIANT_ROWS = 20_000
#: Ids that are brought to the texts as a broadcast at most; beyond them both sides are shuffled.
BROADCAST_IDS = 1_000_000
ROUNDS = 60
SHINGLE = 5
#: At similarity 0.8 a pair shares none of the bands with a chance of about 3 in a million.
BANDS, BAND_ROWS = 24, 4
SIGNATURE = BANDS * BAND_ROWS
#: Values of two signatures that must agree: a pair at similarity 0.8 misses that with a chance of 4 in 100 million, one at 0.4 meets it once in 1,000.
AGREE = 54
#: Bytes of shingle sets that one group of a task holds.
GROUP_BYTES = 8_000_000


def text_fingerprints(texts: list[str], width: int) -> np.ndarray:
    """The fingerprint of each text as int64: bit b is 1 if set in over half the shingle hashes."""
    digest = xxhash.xxh64_intdigest
    hashes, lengths = [], []
    for text in texts:
        words = lower_words(text)
        if len(words) < width:
            found = [digest(b" ".join(words), SEED)] if words else []
        else:
            found = [digest(x, SEED) for x in map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))]
        hashes += found
        lengths.append(len(found))
    lengths = np.array(lengths, dtype=np.int64)
    flat = np.array(hashes, dtype=np.uint64)
    out = np.zeros(len(texts), dtype=np.uint64)
    for b in range(64):
        ones = segment_sums(((flat >> np.uint64(b)) & np.uint64(1)).astype(np.int64), lengths)
        out |= (2 * ones > lengths).astype(np.uint64) << np.uint64(b)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", width: int = 3, name: str = "fp") -> DataFrame:
    """Columns keep and `name` (the fingerprint's 64 bits as a long) of every row."""
    return map_texts(docs, text_col, keep, {name: "long"}, lambda: lambda texts: [text_fingerprints(texts, width)])


def _variants(seen: DataFrame) -> DataFrame:
    """(seg, pos, val, fp): seg 0 the high half, 1 the low half, val the half without bit pos."""
    halves = F.array(F.struct(F.lit(0).alias("seg"), F.shiftrightunsigned("fp", 32).cast("long").alias("half")), F.struct(F.lit(1).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("half")))
    x = seen.select("fp", F.explode(halves).alias("h")).select("fp", "h.seg", "h.half")
    wild = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("pos"), F.call_function("shiftleft", F.lit(1).cast("long"), i).alias("bit")))
    y = x.select("fp", "seg", "half", F.explode(wild).alias("w"))
    value = F.col("half").bitwiseAND(F.bitwise_not(F.col("w.bit")))
    return y.select((value * 64 + F.col("seg") * 32 + F.col("w.pos")).alias("key"), "fp")


def forest(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (smaller, larger) that connect what is linked among members, at most one fewer than members."""
    members = np.unique(members.view(np.uint64))
    left = np.ones(len(members), dtype=bool)
    links = []
    for root in range(len(members)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            at = front.pop()
            near = np.flatnonzero(left & (np.bitwise_count(members ^ members[at]) <= bits))
            left[near] = False
            front.extend(near.tolist())
            links += [(members[at], members[j]) for j in near.tolist()]
    return [tuple(sorted(int(v) for v in np.array(x, dtype=np.uint64).view(np.int64))) for x in links]


def links(seen: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) fingerprints, a < b, at most `bits` apart, that connect all linked fingerprints of seen (distinct `fp`)."""
    if bits > BITS:
        raise ValueError("two segments with one wildcard each cover at most 3 differing bits")
    ship(seen.sparkSession)
    # 64 rows come of each row of this narrow table, so it is dealt out before.
    keyed = _variants(seen.repartition(max(1, -(-seen.count() // VARIANT_ROWS)), "fp"))
    sizes = keyed.groupBy("key").agg(F.count("fp").alias("n")).filter("n > 1")
    # Variants are 64 rows a fingerprint, more than Spark's estimate from the table's size: never broadcast them.
    shared = cut(keyed.join(sizes.hint("merge"), "key"), "simhash-buckets")
    small = shared.filter(F.col("n") <= BLOCK).select("key", F.lit(-1).alias("sub"), F.lit(0).alias("p"), F.lit(0).alias("q"), "fp")
    other = F.when(F.col("key").bitwiseAND(32) == 0, F.col("fp")).otherwise(F.shiftrightunsigned("fp", 32))
    bytes_ = F.array(*(F.shiftrightunsigned(other, 8 * k).bitwiseAND(255).cast("int") + 256 * k for k in range(4)))
    parted = shared.filter(F.col("n") > BLOCK).select("key", "fp", F.explode(bytes_).alias("sub"))
    heavy = parted.groupBy("key", "sub").agg(F.count("fp").alias("m")).filter("m > 1")
    blocks = F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / (BLOCK // 2)).cast("int")).otherwise(1)
    large = parted.join(heavy, ["key", "sub"]).withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    large = large.select("key", "sub", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("with"))
    large = large.select("key", "sub", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"), "fp")
    groups = small.unionAll(large).groupBy("key", "sub", "p", "q").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            values, ends = lists.flatten().to_numpy(), np.cumsum([len(x) for x in lists])
            sizes = np.diff(np.r_[0, ends])
            found = []
            two = np.flatnonzero(sizes == 2)  # most buckets: one pair
            a, b = values[ends[two] - 2], values[ends[two] - 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= bits
            for k in np.flatnonzero(sizes > 2).tolist():
                found += forest(values[ends[k] - sizes[k] : ends[k]], bits)
            more = np.array(found, dtype=np.int64).reshape(-1, 2)
            pairs = np.unique(np.r_[np.c_[np.minimum(a, b), np.maximum(a, b)][near], more], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], type=pa.int64()), pa.array(pairs[:, 1], type=pa.int64())], names=["a", "b"])

    found = cut(groups.select("fps").mapInArrow(run, "a long, b long").distinct(), "simhash-links")
    discard(shared)
    return found


def components(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, root) of every node of edges (a, b) but the roots themselves: root is the smallest node that it reaches. Large-star and small-star
    rounds, each written to the shared folder, until a round changes nothing."""
    now = cut(edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "star")
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large.selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, now = now, cut(small.filter("a <> b").distinct(), "small-star")
        discard(before, large)
        was, mark = mark, tuple(now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == was:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes of the distinct five-word shingles of all texts in turn, number of each); a shorter text has its words together, a wordless one nothing."""
    words, numbers = word_hashes(pa.array(texts, pa.large_string()))
    first = np.cumsum(numbers) - numbers
    hashes, owner = [], []
    for n in range(1, SHINGLE + 1):
        # n words together: all places of texts with SHINGLE words and more, the one place of shorter ones
        of = np.flatnonzero(numbers >= n) if n == SHINGLE else np.flatnonzero(numbers == n)
        places = numbers[of] - n + 1
        doc = np.repeat(of, places)
        at = np.repeat(first[of], places) + np.arange(len(doc)) - np.repeat(np.cumsum(places) - places, places)
        made = words[at]
        for k in range(1, n):
            made = mix(made, words[at + k])
        hashes.append(made)
        owner.append(doc)
    flat, doc = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), dtype=bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new], np.bincount(doc[new], minlength=len(texts))


def _set_digests(flat: np.ndarray, counts: np.ndarray) -> list[int]:
    ends = np.cumsum(counts)
    found = [xxhash.xxh64_intdigest(flat[a:b].tobytes(), SEED) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
    return np.array(found, dtype=np.uint64).view(np.int64).tolist()


_DRAW = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * BAND_ROWS), dtype=np.uint64)


def set_bands(flat: np.ndarray, counts: np.ndarray) -> tuple[list[list[int]], list[bytes]]:
    """(a hash of each band of MinHash values, the two low bytes of each value) of each set; nothing for an empty one."""
    full = np.flatnonzero(counts)
    out: list[list[int]] = [[] for _ in counts]
    signs = [b""] * len(counts)
    if not len(full):
        return out, signs
    starts = (np.cumsum(counts) - counts)[full]
    bands, low = np.empty((len(full), BANDS), dtype=np.uint64), np.empty((len(full), SIGNATURE), dtype=np.uint16)
    for band in range(BANDS):
        held = np.full(len(full), band, dtype=np.uint64)
        for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            x = (flat ^ _DRAW[1, k]) * (_DRAW[0, k] | np.uint64(1))
            least = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15), starts)
            low[:, k] = (least ^ (least >> np.uint64(48))) & np.uint64(0xFFFF)
            held = mix(held, least)
        bands[:, band] = held
    for k, values, sign in zip(full.tolist(), bands.view(np.int64).tolist(), low, strict=True):
        out[k], signs[k] = values, sign.tobytes()
    return out, signs


def similar_forest(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (i, j) that connect what is linked among count members, at most one fewer than members. near(i, others): which of others are linked to i."""
    left = np.ones(count, dtype=bool)
    found = []
    for root in range(count):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            at = front.pop()
            others = np.flatnonzero(left)
            met = others[near(at, others)]
            left[met] = False
            front.extend(met.tolist())
            found += [(at, j) for j in met.tolist()]
    return found


def alike(signs: np.ndarray, sizes: np.ndarray, similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which sets may be similar to one, by signatures (a row each) and sizes."""

    def near(at: int, others: np.ndarray) -> np.ndarray:
        fits = np.minimum(sizes[others], sizes[at]) >= similarity * np.maximum(sizes[others], sizes[at])
        return fits & ((signs[others] == signs[at]).sum(axis=1) >= AGREE)

    return near


def similar_sets(sets: list[np.ndarray], similarity: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """Which sets are similar to one; signatures first."""
    _, signs = set_bands(np.concatenate(sets), np.array([len(s) for s in sets]))
    may = alike(np.frombuffer(b"".join(signs), np.uint16).reshape(len(sets), -1), np.array([len(s) for s in sets]), similarity)

    def near(at: int, others: np.ndarray) -> np.ndarray:
        fits = may(at, others)
        for k in np.flatnonzero(fits).tolist():
            other = sets[others[k]]
            both = len(np.intersect1d(sets[at], other, assume_unique=True))
            fits[k] = both >= similarity * (len(sets[at]) + len(other) - both)
        return fits

    return near


def _linked_groups(rows: DataFrame, key: list[str], node: str, payload: str, size: str, near: Callable) -> DataFrame:
    """(a, b) links between the nodes of each group of rows (key, node, payload, size) that connect what near(payloads, sizes) links. Rows of a group
    come one after the other, repeated nodes once; one group at a time is held."""
    ship(rows.sparkSession)

    def links_of(nodes, payloads, sizes):
        return [(nodes[i], nodes[j]) for i, j in similar_forest(len(nodes), near(payloads, sizes))] if len(nodes) > 1 else []

    def out(found):
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], type=pa.int64()), pa.array(pairs[:, 1], type=pa.int64())], names=["a", "b"])

    def run(batches):
        group, nodes, payloads, sizes = None, [], [], []
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(key))), strict=True))
            ids, numbers, held = (batch.column(len(key) + i) for i in range(3))
            ids, numbers = ids.to_pylist(), numbers.to_pylist()
            for i, now in enumerate(keys):
                if now != group:
                    found += links_of(nodes, payloads, sizes)
                    group, nodes, payloads, sizes = now, [], [], []
                if not nodes or nodes[-1] != ids[i]:
                    nodes.append(ids[i])
                    payloads.append(held[i].as_py())
                    sizes.append(numbers[i])
            yield out(found)
        yield out(links_of(nodes, payloads, sizes))
        nodes, payloads, sizes = [], [], []
        give_back()

    dealt = rows.select(*key, node, size, payload).repartition(*key).sortWithinPartitions(*key, node)
    return dealt.mapInArrow(run, "a long, b long")


def _near(ids: DataFrame) -> DataFrame:
    """A table of ids (its first column), to be broadcast if it is small enough, in rows and in bytes."""
    n, size = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(ids.columns[0]).cast("string"))), F.lit(0))).first()
    return F.broadcast(ids) if n <= BROADCAST_IDS and size <= 16 * BROADCAST_IDS else ids


def shingle_marks(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id_col, fp, digest, bands, sign, size) of every row: the fingerprint, a digest of the five-word shingle set, its MinHash bands, signature and size."""

    def marks(texts):
        flat, counts = shingle_sets(texts)
        return [text_fingerprints(texts, width), _set_digests(flat, counts), *set_bands(flat, counts), counts]

    return map_texts(docs, text_col, [id_col], {"fp": "long", "digest": "long", "bands": "array<long>", "sign": "binary", "size": "long"}, lambda: marks)


def _dealt(rows: DataFrame, number: Column, key: str) -> DataFrame:
    """rows with p and q: of `number` blocks, by a hash of key, each row goes to the pairs of its own block with every block."""
    dealt = rows.withColumn("nb", number).withColumn("own", F.pmod(F.xxhash64(key), F.col("nb")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    return dealt.withColumns({"p": F.least("own", "other"), "q": F.greatest("own", "other")}).drop("nb", "own", "other")


def _candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(node, root): digests that may be similar to others, by components of what shares a band and has like signatures."""
    keyed = nodes.select("digest", F.posexplode("bands").alias("band", "key"))
    # Buckets are counted before anything is gathered.
    shared = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(keyed.join(shared, ["band", "key"]), "shingle-buckets")
    marks = nodes.select("digest", "sign", "size")
    # Similar sets are alike in size: of the classes by powers of 1 / similarity they share their own or the next.
    step = F.floor(F.log("size") / float(-np.log(similarity)) + 1e-9).cast("int")
    small = members.filter(F.col("n") <= BLOCK).select("digest", "band", "key", F.lit(-1).alias("step"), F.lit(1).alias("nb"))
    large = members.filter(F.col("n") > BLOCK).join(nodes.select("digest", "size"), "digest").select("digest", "band", "key", F.explode(F.array(step, step + 1)).alias("step"))
    counts = large.groupBy("band", "key", "step").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    blocks = F.when(F.col("m") > BLOCK, F.ceil(F.col("m") / (BLOCK // 2)).cast("int")).otherwise(1)
    large = large.join(counts, ["band", "key", "step"]).select("digest", "band", "key", "step", blocks.alias("nb"))
    dealt = _dealt(small.unionAll(large), F.col("nb"), "digest").join(marks, "digest")
    read = lambda signs, sizes: alike(np.frombuffer(b"".join(signs), np.uint16).reshape(len(signs), SIGNATURE), np.array(sizes), similarity)
    found = cut(_linked_groups(dealt, ["band", "key", "step", "p", "q"], "digest", "sign", "size", read).distinct(), "shingle-candidates")
    discard(members)
    return components(found)


def similar_links(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """(a, b) fingerprints of texts whose five-word shingle sets are similar, enough to connect all that are. marked: a table of docs' shingle_marks."""

    def contents(texts):
        flat, counts = shingle_sets(texts)
        ends = np.cumsum(counts)
        return [_set_digests(flat, counts), [flat[a:b].tobytes() for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]]

    # Of equal sets one row is looked at again: that of the smallest id, or any without an id.
    nodes = cut(marked.groupBy("digest").agg(F.min("fp").alias("node"), F.min(id_col).alias("one"), F.first("bands").alias("bands"), F.first("sign").alias("sign"), F.first("size").alias("size")), "shingle-nodes")
    equal = marked.select("digest", "fp").distinct().join(nodes.select("digest", "node"), "digest").select(F.col("node").alias("a"), F.col("fp").alias("b"))
    grouped = cut(_candidates(nodes, similarity), "shingle-grouped")
    roots = grouped.select(F.col("node").alias("digest"), "root").unionAll(grouped.select(F.col("root").alias("digest"), "root").distinct())
    wanted = roots.join(nodes.select("digest", "node", "one", "size"), "digest")
    weight = wanted.groupBy("root").agg((8 * F.sum("size")).alias("bytes"))
    blocks = F.when(F.col("bytes") > GROUP_BYTES, F.ceil(2 * F.col("bytes") / GROUP_BYTES).cast("int")).otherwise(1)
    wanted = cut(wanted.join(weight, "root").select("digest", "node", "one", "size", "root", blocks.alias("nb")), "shingle-wanted")
    ids = _near(cut(wanted.filter("one IS NOT NULL").select("one").distinct(), "shingle-ids"))
    some = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    some = some.join(ids, F.col("i") == F.col("one"), "left_semi").unionAll(some.filter("i IS NULL"))
    held = map_texts(some, "t", [], {"digest": "long", "shingles": "binary"}, lambda: contents)
    dealt = _dealt(held.join(wanted.select("digest", "node", "size", "root", "nb"), "digest"), F.col("nb"), "digest")
    # Nodes of one fingerprint may have different sets, so groups are of digests.
    verify = lambda sets, _: similar_sets([np.frombuffer(x, dtype=np.uint64) for x in sets], similarity)
    found = cut(_linked_groups(dealt, ["root", "p", "q"], "digest", "shingles", "size", verify).distinct(), "shingle-links")
    name = lambda c: wanted.select(F.col("digest").alias(c), F.col("node").alias(f"{c}n"))
    named = found.join(name("a"), "a").join(name("b"), "b").select(F.col("an").alias("a"), F.col("bn").alias("b"))
    return named.unionAll(equal).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """(id_col, fp, root, component_id, chosen) of every row; root is the smallest fingerprint of the component, chosen the fingerprint, smallest of those with component_id, whose row of that id stands for it."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = fingerprints(docs, ["id"], "text", width) if similarity is None else shingle_marks(docs, "id", "text", width)
    marked = cut(made, "fingerprints")
    nodes = cut(marked.groupBy("fp").agg(F.min("id").alias("first")), "fingerprint-nodes")
    linked = links(nodes.select("fp"), bits)
    if similarity is not None:
        linked = linked.unionAll(similar_links(docs, marked, "id", "text", similarity))
    roots = cut(components(linked), "roots")
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min(F.struct(F.isnull("first").alias("none"), "first", "fp")).alias("least"))
    owners = cut(rooted.join(least, "root").select("fp", "root", F.col("least.first").alias("component_id"), F.col("least.fp").alias("chosen")), "components")
    return marked.join(owners, "fp", "left").select(F.col("id").alias(id_col), "fp", "root", "component_id", "chosen")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """One row of each component of near-duplicates: a row of its smallest id and, of several texts under that id, of the smallest
    fingerprint; of rows alike in both, the one of lowest hash. Ids are no keys: (5, A), (7, A), (3, B), (5, B) leaves (5, A) and
    (3, B). A component of rows without an id keeps one of them.
    """
    # Columns go by place, so no name can clash.
    given = docs.columns
    names = [f"c{i}" for i in range(len(given))]
    id_col, text_col = names[given.index(id_col)], names[given.index(text_col)]
    docs = docs.toDF(*names)
    found = cut(near_duplicates(docs, id_col, text_col, width, bits, similarity), "near-duplicates")
    stands = F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("fp") == F.col("chosen"))
    # A row is known by an id that no other row has. All rows of other ids are looked at anew, by their fingerprints.
    per_id = found.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.count(F.lit(1)).alias("__n"), F.bool_and(stands).alias("__stays"))
    gone = cut(per_id.filter("__n > 1 OR NOT __stays").select("__id", "__n"), "goes")
    sure = docs.filter(F.col(id_col).isNotNull()).join(_near(gone.select("__id")), docs[id_col] == F.col("__id"), "left_anti").select(*names)
    chosen = cut(found.filter(stands).select(F.col(id_col).alias("__id"), F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct(), "chosen")
    repeated = docs.join(_near(gone.filter("__n > 1").select("__id")), docs[id_col] == F.col("__id"), "left_semi").select(*names).unionAll(docs.filter(F.col(id_col).isNull()))
    marked = fingerprints(repeated, names, text_col, width, "__own_fp")
    again = marked.join(chosen, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own_fp") == F.col("__fp")))
    one = again.groupBy("__root").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("__row"))
    return sure.unionAll(one.select(*(F.col("__row").getField(c).alias(c) for c in names))).toDF(*given)
