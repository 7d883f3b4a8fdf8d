"""Near copies: SimHash fingerprints in Burkhard-Keller trees, checked by the exact Jaccard of word shingles.

What the trees cannot find is found by a prefix of each text's shingles, which loses no pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from harborline.llm import simhash_dedup
from harborline.llm.common import components, map_rows
from harborline.session import release, spool

SHINGLE = 5
#: Least Jaccard as a fraction of whole numbers, so that pairs are decided exactly.
LEAST = (4, 5)
#: Trees link fingerprints within so many bits that agree in two of so many blocks of bits.
RADIUS, BLOCKS = 12, 7
#: Frequent shingles that are put last: at most so many, each in so many texts or more.
FREQUENT, FREQUENT_TEXTS = 1 << 17, 32
#: Shingles that a task counts at once.
COUNT_BLOCK = 1_000_000
#: Bits of the filter that passes over texts without any candidate.
FILTER_BITS = 1 << 20
#: Rounds that compare each text of a group with one of them, before all pairs that are left;
#: those come at once where they are at most so many times the keys.
STAR_ROUNDS, PAIRS = 8, 32


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of a whole text, sorted; words as in ``simhash_dedup.fingerprint``.

    A shingle's hash is made of its words' hashes. A text of fewer words is one shingle,
    so texts without words are copies of each other.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    size = min(shingle, len(words))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out).view(np.int64)


def tree_pairs(nodes: DataFrame, text: str, shingle: int) -> DataFrame:
    """(a, b): pairs of texts (node, text) whose SimHash fingerprints are near, as Burkhard-Keller trees find them.

    A fingerprint is that of the distinct shingles of a text, a shard that of query 2 with
    other blocks. A lookup ends at the first fingerprint within the radius, so a dense
    group gives a few pairs a text; equal fingerprints are paired with one of them.
    """

    def rows(names: list, texts: list) -> Iterable[tuple]:
        return [(i, simhash_dedup.majority(shingle_hashes(t, shingle).view(np.uint64))) for i, t in zip(names, texts, strict=True)]

    prints = spool(map_rows(nodes.select("node", text), rows, "name bigint, print bigint"), "near-prints")
    named = spool(prints.groupBy("print").agg(F.min("name").alias("name")), "near-named")
    equal = prints.join(named.withColumnRenamed("name", "first"), "print").where("name <> first").select("first", "name")
    links = equal.union(simhash_dedup.shard_links(named, BLOCKS - 2, BLOCKS, RADIUS, hits=1)).toDF("a", "b")
    pairs = spool(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-tree-pairs")
    release(prints, named)
    return pairs


def _frequent(nodes: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Shingles of very many texts, the most frequent last: a bounded list that only sets the order of comparison.

    Every text is counted. A task sends on what it has met twice, so a shingle that is
    frequent anywhere is found, and one spread thinly over all tasks may stay unlisted.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1]), pa.array(n[n > 1])], ["h", "n"])

        for batch in batches:
            for value in batch.column(0):
                held.append(shingle_hashes(value.as_py(), shingle))
                size += len(held[-1])
                if size >= COUNT_BLOCK:
                    yield counted()
                    held.clear()
                    size = 0
        if held:
            yield counted()

    met = nodes.select(text).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = met.where(F.col("n") >= FREQUENT_TEXTS).orderBy(F.desc("n"), "h").limit(FREQUENT)
    return np.array([r["h"] for r in top.select("h").collect()], np.int64)[::-1]


def prefix_keys(nodes: DataFrame, text: str, shingle: int, frequent: np.ndarray) -> DataFrame:
    """(h, node, n, pos): of the n shingles of a text, the first in one order of all shingles, with their places.

    Two sets of the least Jaccard share that part of the larger one, so they share one of
    the first n - ceil(least n) + 1 shingles of either, in whatever order, if it is the same
    for all. Here it is the hash, after which come the frequent ones by their frequency, so
    that what most texts hold comes last.
    """
    up, down = LEAST
    place = np.argsort(frequent)
    listed = nodes.sparkSession.sparkContext.broadcast((frequent[place], place))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, place = listed.value
        for batch in batches:
            for node, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(value.as_py(), shingle)
                n = len(h)
                if len(late):
                    at = np.minimum(np.searchsorted(late, h), len(late) - 1)
                    often = late[at] == h
                    h = np.concatenate([h[~often], h[often][np.argsort(place[at[often]])]])
                h = h[: n + (-n * up // down) + 1]
                same = [np.full(len(h), node), np.full(len(h), n, np.int32), np.arange(len(h), dtype=np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(h), *map(pa.array, same)], ["h", "node", "n", "pos"])

    return nodes.select("node", text).mapInArrow(run, "h bigint, node bigint, n int, pos int")


def _sets(nodes: DataFrame, text: str, shingle: int, pairs: DataFrame) -> DataFrame:
    """(node, held): all shingles of the texts of the pairs, each once, and of few other texts.

    The texts are marked in a filter of fixed size, which alone reaches the driver; where
    it is full, more texts pass, and the joins that follow leave them out.
    """
    bit = F.pmod("node", F.lit(FILTER_BITS))
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    marks = wanted.select(F.floor(bit / 8).cast("int").alias("byte"), (bit % 8).cast("int").alias("bit"))
    filled = np.zeros(FILTER_BITS // 8, np.uint8)
    for byte, bits in marks.groupBy("byte").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), "bit")).alias("bits")).collect():
        filled[byte] = bits
    byte = F.conv(F.hex(F.substring(F.lit(filled.tobytes()), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = nodes.where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                held = pa.array([shingle_hashes(value.as_py(), shingle)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), held], ["node", "held"])

    return marked.select("node", text).mapInArrow(run, "node bigint, held array<bigint>").dropDuplicates(["node"])


def _both(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (a, b) with what either holds, and how much of it both hold."""
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("node").alias(side), F.col("held").alias(f"held_{side}")), side)
    return pairs.withColumn("both", F.size(F.array_intersect("held_a", "held_b")))


def _enough(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share so many keys as the least Jaccard needs.

    At the least Jaccard two sets have at least least / (1 + least) of their sizes in common,
    so that their first shingles share that less what lies behind the prefix of the larger
    one, and one.
    """
    up, down = LEAST
    common = F.ceil((F.col("n_a") + F.col("n_b")) * up / F.lit(up + down))
    behind = F.ceil(F.greatest("n_a", "n_b") * up / F.lit(down))
    return pairs.where(F.col("both") >= common - behind + 1).select("a", "b")


def _near(strong: DataFrame, nodes: DataFrame, text: str, shingle: int) -> DataFrame:
    """The pairs whose Jaccard is at least the least: both / (|a| + |b| - both) >= up / down."""
    up, down = LEAST
    if strong.isEmpty():
        return strong
    sets = spool(_sets(nodes, text, shingle, strong), "near-sets")
    whole = F.col("both") * (up + down) >= (F.size("held_a") + F.size("held_b")) * up
    found = spool(_both(strong, sets).where(whole).select("a", "b"), "near-links")
    release(sets)
    return found


def _fit(n: Column, pos: Column, other: Column) -> Column:
    """Whether the shingles from a place on are as many as the least Jaccard needs in common with a text of ``other`` shingles."""
    up, down = LEAST
    return (n - pos) * (up + down) >= (n + other) * up


def near_components(nodes: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame | None:
    """(id, root) of the texts (node, text) that near copies join, roots left out; exact. None where there are none.

    The pairs of the trees are checked first, and those that are near copies join their
    texts. The rest is found by keys. Texts that share a key are a group. In a round each
    text of a group that is not yet joined throughout meets one of them, the one whose keys
    are shared most and that has not been met; what is joined needs no comparison any more.
    As soon as the pairs that are left are few beside the keys, or after some rounds, they
    are compared, all of them.

    The first shingle that two near copies share has all others that they share behind it,
    in both; so a pair is met only at a key behind which either holds as many as it needs.
    """
    frequent = _frequent(nodes, text, shingle)
    # Dealt by key once; counting and joining read the same exchange.
    dealt = prefix_keys(nodes, text, shingle, frequent).repartition("h")
    shared = dealt.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    keyed = spool(dealt.join(shared, "h").distinct(), "near-keys")
    most = keyed.count()
    keys = spool(keyed.groupBy("node").agg(F.collect_list("h").alias("held"), F.sum("m").alias("weight"), F.max("n").alias("n")), "near-lists")
    held = keys.select("node", "held")
    # Keys with the same texts, such as those of one passage, give the same pairs: the first of them is enough.
    mark = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    members = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("m"), *mark, F.min("pos").alias("first"), F.min("n").alias("least"))
    one = members.groupBy("m", "mark0", "mark1").agg(F.min_by("h", "first").alias("h"), F.min("least").alias("least")).select("h", "least")
    columns = ["h", "node", "n", "pos", "weight"]
    # Texts that fit with none of the group, not even with the smallest, need not be in it.
    groups = spool(keyed.drop("m").join(one, "h").where(_fit(F.col("n"), F.col("pos"), F.col("least"))), "near-groups")
    keyed = groups.join(keys.select("node", "weight"), "node").select(columns)
    links, labels, old = None, None, []

    def joined(strong: DataFrame) -> None:
        """Compare the pairs whole, and join the texts of those that are near copies."""
        nonlocal links, labels
        found = _near(strong, nodes, text, shingle)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links, "near-components")

    pairs = tree_pairs(nodes, text, shingle)
    for side in ("a", "b"):
        pairs = pairs.join(keys.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}")), side)
    fit = _fit(F.col("n_a"), F.lit(0), F.col("n_b")) & _fit(F.col("n_b"), F.lit(0), F.col("n_a"))
    joined(spool(_enough(_both(pairs.where(fit), held)), "near-strong"))
    for number in range(STAR_ROUNDS + 1):
        now = keyed.withColumn("root", F.col("node"))
        if labels is not None:
            now = keyed.join(labels.withColumnRenamed("id", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # A group of one component stays one; texts that were centres have met all others.
        parts = now.groupBy("h", "root").agg(F.count(F.lit(1)).alias("m"))
        groups = parts.groupBy("h").agg(F.sum("m").alias("m"), F.max(F.struct("m", "root")).alias("big")).where("m > big.m")
        now = spool(now.join(groups.select("h", "m", F.col("big.root").alias("big"), F.col("big.m").alias("big_m")), "h"), "near-open")
        release(*old)
        # Pairs with a text that is not of the largest component of its group.
        left = now.where("root <> big").agg(F.sum("m")).first()[0]
        if not left:
            break
        last = number >= STAR_ROUNDS or 0 < number and left <= PAIRS * most

        def sized(pairs: DataFrame) -> DataFrame:
            """Pairs of (node, n, pos) structs x and y in order, of sizes and places that allow the least Jaccard."""
            first = F.col("x.node") < F.col("y.node")
            names = (("a", F.least("x.node", "y.node")), ("b", F.greatest("x.node", "y.node")))
            sizes = (("n_a", F.when(first, F.col("x.n")).otherwise(F.col("y.n"))), ("n_b", F.when(first, F.col("y.n")).otherwise(F.col("x.n"))))
            fit = [_fit(F.col(f"{x}.n"), F.col(f"{x}.pos"), F.col(f"{y}.n")) for x, y in ("xy", "yx")]
            return pairs.where(fit[0] & fit[1]).select(*(c.alias(n) for n, c in (*names, *sizes))).distinct()

        if not last:
            # After the first round one of those texts, so that the group has one less of them.
            may = now if number == 0 else now.where("root <> big")
            centre = spool(may.groupBy("h").agg(F.max_by(F.struct("node", "n", "pos", "root"), F.struct("weight", "node")).alias("y")), "near-centres")
            met = now.withColumn("x", F.struct("node", "n", "pos")).join(centre, "h")
            pairs = sized(met.where("root <> y.root"))
            keyed = met.where("node <> y.node").select(columns)
            old = [now, centre]
        else:
            a, b = (now.select("h", F.struct("node", "n", "pos").alias(c), *(F.col(k).alias(f"{k}_{c}") for k in ("root", "big"))) for c in "xy")
            pairs = sized(a.where("root_x <> big_x").join(b, "h").where("root_x <> root_y and (root_y = big_y or x.node < y.node)"))
        pairs = spool(pairs, "near-pairs")
        joined(spool(_enough(_both(pairs, held)), "near-strong"))
        release(pairs)
        if last:
            break
    return labels


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies those of the smallest key.

    Candidates are the neighbours of SimHash fingerprints in Burkhard-Keller trees, then
    the texts that share keys and are not joined yet; every link is checked exactly. Two
    texts are near copies where the sets of their word shingles have a Jaccard of
    4/5 or more; groups are what near copies join. Words are as in query 2. Rows with
    a null key stay and join no others; rows that repeat key and text stay or go
    together. An empty table gives no rows; columns of any name are carried.
    """
    node = F.xxhash64(docs[key].cast("bigint"), docs[text])
    named = docs.where(docs[key].isNotNull()).select(node.alias("node"), docs[key].cast("bigint").alias("id"), docs[text].alias("text"))
    labels = near_components(named.select("node", "text"), "text", shingle)
    if labels is None:
        return docs
    both = labels.union(labels.select("root", "root")).distinct()
    ids = named.select("node", "id").distinct().join(both.withColumnRenamed("id", "node"), "node")
    least = ids.groupBy("root").agg(F.min("id").alias("least"))
    gone = spool(ids.join(least, "root").where("id > least").select(F.col("node").alias("gone")).distinct(), "near-copies")
    # The list grows with the documents, so it is never broadcast.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.when(docs[key].isNotNull(), node).alias("node"))
    return rows.join(gone.hint("merge"), F.col("node") == F.col("gone"), "left_anti").select("row.*")
