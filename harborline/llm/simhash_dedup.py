"""SimHash near-duplicates, found with Burkhard-Keller trees over the fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from harborline.llm.common import Union, components, groups_of, map_rows
from harborline.session import spool

BITS = 64


def fingerprint(text: str | None, shingle: int) -> int:
    """The SimHash of the word shingles of a whole text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0].astype(np.uint64).astype(np.int64))


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(key, print) for every row; XXH64 of shingles with seed 42, words as in bytes.split."""

    def rows(ids: list, texts: list) -> Iterable[tuple]:
        return [(i, fingerprint(t, shingle)) for i, t in zip(ids, texts, strict=True)]

    return map_rows(docs.select(F.col(key).cast("bigint"), F.col(text)), rows, "id bigint, print bigint")


def shard_keys(distance: int, blocks: int) -> Column:
    """Shards of a fingerprint: every choice of ``blocks - distance`` whole blocks of its bits.

    Two fingerprints that differ in at most ``distance`` bits agree in at least
    ``blocks - distance`` blocks, so they meet in one shard at least.
    """
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(0).cast("bigint")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            part = F.shiftrightunsigned(F.col("print"), BITS - edges[b + 1]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(part)
        keys.append(key.bitwiseOR(F.lit(number << 48)))
    return F.array(*keys)


class BKTree:
    """Children of a node are keyed by their Hamming distance to it."""

    def __init__(self, value: int, name: int) -> None:
        self.root: tuple[int, int, dict] = (value, name, {})

    def add(self, value: int, name: int, radius: int, hits: int | None = None) -> list[int]:
        """Insert a value; the names of those within the radius of it, or the first so many met.

        Only edges whose distance is within ``radius`` of the distance to the
        parent can lead to a hit.
        """
        near: list[int] = []
        open_nodes = [self.root]
        while open_nodes and len(near) != hits:
            there, label, children = open_nodes.pop()
            d = (value ^ there).bit_count()
            if d <= radius:
                near.append(label)
            if children:
                if len(children) <= 2 * radius:
                    open_nodes += [c for edge, c in children.items() if d - radius <= edge <= d + radius]
                else:
                    open_nodes += [children[e] for e in range(d - radius, d + radius + 1) if e in children]
        node = self.root
        while True:
            d = (value ^ node[0]).bit_count()
            child = node[2].get(d)
            if child is None:
                node[2][d] = (value, name, {})
                return near
            node = child


def shard_links(prints: DataFrame, distance: int, blocks: int, radius: int | None = None, hits: int | None = None) -> DataFrame:
    """Links (a, b) that join all fingerprints within the distance, no pair list.

    Each shard gets a tree; a fingerprint is looked up as it is inserted, and only
    links that join two parts of a shard leave it, so a dense group of n
    fingerprints gives n - 1 links. A ``radius`` beyond the distance links what
    meets in a shard up to it; with ``hits`` a lookup ends after so many.
    """
    mask = (1 << BITS) - 1
    radius = distance if radius is None else radius

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, values, names in groups_of(batches):
            union, tree = Union(), None
            for value, name in zip(values.tolist(), names.tolist(), strict=True):
                value &= mask
                if tree is None:
                    tree = BKTree(value, name)
                    continue
                for other in tree.add(value, name, radius, hits):
                    if union.find(other) != union.find(name):
                        union.join(other, name)
                        a.append(name)
                        b.append(other)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b})
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return (
        prints.select(F.explode(shard_keys(distance, blocks)).alias("shard"), "print", "name")
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(search, "a bigint, b bigint")
    )


def simhash_dedup(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    distance: int = 4,
    blocks: int = 6,
) -> DataFrame:
    """One row per input row: key, fingerprint (16 hex digits), component_id, kept.

    Texts are lower-cased in A-Z only and split at ASCII white space; a text without
    words has the fingerprint zero, which links like any other. Fingerprints link at
    ``distance`` or fewer differing bits; ``component_id`` is the smallest key that
    links lead to. Equal fingerprints are merged before the search, so groups of
    copies cost one tree node. Rows of a null key take part only through their
    fingerprint: they get the component of it (null if no row with a key has it or
    links to it). Rows that repeat a key are each reported. An empty table gives no
    rows; further columns are not looked at.

    The trees are not broadcast whole, since they grow with the corpus: each shard
    tree meets only the fingerprints that share its block bits, in one task.
    """
    prints = spool(fingerprints(docs, key, text, shingle), "fingerprints")
    named = spool(prints.where("id is not null").groupBy("print").agg(F.min("id").alias("name")), "prints")
    links = spool(shard_links(named, distance, blocks), "print-links")
    labels = components(links, "print-components")
    roots = (
        named.join(labels.withColumnRenamed("id", "name"), "name", "left")
        .select("print", F.coalesce("root", "name").alias("component_id"))
    )
    return prints.join(roots, "print", "left").select(
        F.col("id").alias(key),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group; rows with a null key stay."""
    gone = spool(simhash_dedup(docs, key, text, **settings).where(f"{key} <> component_id").select(key).distinct(), "near-copies")
    return docs.join(gone, key, "left_anti").select(docs.columns)
