"""Near-duplicate embeddings by small-world graphs per shard, with recall audits."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from harborline.llm.common import Union, components
from harborline.session import spool

#: Vectors in one graph, about; a larger label has more shards.
SHARD_ROWS = 8_192
#: Queries that one task sends through one graph, about.
QUERY_ROWS = 16_384
#: Links a node chooses when it comes in, and as many that later nodes may put in.
LINKS = 16
BUILD_BEAM = 64
FIRST_BEAM = 32
#: Beam nodes opened at once.
OPENED = 4
#: Queries of a task that are checked against all vectors of the shard, and the recall they must reach.
AUDITED = 256
RECALL = 0.999


class SmallWorld:
    """A hierarchical navigable small-world graph over unit vectors."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        #: Per layer: its nodes, and their links by row (-1 where there is none). Layer 0 holds all.
        self.vectors, self.layers = vectors, layers
        self.row = [self._rows(nodes) for nodes, _ in layers]
        self.stamp = np.zeros(len(vectors), np.int64)
        self.now = 0
        #: Links against their direction: where each node's begin, and their nodes.
        self.back: tuple[np.ndarray, np.ndarray] | None = None

    def _rows(self, nodes: np.ndarray) -> np.ndarray:
        row = np.full(len(self.vectors), -1, np.int64)
        row[nodes] = np.arange(len(nodes))
        return row

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int) -> SmallWorld:
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        heights = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(LINKS)).astype(int), 12)
        # The first node is on every layer, so there is always a way in.
        heights[0] = heights.max()
        layers = []
        for level in range(heights.max() + 1):
            nodes = np.flatnonzero(heights >= level)
            layers.append((nodes, np.full((len(nodes), 2 * LINKS), -1, np.int64)))
        graph = cls(vectors, layers)
        likeness = [np.full((len(nodes), LINKS), -np.inf) for nodes, _ in layers]
        for node in range(1, n):
            graph._insert(node, int(heights[node]), likeness)
        return graph

    def _insert(self, node: int, height: int, likeness: list[np.ndarray]) -> None:
        query = self.vectors[node]
        entry = np.array([0])
        for level in range(len(self.layers) - 1, -1, -1):
            found, near = self.beam(query, entry, BUILD_BEAM if level <= height else 1, level)
            entry = found
            if level > height:
                continue
            keep = self._spread(found, near)
            found, near = found[keep], near[keep]
            links, row = self.layers[level][1], self.row[level]
            # A node's own choice stays, so that no dense group closes itself off.
            links[row[node], : len(found)] = found
            # The other way: a free place, or that of the least alike.
            theirs = row[found]
            worst = likeness[level][theirs].argmin(axis=1)
            better = near > likeness[level][theirs, worst]
            links[theirs[better], LINKS + worst[better]] = node
            likeness[level][theirs[better], worst[better]] = near[better]

    def _spread(self, found: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Nearest first, those nearer to the query than to any one kept before; then the rest."""
        among = self.vectors[found] @ self.vectors[found].T
        kept: list[int] = []
        closest = np.full(len(found), -np.inf)
        for k in range(len(found)):
            if len(kept) == LINKS:
                break
            if near[k] > closest[k]:
                kept.append(k)
                np.maximum(closest, among[k], out=closest)
        if len(kept) < LINKS:
            taken = set(kept)
            kept += [k for k in range(len(found)) if k not in taken][: LINKS - len(kept)]
        return np.array(kept)

    def beam(
        self, query: np.ndarray, entry: np.ndarray, width: int, level: int, both_ways: bool = False
    ) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` most alike nodes that a beam search from ``entry`` meets, best first."""
        links, row, stamp = self.layers[level][1], self.row[level], self.stamp
        self.now += 1
        stamp[entry] = self.now
        ids = entry
        near = self.vectors[ids] @ query
        order = np.argsort(-near, kind="stable")[:width]
        ids, near = ids[order], near[order]
        closed = np.zeros(len(ids), bool)
        while True:
            opened = np.flatnonzero(~closed)[:OPENED]
            if not len(opened):
                return ids, near
            closed[opened] = True
            new = links[row[ids[opened]]].ravel()
            new = new[new >= 0]
            if both_ways:
                new = np.concatenate([new, self._linked_from(ids[opened])])
            new = new[stamp[new] != self.now]
            if not len(new):
                continue
            new = np.unique(new)
            stamp[new] = self.now
            ids = np.concatenate([ids, new])
            near = np.concatenate([near, self.vectors[new] @ query])
            closed = np.concatenate([closed, np.zeros(len(new), bool)])
            order = np.argsort(-near, kind="stable")[:width]
            ids, near, closed = ids[order], near[order], closed[order]

    def within(self, query: np.ndarray, least: float, width: int) -> np.ndarray:
        """Nodes at least as alike as ``least``: a beam search, then all links of what it found, both ways."""
        entry = np.array([0])
        for level in range(len(self.layers) - 1, 0, -1):
            entry = self.beam(query, entry, 1, level)[0]
        ids, near = self.beam(query, entry, width, 0, both_ways=True)
        found = ids[near >= least]
        # The beam has let go of nodes that it met, so the marks begin anew.
        links, stamp = self.layers[0][1], self.stamp
        self.now += 1
        stamp[found] = self.now
        fresh = found
        while len(fresh):
            new = links[fresh].ravel()
            new = np.unique(np.concatenate([new[new >= 0], self._linked_from(fresh)]))
            new = new[stamp[new] != self.now]
            stamp[new] = self.now
            fresh = new[self.vectors[new] @ query >= least]
            found = np.concatenate([found, fresh])
        return found

    def _linked_from(self, nodes: np.ndarray) -> np.ndarray:
        """Nodes with a link to one of ``nodes`` on the base layer."""
        if self.back is None:
            links = self.layers[0][1]
            start, end = np.nonzero(links >= 0)[0], links[links >= 0]
            self.back = np.searchsorted(np.sort(end), np.arange(len(self.vectors) + 1)), start[np.argsort(end, kind="stable")]
        begins, sources = self.back
        first = begins[nodes]
        counts = begins[nodes + 1] - first
        skipped = np.cumsum(counts) - counts
        return sources[np.repeat(first - skipped, counts) + np.arange(counts.sum())]

    def to_bytes(self) -> bytes:
        parts = {f"{kind}{k}": a.astype(np.int32) for k, layer in enumerate(self.layers) for kind, a in zip("nl", layer, strict=True)}
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> SmallWorld:
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            count = sum(name.startswith("n") for name in held.files)
            layers = [(held[f"n{k}"].astype(np.int64), held[f"l{k}"].astype(np.int64)) for k in range(count)]
            return cls(held["vectors"], layers)


def _unit(vectors: pd.Series) -> np.ndarray:
    rows = np.stack(vectors.to_numpy()).astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _links(graph: SmallWorld, queries: np.ndarray, least: float) -> Iterator[np.ndarray]:
    """For each query the linked nodes, the beam widened until the audited queries lose no links.

    Where even a beam as wide as the shard fails, all vectors are compared.
    """
    slack = least - 1e-9
    step = max(1, len(queries) // AUDITED)
    sample = range(0, len(queries), step)
    width = FIRST_BEAM
    while width < 2 * len(graph.vectors):
        hit = there = 0
        for k in sample:
            truth = np.flatnonzero(graph.vectors @ queries[k] >= slack)
            there += len(truth)
            hit += len(np.intersect1d(truth, graph.within(queries[k], slack, width), assume_unique=True))
        if hit >= RECALL * there:
            for q in queries:
                yield graph.within(q, slack, width)
            return
        width *= 2
    for q in queries:
        yield np.flatnonzero(graph.vectors @ q >= slack)


def sharded(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors: (label, vec, dim, name, n, shards, shard, blocks, block).

    A vector is usable if it has a key and a label, its parts are finite, and one is
    not zero. Equal vectors of a label are one, named by their smallest key.
    """
    number = F.col("vec")
    usable = (
        F.col("key").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("vec") > 0)
        & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(number, lambda x: x != 0)
    )
    distinct = spool(
        vectors.where(F.coalesce(usable, F.lit(False)))
        .groupBy("label", "vec")
        .agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("n"))
        .withColumn("dim", F.size("vec")),
        "vectors",
    )
    counts = distinct.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    dealt = F.xxhash64("name")
    return distinct.join(counts, ["label", "dim"]).select(
        *distinct.columns,
        F.ceil(F.col("rows") / SHARD_ROWS).cast("int").alias("shards"),
        F.ceil(F.col("rows") / QUERY_ROWS).cast("int").alias("blocks"),
        dealt.alias("draw"),
    ).withColumn("shard", F.pmod("draw", F.col("shards")).cast("int")).withColumn(
        "block", F.pmod(F.shiftright("draw", 24), F.col("blocks").cast("bigint")).cast("int")
    )


def graphs(vectors: DataFrame) -> DataFrame:
    """One row per shard: (label, dim, shard, names, counts, graph, blocks)."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("name")
        graph = SmallWorld.build(_unit(group["vec"]), seed=len(group))
        first = group.iloc[[0]][["label", "dim", "shard", "blocks"]]
        return first.assign(
            names=[group["name"].to_numpy(np.int64).tobytes()], counts=[group["n"].to_numpy(np.int64).tobytes()], graph=[graph.to_bytes()]
        )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.groupBy("label", "dim", "shard").applyInPandas(
        build, f"label {kind}, dim int, shard int, blocks int, names binary, counts binary, graph binary"
    )


def embedding_dedup(
    table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98
) -> DataFrame:
    """One row per input row: key, n_links, component_id, kept.

    Vectors of one label link when their cosine in double precision is at least
    ``least``. ``n_links`` counts other rows linked directly, ``component_id`` is the
    smallest key that links lead to, ``kept`` marks the row whose key that is. Null
    labels, null, empty or zero vectors and those with null or non-finite parts link
    with nothing, nor do vectors of different length. A null key takes no part and
    has no component. Equal vectors are searched once; rows that repeat a key count
    as rows. An empty table gives no rows; further columns are not looked at.

    Every vector is sent through the graph of every shard of its label.
    """
    rows = table.select(F.col(key).cast("bigint").alias("key"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    named = spool(sharded(rows), "shards")
    built = spool(graphs(named), "graphs")
    sent = named.select(
        "label", "dim", "name", "vec", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    )
    asked = built.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(queries: pd.DataFrame, graph_row: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(graph_row):
            held = graph_row.iloc[0]
            names, counts = (np.frombuffer(held[c], np.int64) for c in ("names", "counts"))
            graph = SmallWorld.from_bytes(held["graph"])
            queries = queries.sort_values("name")
            units, union = _unit(queries["vec"]), Union()
            for name, unit, found in zip(queries["name"].tolist(), units, _links(graph, units, least), strict=True):
                # The cosine itself, in double precision, decides.
                sure = found[graph.vectors[found] @ unit >= least]
                sure = sure[names[sure] != name]
                out.append((name, None, int(counts[sure].sum())))
                for other in names[sure].tolist():
                    union.join(name, other)
            out += [(a, b, 0) for a, b in union.links()]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype("Int64")

    place = ["label", "dim", "shard", "block"]
    found = spool(
        sent.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(search, "a bigint, b bigint, n bigint"), "vector-links"
    )
    roots = components(found.where("b is not null").select("a", "b"), "vector-components")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links"))
    answers = (
        named.join(counts, F.col("name") == F.col("a"), "left")
        .join(roots, F.col("name") == F.col("id"), "left")
        .select("label", "vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "name").alias("component"))
    )
    component = F.coalesce("component", "key")
    return rows.join(answers, ["label", "vec"], "left").select(
        F.col("key").alias(key),
        F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(F.col("key").isNotNull(), component).alias("component_id"),
        F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"),
    )
