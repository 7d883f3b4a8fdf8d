"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.operators.ranking import number_rows
from harborline.session import spool

#: Weights of the sources in code point order, repeating; null comes last.
WEIGHTS = (5, 2, 1)
#: Most times a source, and so a document, may be taken.
MAX_REPEATS = 3
#: Cells of the dynamic program; a larger budget is settled in units of so many parts first, then what is left of it.
PROGRAM_CELLS = 1 << 22
#: Parts of the documents of one source and size, so that no window holds a hot group.
PARTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, size) rows.

    Sources share the sum of all sizes by weight; a target stops at ``most`` times
    its source, and the excess is shared again by weight until none is above. Each
    round brings three sums to the driver.
    """
    totals = spool(sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size")), "source-sizes")
    numbered = number_rows(totals, ["source"], name="place").rows
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = spool(numbered.select("source", "source_size", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * most
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share = 0.0
    while True:
        # Sources at their cap under the present share stay there, as the share only grows.
        capped = F.lit(share) * F.col("weight") > cap
        free, spent = sources.agg(F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, cap))).first()
        grown = (total - (spent or 0)) / free if free else share
        if grown == share or not free:
            break
        share = grown
    return sources.select("source", "source_size", F.least(cap.cast("double"), F.lit(share) * F.col("weight")).alias("target"))


def _program(sizes: Sequence[int], room: Sequence[int], budget: int) -> list[int]:
    """How many of each size to add so that the sum comes nearest to the budget from below.

    Bounded knapsack over all sums up to the budget: documents of a size are offered in
    lots of 1, 2, 4, ...; ``first`` holds the lot with which a sum was reached first, whose
    rest was reached by an earlier lot, so the way back needs nothing else.
    """
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    first = np.full(budget + 1, -1, np.int32)
    lots: list[tuple[int, int]] = []
    top = 0  # the largest sum that is reached
    for k in sorted((k for k, s in enumerate(sizes) if 0 < s <= budget and room[k]), key=lambda k: -sizes[k]):
        spare, lot = min(room[k], budget // sizes[k]), 1
        while spare > 0 and not reached[budget]:
            n = min(lot, spare)
            step = n * sizes[k]
            if step <= budget:
                high = min(top, budget - step)
                fresh = step + np.flatnonzero(reached[: high + 1] & ~reached[step : step + high + 1])
                reached[fresh] = True
                first[fresh] = len(lots)
                lots.append((k, n))
                top = min(budget, max(top, high + step))
            spare -= n
            lot *= 2
    out = [0] * len(sizes)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n = lots[first[at]]
        out[k] += n
        at -= n * sizes[k]
    return out


def fit_budget(sizes: Sequence[int], counts: Sequence[int], budget: int, total: int, passes: int = 1) -> list[int]:
    """How many documents of each size to take so that their sizes add up to the budget, or the nearest sum below it.

    First the same share of every size, rounded down; then a bounded-knapsack program over
    all of the budget that is left. Where that is beyond ``PROGRAM_CELLS``, sizes count in
    larger units, rounded up, and the program runs again over what the units left. A
    document counts again, up to ``passes`` times, only where taking each once leaves a
    rest.
    """
    take = [n * budget // total if total else 0 for n in counts]
    left = budget - sum(s * t for s, t in zip(sizes, take, strict=True))
    for limit in range(1, passes + 1):
        while left > 0:
            unit = -(-left // PROGRAM_CELLS)
            room = [max(0, n * limit - t) for n, t in zip(counts, take, strict=True)]
            more = _program([-(-s // unit) for s in sizes], room, left // unit)
            take = [t + m for t, m in zip(take, more, strict=True)]
            left -= sum(s * m for s, m in zip(sizes, more, strict=True))
            if unit == 1 or not any(more):
                break
    return take


def size_takes(histogram: DataFrame, most: int = MAX_REPEATS) -> DataFrame:
    """(source, size, times, extra): how often all documents of a size are taken, and how many once more.

    ``histogram`` has source, size, n, source_size and target: one row for each
    length that occurs in a source, however many documents there are.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        times = min(most, int(target // total)) if total else 0
        budget = 0 if times == most else min(total, round(target - times * total))
        group = group.sort_values("size")
        counts = group["n"].tolist()
        more = fit_budget(group["size"].tolist(), counts, budget, total, passes=max(1, most - times))
        whole = [times + m // n for m, n in zip(more, counts, strict=True)]
        return group[["source", "size"]].assign(times=whole, extra=[m % n for m, n in zip(more, counts, strict=True)])

    return histogram.groupBy("source").applyInPandas(fit, "source string, size bigint, times bigint, extra bigint")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most: int = MAX_REPEATS,
    seed: int = 42,
) -> DataFrame:
    """One row per input row: key, size, source_size, target, taken (words, repeats counted).

    Size is the number of words between ASCII white space; a null text has none, and
    documents without words are taken zero words of. Null is a source of its own and
    comes last. Within one source and length, documents are chosen by a seeded hash
    of the key (null keys hash alike), so reruns agree. Rows that repeat a key count
    and are chosen each on their own. An empty table gives no rows.
    """
    hashed = F.xxhash64(F.col(key).cast("bigint"), F.lit(seed))
    sized = spool(
        docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), hashed.alias("draw")),
        "sizes",
    )
    part = F.pmod(F.shiftright("draw", 20), F.lit(PARTS))
    sized = sized.withColumn("part", part)
    targets = spool(source_targets(sized, weights, most), "targets")
    parts = spool(sized.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n")), "size-parts")
    histogram = parts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same_source = F.col("h.source").eqNullSafe(F.col("t.source"))
    takes = size_takes(
        histogram.alias("h").join(targets.alias("t"), same_source).select("h.*", "source_size", "target"), most
    )
    # Of a size, all documents of the first parts and the first few of one more part.
    before = Window.partitionBy("p.source", "p.size").orderBy("p.part").rowsBetween(Window.unboundedPreceding, -1)
    open_rows = F.col("k.extra") - F.coalesce(F.sum("p.n").over(before), F.lit(0))
    chosen = spool(
        parts.alias("p")
        .join(takes.alias("k"), F.col("p.source").eqNullSafe(F.col("k.source")) & (F.col("p.size") == F.col("k.size")))
        .select("p.source", "p.size", "p.part", "p.n", "k.times", F.greatest(open_rows, F.lit(0)).alias("room")),
        "size-takes",
    )
    at = (
        F.col("d.source").eqNullSafe(F.col("c.source"))
        & (F.col("d.size") == F.col("c.size"))
        & (F.col("d.part") == F.col("c.part"))
    )
    rows = sized.alias("d").join(chosen.alias("c"), at).select("d.*", "n", "times", "room")
    place = F.row_number().over(Window.partitionBy("source", "size", "part").orderBy("draw", "id"))
    cut = rows.where("room > 0 and room < n").withColumn("more", (place <= F.col("room")).cast("bigint"))
    whole = rows.where("room = 0 or room >= n").withColumn("more", (F.col("room") >= F.col("n")).cast("bigint"))
    picked = cut.unionByName(whole)
    return (
        picked.alias("r")
        .join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        .select(
            F.col("r.id").alias(key),
            "r.size",
            "t.source_size",
            "t.target",
            (F.col("r.size") * (F.col("r.times") + F.col("r.more"))).alias("taken"),
        )
    )


def repeat_to_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the columns of ``docs``.

    Rows with a null key or without words go. Rows that repeat a key and a size are each
    taken as often as the most taken of them. An empty table gives no rows; columns of any
    name are carried.
    """
    mixed = mix_sources(docs, key, text, **settings).where("taken > 0")
    times = spool(
        mixed.groupBy(F.col(key).alias("mix_id"), F.col("size").alias("mix_size")).agg(F.max(F.expr("taken div size")).cast("int").alias("times")),
        "mix",
    )
    rows = docs.where(docs[key].isNotNull()).select(
        F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[key].alias("id"), words(docs[text]).alias("size")
    )
    # The list grows with the documents, so it is never broadcast.
    taken = rows.join(times.hint("merge"), (F.col("id") == F.col("mix_id")) & (F.col("size") == F.col("mix_size")))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
