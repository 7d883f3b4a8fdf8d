"""Language identification by rank-order profiles of letter n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from harborline.llm.common import map_rows, sliced
from harborline.session import spool

#: Ranks kept of a language and of a document.
PROFILE = 400
#: Most languages a table of profiles may hold; beyond it training stops with an error.
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
_WORD_EDGE = 1


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (n = 1 to 3) of the lower-cased letters of a whole text, with counts.

    Everything else is a word edge; edges are part of bigrams and trigrams, but no
    gram spans two words. A gram is its code points, 21 bits each.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(_letters()[points], points, _WORD_EDGE).astype(np.int64)
    points = np.concatenate([[_WORD_EDGE], points, [_WORD_EDGE]])
    points = points[np.concatenate([[True], (points[1:] != _WORD_EDGE) | (points[:-1] != _WORD_EDGE)])]
    if len(points) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # Narrow keys sort faster; the code is the same for every text once widened.
    bits = 10 if points.max() < 1024 else 21
    inner = points[1:-1] != _WORD_EDGE
    grams = [
        points[points != _WORD_EDGE],
        (points[:-1] << bits) | points[1:],
        ((points[:-2] << (2 * bits)) | (points[1:-1] << bits) | points[2:])[inner],
    ]
    keys, counts = [], []
    for n, own in enumerate(grams):
        key, count = np.unique(own.astype(np.int32) if bits == 10 else own, return_counts=True)
        key = key.astype(np.int64)
        if bits == 10:
            key = sum(((key >> (10 * k)) & 1023) << (21 * k) for k in range(n + 1))
        keys.append(key)
        counts.append(count)
    return np.concatenate(keys), np.concatenate(counts)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams in rank order; ties by gram."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))][:size]


class Profiles:
    """Ranks of grams by language, for out-of-place distances."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({lang for lang, _, _ in rows}, key=str.encode)
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, np.int64)
        number = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[number[lang], np.searchsorted(self.grams, gram)] = rank

    def nearest(self, grams: np.ndarray) -> tuple[str, float]:
        """The language of least out-of-place distance, and 1 - its share of the largest distance.

        A gram that a profile lacks counts as ``size`` places; ties go to the first
        language by code point.
        """
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        at = np.where(self.grams[at] == grams, at, len(self.grams))
        there = self.ranks[:, at]
        places = np.where(there < 0, self.size, np.abs(there - np.arange(len(grams))))
        totals = places.sum(axis=1)
        k = int(totals.argmin())
        return self.langs[k], 1.0 - float(totals[k]) / (self.size * len(grams))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): profiles from all labelled texts, null texts and languages left out.

    Each task adds up the counts of its texts per language before anything is shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0
        for langs, texts in sliced(batches):
            for name in set(langs):
                joined = "\n".join(t for x, t in zip(langs, texts, strict=True) if x == name)
                held.setdefault(name, []).append(gram_counts(joined))
                rows += len(held[name][-1][0])
            if rows > 2_000_000:
                yield from sent(held)
                held, rows = {}, 0
        yield from sent(held)

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for name, parts in held.items():
            keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([c for _, c in parts])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return spool(
        counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank")),
        "profiles",
    )


def predict(docs: DataFrame, profiles: DataFrame, keys: list[str], text: str = "text", size: int = PROFILE) -> DataFrame:
    """(keys, lang_pred, score) for every row, from its whole text alone.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. The profiles, at most ``size`` rows for each of at most
    ``MAX_LANGUAGES`` languages, go to every task.
    """
    spark = docs.sparkSession
    if profiles.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    known = spark.sparkContext.broadcast([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()])

    def rows(*columns: list) -> Iterable[tuple]:
        if not held:
            held.append(Profiles(known.value, size))
        for *own, t in zip(*columns, strict=True):
            yield *own, *held[0].nearest(ranked(*gram_counts(t or ""), size))

    held: list[Profiles] = []
    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return map_rows(docs.select(*keys, text), rows, f"{kinds}, lang_pred string, score double")


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id mod 4 is 2, or it has no id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score (0 to 1).

    Profiles are learned from the labelled documents that are not held out; labels,
    keys and other columns take no part in a prediction. Null keys count as held out.
    Repeated rows are each learned from and predicted; an empty table gives no rows.
    """
    profiles = train(docs.where(~held_out(key)), text, lang)
    return predict(docs, profiles, [key], text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
