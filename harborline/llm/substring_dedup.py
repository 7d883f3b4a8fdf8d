"""Passages that earlier documents hold, found with an FM-index per shard."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from harborline.llm.common import map_rows, sliced
from harborline.session import spool

#: Words of the gram whose hash anchors a window in its shard.
ANCHOR_WORDS = 8
#: Low bits of an anchor's rank that hold its place in the text.
PLACE_BITS = 30
#: Words in one index; a shard with more is cut between anchors.
INDEX_WORDS = 150_000


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """Hashes of words, kept up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value


def segments(hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, window counts and anchor hashes of runs of windows with one anchor.

    The anchor of a window is its gram of least hash, so equal windows have equal
    anchors, wherever they stand.
    """
    grams = len(hashes) - anchor + 1
    with np.errstate(over="ignore"):
        mixed = np.zeros(grams, np.uint64)
        for j in range(anchor):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + grams]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (mixed & ~low) | np.arange(grams, dtype=np.uint64)
    width, span = window - anchor + 1, 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    place = (least & low).astype(np.int64)
    starts = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [len(place)]]))
    return starts, counts, mixed[place[starts]].view(np.int64)


def text_segments(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(anchor, digest, id, mark, start, windows) of the segments of every text.

    ``mark`` tells apart rows that repeat an id with another text.
    """

    def rows(ids: list, marks: list, texts: list) -> Iterable[tuple]:
        for i, mark, text in zip(ids, marks, texts, strict=True):
            words = words_of(text)
            if len(words) < window:
                continue
            hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            raw = hashes.tobytes()
            starts, counts, anchors = segments(hashes, window, anchor)
            for s, c, a in zip(starts.tolist(), counts.tolist(), anchors.tolist(), strict=True):
                yield a, xxhash.xxh3_128_digest(raw[8 * s : 8 * (s + c + window - 1)]), i, mark, s, c

    known = WordHashes()
    return map_rows(
        docs.select("id", "mark", "text"),
        rows,
        "anchor bigint, digest binary, id bigint, mark bigint, start int, windows int",
    )


class FMIndex:
    """Counts of a word sequence by backward search over a wavelet tree in levels.

    Suffixes are ordered by their first ``depth`` words, which is enough for patterns
    shorter than that. Bits are packed, with a count of ones before each 64. ``block``
    numbers the runs of suffixes that share their first ``window`` words.
    """

    def __init__(self, text: np.ndarray, documents: np.ndarray, window: int) -> None:
        self.size = n = len(text)
        self.levels = max(1, int(text.max()).bit_length())
        order, self.block = self._suffixes(text, window)
        self.starts = np.flatnonzero(np.diff(self.block, prepend=-1))
        self.ends = np.append(self.starts[1:], n)
        self.least = np.minimum.reduceat(documents[order], self.starts)
        column = text[order - 1]
        counts = np.bincount(text, minlength=1 << self.levels)
        self.before = np.cumsum(counts) - counts
        self.words, self.ones, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (column >> level) & 1
            packed = np.packbits(np.append(bits.astype(np.uint8), np.zeros(64 - n % 64, np.uint8)), bitorder="little")
            packed = packed.view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(bits.sum()))
            column = np.concatenate([column[bits == 0], column[bits == 1]])
        #: Where each word's run begins in the last level.
        self.home = np.zeros(1 << self.levels, np.int64)
        self.home = self._descend(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)

        def later(ranks: np.ndarray, step: int) -> np.ndarray:
            return np.concatenate([ranks[step:], np.zeros(min(step, n), ranks.dtype)])[:n]

        def dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
            ranks = np.empty(n, np.int64)
            ranks[order] = np.cumsum(new)
            return order, ranks

        ranks, depth = text.astype(np.int64), 1
        share = None
        while True:
            step = min(depth, window + 1 - depth)
            if depth < window <= depth + step or depth == window:
                share = ranks * (n + 2) + later(ranks, window - depth)
            order, ranks = dense(ranks * (n + 2) + later(ranks, step))
            depth += step
            if depth > window:
                break
        held = share[order]
        return order, np.cumsum(np.concatenate([[0], held[1:] != held[:-1]]))

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word = places >> 6
            mask = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.ones[k][word] + np.bitwise_count(self.words[k][word] & mask)
            places = np.where((symbols >> level) & 1, self.zeros[k] + ones, places - ones)
        return places - self.home[symbols]

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word in front."""
        both = self._descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        start = self.before[symbols]
        return start + both[: len(symbols)], start + both[len(symbols) :]


def index_block(found: list[tuple], window: int) -> Iterator[tuple]:
    """Stream the segments of one shard block through its index.

    Yields (anchor, digest, offsets, lengths, ids): runs of windows that also start
    in the document of that id, the smallest that holds them.
    """
    known: dict[bytes, int] = {}
    coded, owner = [], []
    for _, _, i, words in found:
        coded.append([known.setdefault(w, len(known) + 1) for w in words] + [0])
        owner.append(i)
    sizes = np.array([len(c) for c in coded])
    text = np.concatenate([np.array(c, np.int64) for c in coded])
    index = FMIndex(text, np.repeat(np.array(owner, np.int64), sizes), window)
    lengths, firsts = sizes - 1, np.cumsum(sizes) - sizes
    by_length = np.argsort(-lengths, kind="stable")
    least = np.full(len(text), np.iinfo(np.int64).max)
    low = np.zeros(len(found), np.int64)
    high = np.full(len(found), index.size, np.int64)
    for step in range(int(lengths.max())):
        # Lanes are ordered by length, so those still at work come first.
        lanes = by_length[: np.searchsorted(-lengths[by_length], -step, side="left")]
        at = firsts[lanes] + lengths[lanes] - 1 - step
        lo, hi = index.step(text[at], low[lanes], high[lanes])
        if step >= window - 1:
            # A match of the full window: widen it again to all suffixes that share the window.
            block = index.block[lo]
            least[at] = index.least[block]
            lo, hi = index.starts[block], index.ends[block]
        low[lanes], high[lanes] = lo, hi
    for (anchor, digest, _, _), first, length in zip(found, firsts.tolist(), lengths.tolist(), strict=True):
        ids = least[first : first + length - window + 1]
        cuts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        yield anchor, digest, cuts[:-1].tolist(), np.diff(cuts).tolist(), ids[cuts[:-1]].tolist()


def shard_matches(distinct: DataFrame, window: int) -> DataFrame:
    """Matches of every distinct segment within its shard, (anchor, digest, id, words)."""
    schema = "anchor bigint, digest binary, offsets array<int>, lengths array<int>, ids array<bigint>"

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for anchors, digests, ids, texts in sliced(batches):
            for a, d, i, t in zip(anchors, digests, ids, texts, strict=True):
                if size >= INDEX_WORDS and a != held[-1][0]:
                    yield sent(held)
                    held, size = [], 0
                words = t.split(b" ")
                held.append((a, d, i, words))
                size += len(words) + 1
        if held:
            yield sent(held)

    def sent(held: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = ["anchor", "digest", "offsets", "lengths", "ids"]
        columns = zip(*index_block(held, window), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return distinct.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(search, schema)


def covered_spans(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """(id, mark, starts, sizes): windows of each text that a smaller id also holds.

    ``docs`` has id, mark and text. ``starts`` are word numbers; a run of ``sizes``
    windows begins at each.
    """
    found = spool(text_segments(docs, window, anchor), "segments")
    # A window that two documents hold has an anchor that two documents hold.
    shared = found.groupBy("anchor").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = spool(shared.select("anchor"), "anchors")
    # Copies of a segment are one row from here on, held by their smallest document.
    distinct = (
        found.join(shared, "anchor", "left_semi")
        .groupBy("anchor", "digest")
        .agg(F.min(F.struct("id", "mark", "start", "windows")).alias("at"))
        .select("anchor", "digest", "at.*")
    )
    wanted = distinct.groupBy("id", "mark").agg(F.collect_list(F.struct("anchor", "digest", "start", "windows")).alias("wanted"))

    def cut(ids: list, texts: list, lists: list) -> Iterable[tuple]:
        for i, text, segs in zip(ids, texts, lists, strict=True):
            words = words_of(text)
            for s in segs:
                yield s["anchor"], s["digest"], i, b" ".join(words[s["start"] : s["start"] + s["windows"] + window - 1])

    cuts = map_rows(
        docs.join(wanted, ["id", "mark"]).select("id", "text", "wanted"),
        cut,
        "anchor bigint, digest binary, id bigint, words binary",
    )
    matches = spool(shard_matches(cuts, window), "matches")
    runs = matches.select("anchor", "digest", F.explode(F.arrays_zip("offsets", "lengths", "ids")).alias("run"))
    return (
        found.join(runs, ["anchor", "digest"])
        .where("run.ids < id")
        .groupBy("id", "mark")
        .agg(F.collect_list(F.struct((F.col("start") + F.col("run.offsets")).alias("start"), F.col("run.lengths").alias("size"))).alias("runs"))
        .select("id", "mark", F.col("runs.start").alias("starts"), F.col("runs.size").alias("sizes"))
    )


def substring_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, anchor: int = ANCHOR_WORDS
) -> DataFrame:
    """One row per input row: key, n_words, n_removed, kept_text (words joined by one space).

    A word goes if one of the windows of ``window`` words over it also starts in a
    document with a smaller key. Windows are judged on the input. Words are split at
    ASCII white space and compared unchanged; null texts have none. A row with a null
    key neither gives nor loses words. Rows that repeat a key are one document, and
    each is reported. An empty table gives no rows; further columns are not looked at.

    Texts are cut into segments of windows that share an anchor; a shard holds the
    distinct segments of its anchors, so equal windows meet in one shard and every
    text is streamed only through the shards that can match it.
    """
    base = docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    spans = spool(covered_spans(base.where("id is not null"), window, anchor), "spans")

    def rows(ids: list, texts: list, starts: list, sizes: list) -> Iterable[tuple]:
        for i, t, begin, size in zip(ids, texts, starts, sizes, strict=True):
            words = words_of(t)
            n = len(words)
            if not begin:
                yield i, n, 0, b" ".join(words).decode("utf-8", "surrogatepass")
                continue
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, np.array(begin), 1)
            np.add.at(change, np.array(begin) + np.array(size) + window - 1, -1)
            keep = np.cumsum(change[:-1]) == 0
            kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
            yield i, n, int(n - keep.sum()), kept.decode("utf-8", "surrogatepass")

    whole = base.join(spans, ["id", "mark"], "left").select("id", "text", "starts", "sizes")
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(whole, rows, "id bigint, n_words bigint, n_removed bigint, kept_text string").select(
        F.col("id").cast(kind).alias(key), "n_words", "n_removed", "kept_text"
    )
