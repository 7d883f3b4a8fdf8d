"""Periodic runs of words, found on a Re-Pair grammar of the word ids of each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of texts that are worked on together; a longer text is worked on alone.
BLOCK_WORDS = 200_000
#: Half the words that must match their neighbours one period away: a run of period q has
#: at least max(24, 3 q) - q >= 16 of them.
GRAM = (LEAST_WORDS - LEAST_WORDS // LEAST_PERIODS) // 2


# -- grammar --------------------------------------------------------------------------

class Grammar:
    """Re-Pair over the concatenated ids of several texts that share no id.

    A round counts adjacent pairs and replaces, all at once, the occurrences of every pair
    that is more frequent than the pairs it overlaps (ties: the larger code); the most
    frequent pair is always among them. Rounds end when no pair occurs twice. Symbols stay
    at the position of their first word, linked to the next one, so a round costs only the
    positions whose pair can still occur twice: a pair seen once never comes again, as
    new neighbours are always new symbols.
    """

    def __init__(self, ids: np.ndarray) -> None:
        n = self.n = len(ids)
        self.sym = np.append(ids, -1)
        self.nxt = np.arange(1, n + 2)
        self.nxt[n] = n
        self.prv = np.arange(-1, n)
        self.prv[0] = n
        self.alive = np.ones(n + 1, bool)
        self.rounds: list[int] = [0]  # rules made before each round
        parts: list[tuple[np.ndarray, ...]] = []
        made, active = 0, np.arange(n - 1)
        #: Positions whose first pair of words occurs again.
        self.again = np.zeros(n, bool)
        rank = np.zeros(n + 1, np.int64)
        while len(active):
            here, code, streak = self._repeated(active)
            if not made:
                self.again[here] = True
                self.again[streak] = True
            even = ~np.isin(here, self._odd(streak)) if len(streak) else np.ones(len(here), bool)
            place, code = here[even], code[even]
            if not len(place):
                break
            _, group, size = np.unique(code, return_inverse=True, return_counts=True)
            order = np.empty(len(size), np.int64)
            order[np.argsort(size, kind="stable")] = np.arange(1, len(size) + 1)
            rank[place] = np.where(size > 1, order, 0)[group]
            mine = rank[place]
            taken = (mine > 0) & (rank[self.prv[place]] <= mine) & (rank[self.nxt[place]] <= mine)
            rank[place] = 0
            taken &= np.bincount(group[taken], minlength=len(size))[group] > 1
            at, group = place[taken], group[taken]
            if not len(at):
                break
            _, first, rule = np.unique(group, return_index=True, return_inverse=True)
            second = self.nxt[at]
            after = self.nxt[second]
            head = at[first]
            parts.append((self.sym[head], self.sym[second[first]], head, after[first] - head, second[first] - head))
            self.sym[at] = n + made + rule
            self.nxt[at], self.prv[after] = after, at
            self.prv[n] = n
            self.alive[second] = False
            made += len(first)
            self.rounds.append(made)
            near = np.concatenate([here[self.alive[here]], streak[self.alive[streak]], at, self.prv[at]])
            active = np.unique(near)
            active = active[active < n]
        self.left, self.right, self.head, self.span, self.cut = (
            (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 5
        )

    def _repeated(self, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions whose pair may occur again, its code; and positions of two equal symbols."""
        active = active[self.nxt[active] < self.n]
        a, b = self.sym[active], self.sym[self.nxt[active]]
        code = a * (2 * self.n + 1) + b
        bits = max(10, int(len(code)).bit_length() + 2)
        slot = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        slot = slot.astype(np.int64)
        often = np.bincount(slot, minlength=1 << bits)[slot] > 1
        here, code = active[often], code[often]
        order = np.argsort(code)
        ordered = code[order]
        twin = np.zeros(len(code), bool)
        same = ordered[1:] == ordered[:-1]
        twin[order[1:][same]] = True
        twin[order[:-1][same]] = True
        return here[twin], code[twin], active[a == b]

    def _odd(self, streak: np.ndarray) -> np.ndarray:
        """Every second position of a stretch of equal symbols; pairs there overlap the others."""
        fresh = np.ones(len(streak), bool)
        fresh[1:] = self.nxt[streak[:-1]] != streak[1:]
        number = np.arange(len(streak))
        offset = number - np.maximum.accumulate(np.where(fresh, number, 0))
        return streak[offset % 2 == 1]

    def top(self) -> np.ndarray:
        """Positions of the symbols that are left."""
        return np.flatnonzero(self.alive[: self.n])

    def derivations(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(rule, position) wherever a rule of ``least`` words or more is derived; last rounds first."""
        at = self.top()
        rule = self.sym[at] - self.n
        rules, places = [], []
        at, rule = at[rule >= 0], rule[rule >= 0]
        at, rule = at[self.span[rule] >= least], rule[self.span[rule] >= least]
        for low in reversed(self.rounds[:-1]):
            now = rule >= low
            here, made = at[now], rule[now]
            rules.append(made)
            places.append(here)
            children = np.concatenate([self.left[made], self.right[made]]) - self.n
            starts = np.concatenate([here, here + self.cut[made]])
            long = children >= 0
            long[long] = self.span[children[long]] >= least
            at = np.concatenate([at[~now], starts[long]])
            rule = np.concatenate([rule[~now], children[long]])
        return np.concatenate(rules or [at]), np.concatenate(places or [at])


# -- runs -----------------------------------------------------------------------------

class Matches:
    """Hashes of all stretches of ids, by prefix sums modulo 2^64."""

    def __init__(self, ids: np.ndarray, seed: int) -> None:
        base = np.uint64((0x5851F42D4C957F2D + 2 * 0x2545F4914F6CDD1D * seed) % 2**64 | 1)
        mixed = (ids + 1).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(ids), base))])
        self.total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * self.power[:-1])])

    def grams(self, at: np.ndarray, length: int) -> np.ndarray:
        """Codes of the stretches of ``length`` from ``at``; equal for equal stretches."""
        return (self.total[at + length] - self.total[at]) * self.power[len(self.power) - 1 - at]

    def equal(self, a: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        b = a + lag
        return (self.total[a + length] - self.total[a]) * self.power[lag] == self.total[b + length] - self.total[b]

    def reach(self, a: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """How far stretches from ``a`` (or up to it, going back) equal those ``lag`` later; at most ``most``."""
        low, high = np.zeros_like(a), np.maximum(most, 0)
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a - middle if back else a, lag, middle)
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low


def _crossing(ids: np.ndarray, cuts: np.ndarray, low: np.ndarray, high: np.ndarray, again: np.ndarray, seed: int) -> tuple[np.ndarray, ...]:
    """(number of the cut, start, end, period) of long repetitions across ``cuts`` inside [low, high).

    A run has 16 words or more that match those one period on, in a row around or beside the
    cut, so the 8 words before or after the cut occur again one period away.
    """
    none = (np.empty(0, np.int64),) * 4
    ends = np.flatnonzero(~np.append(again, False))
    reach = ends[np.searchsorted(ends, np.arange(len(ids)))] - np.arange(len(ids))
    grams = np.flatnonzero(reach >= GRAM - 1)
    grams = grams[grams + GRAM <= len(ids)]
    if not len(grams):
        return none
    match = Matches(ids, seed)
    code = match.grams(grams, GRAM)
    order = np.argsort(code, kind="stable")
    code, grams = code[order], grams[order]
    new = np.append(True, code[1:] != code[:-1])
    group = np.cumsum(new) - 1
    many = np.bincount(group)[group] > 1
    group, grams = group[many], grams[many]
    if not len(grams):
        return none
    of = np.full(len(ids) + 1, -1)
    of[grams] = group
    key = group * (len(ids) + 1) + grams  # sorted: by group, then position
    found: list[tuple[np.ndarray, ...]] = []
    for shift in (0, -GRAM):
        at = cuts + shift
        inside = np.flatnonzero((at >= low) & (at + GRAM <= high))
        inside = inside[of[at[inside]] >= 0]
        at, lag = at[inside], (high[inside] - low[inside]) // LEAST_PERIODS
        base = of[at] * (len(ids) + 1)
        first = np.searchsorted(key, base + np.maximum(low[inside], at - lag))
        last = np.searchsorted(key, base + np.minimum(high[inside] - GRAM, at + lag), side="right")
        number = last - first
        # In pieces, as one text may hold a stretch very often.
        for piece in _pieces(number, 1 << 20):
            size = number[piece]
            each = np.repeat(np.arange(piece.start, piece.stop), size)
            other = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + first[each]
            q = grams[other] - at[each]
            cut = inside[each]
            cut, q = cut[q != 0], q[q != 0]
            found.append(_extended(match, cut, cuts[cut], low[cut], high[cut], q))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else none


def _pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of ``sizes`` of about ``most`` in sum."""
    done = np.cumsum(sizes) // most
    edges = np.concatenate([[0], np.flatnonzero(np.diff(done)) + 1, [len(sizes)]]) if len(sizes) else [0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield slice(int(a), int(b))


def _extended(match: Matches, cut: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """Longest stretches of period |q| at the cut; those long enough.

    For q > 0 the words from the cut match those q later, for q < 0 those at the cut match those before.
    """
    lag = np.abs(q)
    start = np.where(q > 0, b, b - lag)
    ok = (start >= low) & (start + lag <= high)
    cut, low, high, lag, start = (v[ok] for v in (cut, low, high, lag, start))
    # Of the 2 q words that must match, q are on one side of the start: looked at first.
    side = np.maximum(lag, GRAM)
    right = start + lag + side <= high
    right[right] = match.equal(start[right], lag[right], side[right])
    left = ~right & (start - side >= low)
    left[left] = match.equal((start - side)[left], lag[left], side[left])
    cut, low, high, lag, start = (v[right | left] for v in (cut, low, high, lag, start))
    on = match.reach(start, lag, high - start - lag, False)
    back = match.reach(start, lag, start - low, True)
    long = on + back + lag >= np.maximum(LEAST_WORDS, LEAST_PERIODS * lag)
    return cut[long], (start - back)[long], (start + on + lag)[long], lag[long]


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal intervals: those of one period that share a period or more are one; of equal ones the least period stays."""
    if not len(start):
        return start, end, period
    order = np.lexsort((start, period))
    start, end, period = start[order], end[order], period[order]
    step = np.cumsum(np.append(0, period[1:] != period[:-1])) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + step)
    fresh = np.append(True, (start[1:] + step[1:] > far[:-1] - period[1:]) | (period[1:] != period[:-1]))
    at = np.flatnonzero(fresh)
    start, period, end = start[at], period[at], np.maximum.reduceat(end, at)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))
    return start[fresh], end[fresh], period[fresh]


def _true(ids: np.ndarray, edges: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> bool:
    """Whether all are what they claim, word by word: hashes can only make a run too long."""
    size = end - start - period
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    return bool((ids[at] == ids[at + np.repeat(period, size)]).all()) and bool(
        (np.searchsorted(edges, start, side="right") == np.searchsorted(edges, end, side="left")).all()
    )


def block_runs(ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, sorted by start, end, period.

    ``ids`` are the words of several texts that share no id; ``edges`` the texts' starts.
    Runs across the boundary inside each rule are computed once, at the rule's first
    place, and moved to every place that derives it. Boundaries between the symbols left
    at the top are looked at in the whole text. A run is found whole at the smallest
    stretch that holds it, so merging leaves exactly the maximal ones.
    """
    grammar = Grammar(ids)
    bounds = np.append(edges, len(ids))
    top = grammar.top()
    top = top[~np.isin(top, edges)]
    text = np.searchsorted(bounds, top, side="right") - 1
    rules, places = grammar.derivations(LEAST_WORDS)
    used = np.unique(rules)
    cuts = np.concatenate([top, grammar.head[used] + grammar.cut[used]])
    low = np.concatenate([bounds[text], grammar.head[used]])
    high = np.concatenate([bounds[text + 1], grammar.head[used] + grammar.span[used]])
    for seed in count():
        cut, start, end, period = _crossing(ids, cuts, low, high, grammar.again, seed)
        whole = cut < len(top)
        rule = used[cut[~whole] - len(top)]
        order = np.argsort(rules, kind="stable")
        first, last = (np.searchsorted(rules[order], rule, side=s) for s in ("left", "right"))
        size = last - first
        which = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
        move = places[order][which] - np.repeat(grammar.head[rule], size)
        runs = _merged(
            np.concatenate([start[whole], np.repeat(start[~whole], size) + move]),
            np.concatenate([end[whole], np.repeat(end[~whole], size) + move]),
            np.concatenate([period[whole], np.repeat(period[~whole], size)]),
        )
        if _true(ids, edges, *runs):
            return runs


# -- texts ----------------------------------------------------------------------------

def _block(texts: list[list[bytes]]) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """(start, length, period) of the runs of each text, and the text without what repeats in them."""
    sizes = np.array([len(t) for t in texts])
    edges = np.cumsum(sizes) - sizes
    # The id of a word is the place where its text has it first, so texts share no id.
    ids = np.concatenate(
        [np.fromiter(map({}.setdefault, t, count(int(e))), np.int64, len(t)) for t, e in zip(texts, edges, strict=True)]
    )
    start, end, period = block_runs(ids, edges[sizes > 0])
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    gone = np.zeros(len(ids) + 1, np.int64)
    np.add.at(gone, start + period, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone)[:-1] == 0
    of = np.searchsorted(edges + sizes, start, side="right")
    for number, (words, edge) in enumerate(zip(texts, edges.tolist(), strict=True)):
        a, b = np.searchsorted(of, number, side="left"), np.searchsorted(of, number, side="right")
        if a < b:
            words = [words[i] for i in np.flatnonzero(kept[edge : edge + len(words)]).tolist()]
        runs = zip((start[a:b] - edge).tolist(), (end - start)[a:b].tolist(), period[a:b].tolist(), strict=True)
        yield list(runs), b" ".join(words)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: key, n_words, runs (start, length, period by start, then period), kept_text.

    Words are what ASCII white space parts. A run is a stretch of words with smallest
    period q and at least max(24, 3 q) words that no neighbouring word extends. ``kept_text``
    are the words outside runs and the first q words of each run, joined by one space.

    Null and empty texts have no words and no runs. Null keys and repeated rows keep
    their rows; an empty table gives none; further columns are not looked at. A text is
    worked on whole by one task, in memory that grows with its words.
    """
    schema = "key bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept_text string"
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def done(keys: list[int | None], texts: list[list[bytes]]) -> pa.RecordBatch:
        out = list(_block(texts))
        runs = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r, _ in out]
        kept = pa.array([k for _, k in out], pa.binary()).cast(pa.string())
        columns = [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(runs, run_type), kept]
        return pa.RecordBatch.from_arrays(columns, ["key", "n_words", "runs", "kept_text"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, held = [], [], 0
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (value.as_buffer().to_pybytes() if value.is_valid else b"").split()
                if texts and held + len(words) > BLOCK_WORDS:
                    yield done(keys, texts)
                    keys, texts, held = [], [], 0
                keys.append(k)
                texts.append(words)
                held += len(words)
            if texts:
                yield done(keys, texts)

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def highest(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties go to the smallest start, then period. Null without runs."""

    def better(best: Column, r: Column) -> Column:
        ahead = r["length"] * best["period"] > best["length"] * r["period"]
        return F.when(best["period"].isNull() | ahead, r).otherwise(best)

    # Runs come by start, then period, so the first of equals stays.
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, better)
