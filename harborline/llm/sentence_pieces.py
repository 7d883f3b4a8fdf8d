"""SentencePiece encoding with N-best segmentations, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harborline.llm.common import SLICE_ROWS

SPACE = "▁"
#: Segmentations of a text.
N_BEST = 4
#: Chunks, and ids of theirs, that a worker remembers before it forgets those met once.
REMEMBERED, REMEMBERED_IDS = 200_000, 2_000_000
#: Characters whose pieces are looked up at once, and how many such lookups are remembered.
WINDOW, WINDOWS = 3, 1 << 15
#: Longest chunk whose n best segmentations are remembered, and of how many.
REMEMBERED_CHARS, REMEMBERED_OPTIONS = 64, 20_000
#: Least and most chunks whose lattices are passed side by side, and characters of the longest of them.
TOGETHER_LEAST, TOGETHER_MOST, TOGETHER_CHARS = 128, 4096, 64


class Pieces:
    """The vocabulary of a model: scores, byte fallback, and where texts may be cut."""

    def __init__(self, model: str | bytes) -> None:
        """From a model file, by path or content."""
        source = {"model_file": model} if isinstance(model, str) else {"model_proto": model}
        model = sentencepiece.SentencePieceProcessor(**source)
        self.ids: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.bytes[value] = i
                self.out.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i):
                self.out.append(b"")
            else:
                self.ids[piece] = i, model.get_score(i)
                self.out.append(piece.replace(SPACE, " ").encode())
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte fallback")
        #: Pieces as (ids, score); proper prefixes of pieces as an empty tuple.
        self.table: dict[str, tuple] = {p[:n]: () for p in self.ids for n in range(1, len(p))}
        self.table |= {p: ((i,), s) for p, (i, s) in self.ids.items()}
        self.windows: dict[str, tuple[tuple, bool]] = {}
        #: Steps of the trie of pieces, as node and next character in one sorted number, the node reached, and its piece or -1.
        nodes = {"": 0} | {p: k for k, p in enumerate(self.table, 1)}
        steps = np.array([nodes[p[:-1]] << 21 | ord(p[-1]) for p in self.table], np.int64)
        order = np.argsort(steps)
        self.steps, self.reached = steps[order], order + 1
        self.node_ids = np.array([-1] + [x[0][0] if x else -1 for x in self.table.values()], np.int32)
        self.node_scores = np.array([0.0] + [x[1] if x else 0.0 for x in self.table.values()])
        self.letters = {p for p in self.ids if len(p) == 1}
        self.fallback = min(s for _, s in self.ids.values() if s > -1e8) - 10.0
        self.chunks = re.compile(self._chunk_pattern(), re.DOTALL)

    def _chunk_pattern(self) -> str:
        """Runs of letters or of other characters, each with the spaces before it.

        A cut is exact where no piece spans it. Characters of pieces that mix both
        kinds are moved to the other kind until none is left; else only spaces cut.
        """
        inner = {pair for p in self.ids for pair in pairwise(p.lstrip(SPACE))}
        moved = ""
        for _ in range(64):
            letter = re.compile(rf"[^\W\d_{moved}]")
            mixed = {x if letter.match(x) else y for x, y in inner if bool(letter.match(x)) != bool(letter.match(y))}
            if not mixed:
                return rf"{SPACE}*(?:[^\W\d_{moved}]+|(?:(?![^\W\d_{moved}])[^{SPACE}])+)|{SPACE}+"
            moved += "".join(map(re.escape, sorted(mixed)))
        return rf"{SPACE}*[^{SPACE}]+|{SPACE}+"

    def forward(self, chunk: str) -> tuple[list[float], list[list[tuple[int, tuple]]]]:
        """Best score of every prefix, and the edges (start, piece) into every place."""
        size, table = len(chunk), self.table
        best: list[float] = [0.0] + [-1e300] * size
        into: list[list] = [[] for _ in range(size + 1)]
        for i in range(size):
            here, j = best[i], i + 1
            piece = table.get(chunk[i:j])
            if not piece:
                # Spelt in bytes; longer pieces from here are still looked for.
                ids = tuple(self.bytes[b] for b in chunk[i].encode("utf-8", "surrogatepass"))
                spelt = ids, self.fallback
                into[j].append((i, spelt))
                if here + self.fallback > best[j]:
                    best[j] = here + self.fallback
            while piece is not None:
                if piece:
                    into[j].append((i, piece))
                    score = here + piece[1]
                    if score > best[j]:
                        best[j] = score
                j += 1
                if j > size:
                    break
                piece = table.get(chunk[i:j])
        return best, into

    def viterbi(self, chunk: str) -> tuple[float, tuple[int, ...], float]:
        """Score and ids of the best segmentation, and what the second best loses.

        The second best leaves the best path, read from the end, at one place by its
        second edge, and is best from there on; so the loss is the least gap between
        the two best edges into a place of the path.
        """
        size, get, windows = len(chunk), self.table.get, self.windows
        best, second = [-1e300] * (size + 1), [-1e300] * (size + 1)
        back: list = [None] * (size + 1)
        best[0] = 0.0
        for i in range(size):
            here, window = best[i], chunk[i : i + WINDOW]
            edges, more = windows.get(window) or self._window(window)
            for edge in edges:
                j, score = i + edge[0], here + edge[2]
                if score > best[j]:
                    second[j], best[j], back[j] = best[j], score, edge
                elif score > second[j]:
                    second[j] = score
            if more:
                for j in range(i + WINDOW + 1, size + 1):
                    piece = get(chunk[i:j])
                    if piece is None:
                        break
                    if piece:
                        score = here + piece[1]
                        if score > best[j]:
                            second[j], best[j], back[j] = best[j], score, (j - i, *piece)
                        elif score > second[j]:
                            second[j] = score
        at, parts, loss = size, [], float("inf")
        while at:
            gap = best[at] - second[at]
            if gap < loss:
                loss = gap
            long, ids, _ = back[at]
            at -= long
            parts.append(ids)
        return best[size], tuple([i for ids in reversed(parts) for i in ids]), loss if loss < 1e200 else float("inf")

    def fits_together(self, chunk: str) -> bool:
        return len(chunk) <= TOGETHER_CHARS and self.letters.issuperset(chunk)

    def viterbi_together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``viterbi`` of chunks whose characters are all pieces, side by side: scores, ids one after another, their counts, losses.

        The chunks step through the trie together, a character at a time, and then through
        their places: edges from one place of many chunks lead to different ends.
        """
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(c) for c in chunks], np.int64)
        number = np.repeat(np.arange(len(chunks)), sizes)
        start = np.cumsum(sizes) - sizes
        place = np.arange(len(codes)) - start[number]
        left = sizes[number] - place
        edges, at, node, n = [], np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        while len(at):
            step = node << 21 | codes[at + n]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            known = self.steps[found] == step
            at, node, n = at[known], self.reached[found[known]], n + 1
            piece = self.node_ids[node] >= 0
            # A chunk of some characters has a place more than it has characters.
            edges.append((at[piece], (at + number[at])[piece], np.full(int(piece.sum()), n), node[piece]))
            more = left[at] > n
            at, node = at[more], node[more]
        at, begin, long, node = (np.concatenate(x) for x in zip(*edges, strict=True))
        order = np.argsort(place[at].astype(np.int16), kind="stable")
        begin, end, score, ids = begin[order], (begin + long)[order], self.node_scores[node[order]], self.node_ids[node[order]]
        first = start + np.arange(len(chunks))
        best, second = np.full(len(codes) + len(chunks), -1e300), np.full(len(codes) + len(chunks), -1e300)
        back = np.zeros(len(best), np.int64)
        best[first] = 0.0
        cuts = np.append(0, np.cumsum(np.bincount(place[at])))
        for a, b in pairwise(cuts.tolist()):
            ends, now = end[a:b], best[begin[a:b]] + score[a:b]
            old = best[ends]
            better = now > old
            second[ends] = np.where(better, old, np.maximum(second[ends], now))
            best[ends] = np.where(better, now, old)
            back[ends] = np.where(better, np.arange(a, b), back[ends])
        losses, which, at = np.full(len(chunks), np.inf), np.arange(len(chunks)), first + sizes
        scores, path = best[at], []
        while len(which):
            losses[which] = np.minimum(losses[which], best[at] - second[at])
            edge = back[at]
            path.append((which, ids[edge]))
            at = begin[edge]
            open_ = at > first[which]
            which, at = which[open_], at[open_]
        which, ids = (np.concatenate(x) for x in zip(*reversed(path), strict=True))
        losses[losses >= 1e200] = np.inf
        return scores, ids[np.argsort(which, kind="stable")], np.bincount(which, minlength=len(chunks)), losses

    def _window(self, window: str) -> tuple[tuple, bool]:
        """Edges (length, ids, score) at the start of some characters, shortest first, and whether longer pieces may follow."""
        if len(self.windows) >= WINDOWS:
            self.windows.clear()
        edges, piece = [], None
        for n in range(1, len(window) + 1):
            piece = self.table.get(window[:n])
            if piece:
                edges.append((n, *piece))
            elif n == 1:
                # Spelt in bytes; longer pieces from here are still looked for.
                edges.append((1, tuple(self.bytes[b] for b in window[0].encode("utf-8", "surrogatepass")), self.fallback))
            if piece is None:
                break
        found = self.windows[window] = tuple(edges), piece is not None and len(window) == WINDOW
        return found

    def n_best(self, chunk: str, n: int) -> Iterator[tuple[float, tuple[int, ...]]]:
        """Up to n best segmentations of a chunk, best first: score and ids.

        The forward pass finds the best score of every prefix; searching back from
        the end, that score is exactly what the open part can still add. So paths
        leave the queue in order of their whole score.
        """
        best, into = self.forward(chunk)
        # A path is a chain (ids of its first piece, the path behind it). Of equal scores
        # the one nearest to its end goes on, so that ties do not multiply open paths.
        queue: list[tuple] = [(-best[-1], len(chunk), 0, 0.0, None)]
        pushed = 0
        while queue and n:
            whole, at, _, behind, path = heapq.heappop(queue)
            while at:
                # The best edge is followed at once; the others wait.
                follow = None
                for i, (ids, score) in into[at]:
                    after = behind + score
                    if follow is None and after + best[i] == -whole:
                        follow = i, after, (ids, path)
                    else:
                        pushed += 1
                        heapq.heappush(queue, (-(after + best[i]), i, pushed, after, (ids, path)))
                if follow is None:
                    break  # rounding: the best edge waits in the queue
                at, behind, path = follow
            if at:
                continue
            flat: list[int] = []
            while path is not None:
                flat += path[0]
                path = path[1]
            n -= 1
            yield -whole, tuple(flat)


class Numbers(dict[str, int]):
    """Names numbered in the order in which they are first looked up."""

    def __missing__(self, name: str) -> int:
        self[name] = number = len(self)
        return number


class Encoder:
    """Encodes whole texts, remembering the lattices of frequent chunks.

    Every known chunk has a number; a batch of texts becomes one array of numbers, and
    scores and ids are gathered from flat tables.
    """

    def __init__(self, pieces: Pieces, n: int) -> None:
        self.pieces, self.n = pieces, n
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.names: list[str] = []
        #: By number: ids from a start on, their count, score, loss of the second best segmentation.
        self.ids, self.starts, self.counts = array("i"), array("q"), array("q")
        self.scores, self.losses = array("d"), array("d")
        self.options: dict[int, list[tuple[float, np.ndarray]]] = {}
        self.met = np.zeros(0, np.int64)
        # No chunk is empty: the empty name is a space mark that stands in the text itself, spelt in bytes.
        self._take([""], np.array([3 * self.pieces.fallback]), np.array([np.inf]), np.array([3]), np.array([self.pieces.bytes[b] for b in SPACE.encode()]))

    def forget(self) -> None:
        """Keep the chunks met more than once since the last time, the most met of them, and at most half of what is remembered."""
        names, met, scores, losses, counts = self.names, self.met, np.array(self.scores), np.array(self.losses), np.array(self.counts)
        often = np.flatnonzero(met[1:] > 1) + 1
        often = often[np.argsort(-met[often], kind="stable")]
        often = often[np.cumsum(counts[often]) <= REMEMBERED_IDS // 2][: REMEMBERED // 2]
        ids = _stretches(np.array(self.ids, np.int32), np.array(self.starts)[often], counts[often])
        self.clear()
        self._take([names[k] for k in often.tolist()], scores[often], losses[often], counts[often], ids)

    def _take(self, names: list[str], scores: np.ndarray, losses: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Number and add chunks whose ids come one after another."""
        self.number.update(zip(names, itertools.count(len(self.names))))
        starts = len(self.ids) + np.cumsum(counts) - counts
        self.ids.frombytes(ids.astype(np.int32).tobytes())
        self._add(names, scores, losses, starts, counts)

    def _add(self, names: list[str], scores: np.ndarray, losses: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        self.names += names
        for own, new in ((self.scores, scores), (self.losses, losses), (self.starts, starts), (self.counts, counts)):
            own.frombytes(new.tobytes())

    def _numbers(self, text: str) -> np.ndarray:
        find = self.pieces.chunks.findall
        names: list[str] = []
        for k, plain in enumerate(f" {text}".split(SPACE)):
            if k:
                names.append("")
            names += find(plain.replace(" ", SPACE))
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def _learn(self) -> None:
        """Score the chunks that have no more than a number yet; those of known characters side by side, where they are many."""
        fresh = list(itertools.islice(self.number, len(self.names), None))
        for at in range(0, len(fresh), TOGETHER_MOST):
            names = fresh[at : at + TOGETHER_MOST]
            fit = np.fromiter(map(self.pieces.fits_together, names), bool, len(names))
            if fit.sum() < TOGETHER_LEAST:
                fit[:] = False
            scores, losses, counts, starts = np.empty(len(names)), np.empty(len(names)), np.empty(len(names), np.int64), np.empty(len(names), np.int64)
            if fit.any():
                scores[fit], ids, counts[fit], losses[fit] = self.pieces.viterbi_together([names[k] for k in np.flatnonzero(fit)])
                starts[fit] = len(self.ids) + np.cumsum(counts[fit]) - counts[fit]
                self.ids.frombytes(ids.astype(np.int32).tobytes())
            for k in np.flatnonzero(~fit).tolist():
                scores[k], ids, losses[k] = self.pieces.viterbi(names[k])
                starts[k], counts[k] = len(self.ids), len(ids)
                self.ids.extend(ids)
            self._add(names, scores, losses, starts, counts)

    def batch(self, texts: list[str | None]) -> list[list[tuple[float, np.ndarray]]]:
        """For every text the n best (score, ids); no piece spans chunks, so their lattices are independent."""
        if len(self.names) > REMEMBERED or len(self.ids) > REMEMBERED_IDS:
            self.forget()
        numbers = [self._numbers(t) if t else np.empty(0, np.int64) for t in texts]
        self._learn()
        sizes = np.array([len(x) for x in numbers], np.int64)
        flat = np.concatenate([np.empty(0, np.int64), *numbers])
        ends = np.cumsum(sizes)
        met = np.bincount(flat, minlength=len(self.names))
        met[: len(self.met)] += self.met
        self.met = met
        # Copies, as the tables grow again with the next batch.
        ids, starts, counts = np.array(self.ids, np.int32), np.array(self.starts)[flat], np.array(self.counts)[flat]
        scores, losses = np.array(self.scores)[flat], np.array(self.losses)[flat]
        places = np.cumsum(counts) - counts  # of each chunk's ids among those of the batch
        taken = _stretches(ids, starts, counts)
        out = []
        for text, size, end in zip(texts, sizes.tolist(), ends.tolist(), strict=True):
            if text is None or not size:
                out.append([(0.0, taken[:0])])
                continue
            a = end - size
            low, high = int(places[a]), int(places[end - 1] + counts[end - 1])
            best = float(scores[a:end].sum())
            found = [(best, taken[low:high])]
            if self.n > 1:
                found += self._others(flat[a:end], losses[a:end], scores[a:end], places[a:end] - low, counts[a:end], *found[0])
            out.append(found)
        return out

    def encode(self, text: str) -> list[tuple[float, list[int]]]:
        return [(s, x.tolist()) for s, x in self.batch([text])[0]]

    def _others(
        self, numbers: np.ndarray, losses: np.ndarray, scores: np.ndarray, places: np.ndarray, counts: np.ndarray, best: float, ids: np.ndarray
    ) -> list[tuple[float, np.ndarray]]:
        """The second to n-th best: only the n - 1 chunks that lose least (ties: the first) can differ in them."""
        some = min(self.n - 1, len(losses))
        least = np.partition(losses, some - 1)[some - 1]
        near = np.flatnonzero((losses <= least) & (losses < np.inf))
        near = np.sort(near[np.argsort(losses[near], kind="stable")][:some])
        choices = [[(scores[k] - s, x) for s, x in self._n_best(int(numbers[k]))] for k in near]
        out = []
        for loss, picks in self._combined(choices):
            parts, last = [], 0
            for k, pick, options in zip(near, picks, choices, strict=True):
                if pick:
                    parts += [ids[last : places[k]], options[pick][1]]
                    last = places[k] + counts[k]
            out.append((best - float(loss), np.concatenate([*parts, ids[last:]])))
        return out

    def _n_best(self, number: int) -> list[tuple[float, np.ndarray]]:
        found = self.options.get(number)
        if found is None:
            found = [(s, np.array(x, np.int32)) for s, x in self.pieces.n_best(self.names[number], self.n)]
            if len(self.names[number]) <= REMEMBERED_CHARS and len(self.options) < REMEMBERED_OPTIONS:
                self.options[number] = found
        return found

    def _combined(self, choices: list[list[tuple[float, np.ndarray]]]) -> list[tuple[float, tuple[int, ...]]]:
        """The 2nd to n-th best combinations of options: loss, and the option taken of each."""
        states: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for options in choices:
            grown = [(loss + o[0], (*picks, j)) for loss, picks in states for j, o in enumerate(options)]
            states = heapq.nsmallest(self.n, grown)
        return states[1:]


def _stretches(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    return values[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]


class Decoder:
    """Bytes of pieces in one flat array."""

    def __init__(self, pieces: Pieces) -> None:
        self.out = pa.array(pieces.out, pa.large_binary())

    def texts(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive stretches of ids, each up to its end; what is no UTF-8 gives U+FFFD."""
        _, starts, whole = self.out.take(pa.array(ids)).buffers()
        whole = whole.to_pybytes() if whole else b""
        cuts = np.frombuffer(starts, np.int64)[np.append(0, ends)].tolist() if len(ids) else [0] * (len(ends) + 1)
        return [whole[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in itertools.pairwise(cuts)]


#: Models of a worker by digest of their file.
_models: dict[str, Pieces] = {}
_encoders: dict[tuple[str, int], Encoder] = {}
_decoders: dict[str, Decoder] = {}


class Model:
    """A model file, read by the driver and sent to the tasks that use it."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        self.digest = hashlib.sha256(content).hexdigest()
        self.content = spark.sparkContext.broadcast(content)

    def pieces(self) -> Pieces:
        if self.digest not in _models:
            _models[self.digest] = Pieces(self.content.value)
        return _models[self.digest]

    def encoder(self, n: int) -> Encoder:
        key = self.digest, n
        if key not in _encoders:
            _encoders[key] = Encoder(self.pieces(), n)
        return _encoders[key]

    def decoder(self) -> Decoder:
        if self.digest not in _decoders:
            _decoders[self.digest] = Decoder(self.pieces())
        return _decoders[self.digest]


def _lists(values: pa.Array, ends: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    """Lists of consecutive values, each up to its end."""
    offsets = pa.array(np.append(0, ends).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=None if null is None else pa.array(null))


def _segmented(encoder: Encoder, texts: list[str | None]) -> tuple[pa.ListArray, list[list[tuple[float, np.ndarray]]]]:
    """The segmentations of texts as a column, and as they are."""
    found = [[] if t is None else f for t, f in zip(texts, encoder.batch(texts), strict=True)]
    flat = [s for f in found for s in f]
    ids = pa.array(np.concatenate([x for _, x in flat] or [np.empty(0, np.int32)]))
    each = _lists(ids, np.cumsum([len(x) for _, x in flat]))
    both = pa.StructArray.from_arrays([pa.array([s for s, _ in flat], pa.float64()), each], ["score", "ids"])
    return _lists(both, np.cumsum([len(f) for f in found]), np.array([t is None for t in texts], bool)), found


SEGMENTATIONS = "segmentations array<struct<score:double,ids:array<int>>>"


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", n_best: int = N_BEST) -> DataFrame:
    """(key, segmentations): the ``n_best`` best (score, ids) of every whole text, best first.

    Piece scores are those of the model file; characters outside the vocabulary are
    spelt in bytes. A space is put before the text. A null text has null
    segmentations; an empty one has one segmentation without pieces. Fewer are given
    where a text has fewer. Ties are ordered alike in every run. Rows with repeated or null keys
    are each encoded; an empty table gives no rows; further columns are not looked at.
    """
    shipped = Model(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shipped.encoder(n_best)
        for part in _parts(batches):
            column, _ = _segmented(encoder, part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), column], ["key", "segmentations"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {SEGMENTATIONS}").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: str, keys: list[str], ids: str = "ids") -> DataFrame:
    """(keys, text): texts from piece ids; ids that are no UTF-8 together give U+FFFD.

    Null ids have a null text, an empty list the empty one.
    """
    shipped = Model(encoded.sparkSession, model)
    names = [f"k{i}" for i in range(len(keys))]
    rows = encoded.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(ids).alias("ids"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = shipped.decoder()
        for part in _parts(batches):
            column = part.column(len(names))
            null = column.is_null().to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            texts = decoder.texts(column.flatten().to_numpy(zero_copy_only=False), ends)
            out = pa.array([None if x else t for x, t in zip(null, texts, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], out], [*names, "text"])

    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", text string")
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "text")


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def best(name: str) -> Column:
    return F.col("segmentations")[0][name]


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", n_best: int = N_BEST) -> DataFrame:
    """(key, ids, n_pieces, segmentations, exact): encode every text, decode each of its segmentations.

    One pass does both, so that a text and its segmentations meet without travelling. ``ids``
    are those of the best; ``exact`` tells whether all give back the text (true for a null
    text). Nulls, repeats and empty tables are as in ``encode``.
    """
    shipped = Model(docs.sparkSession, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = shipped.encoder(n_best), shipped.decoder()
        for part in _parts(batches):
            texts = part.column(1).to_pylist()
            column, found = _segmented(encoder, texts)
            exact = []
            for t, f in zip(texts, found, strict=True):
                ids = np.concatenate([x for _, x in f] or [np.empty(0, np.int32)])
                exact.append(all(back == t for back in decoder.texts(ids, np.cumsum([len(x) for _, x in f]).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([part.column(0), column, pa.array(exact)], ["key", "segmentations", "exact"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"key {dict(rows.dtypes)['key']}, {SEGMENTATIONS}, exact boolean")
    return out.select(
        F.col("key").alias(key), best("ids").alias("ids"), F.size(best("ids")).cast("bigint").alias("n_pieces"), "segmentations", "exact"
    )
