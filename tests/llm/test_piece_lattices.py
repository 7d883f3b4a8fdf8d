"""Lattices passed side by side give what each gives alone."""

import random

import numpy as np
import pytest

from harborline.llm import sentence_pieces
from harborline.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(PIECE_MODEL)


def odd_words(rng, n):
    """Chunks of pieces and of single characters, spaces alone, one character, 64 and more."""
    kinds = ["abcdefghij", "thenigraou", "éèñüß", "中日本語の", "🙂𝒳\x07\x00", ".,;!?", "\n\t ", "0123456789"]
    for _ in range(n):
        kind = rng.choice(kinds[:3]) if rng.random() < 0.7 else rng.choice(kinds)
        yield "".join(rng.choice(kind) for _ in range(rng.choice([1, 2, 5, 9, 14, 63, 64, 65, 200])))


def test_side_by_side_as_alone(pieces):
    rng = random.Random(3)
    chunks = [c for c in {c for t in odd_words(rng, 2000) for c in pieces.chunks.findall(f" {t}".replace(" ", sentence_pieces.SPACE))} if pieces.fits_together(c)]
    assert len(chunks) > 500 and max(map(len, chunks)) == 64
    scores, ids, counts, losses = pieces.viterbi_together(chunks)
    ends = np.cumsum(counts).tolist()
    got = [(s, tuple(ids[e - n : e].tolist()), x) for s, e, n, x in zip(scores.tolist(), ends, counts.tolist(), losses.tolist())]
    assert got == [pieces.viterbi(c) for c in chunks]


def test_many_chunks_are_not_passed_one_by_one(pieces, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(odd_words(rng, rng.choice([0, 1, 40, 400]))) for _ in range(30)]
    texts += [None, "", " ", f"a {sentence_pieces.SPACE}b", "\ud800 lone"]
    want = [sentence_pieces.Encoder(pieces, 4).encode(t) for t in texts]
    met, plain = set(), pieces.viterbi
    monkeypatch.setattr(pieces, "viterbi", lambda chunk: met.add(chunk) or plain(chunk))
    encoder = sentence_pieces.Encoder(pieces, 4)
    monkeypatch.setattr(sentence_pieces, "TOGETHER_MOST", 300)
    got = [[(s, x.tolist()) for s, x in f] for f in encoder.batch(texts)]
    assert got == want
    fit = set(filter(pieces.fits_together, encoder.names))
    assert len(fit) > 1000 and len(met & fit) < len(fit) / 5  # the rest of the last ones, too few to go together
    encoder.met[:] = 2
    encoder.forget()
    assert [[(s, x.tolist()) for s, x in f] for f in encoder.batch(texts)] == want


def test_decoded_stretches(pieces):
    decoder = sentence_pieces.Decoder(pieces)
    ids = np.array([i for t in ("ab", "cd é") for i in sentence_pieces.Encoder(pieces, 1).encode(t)[0][1]], np.int32)
    n = len(sentence_pieces.Encoder(pieces, 1).encode("ab")[0][1])
    assert decoder.texts(ids, np.array([0, n, n, len(ids)])) == ["", "ab", "", "cd é"]
    assert decoder.texts(ids[:0], np.array([0, 0])) == ["", ""]
    assert decoder.texts(ids[:0], np.array([], np.int64)) == []
    assert decoder.texts(np.array([pieces.bytes[0xE9]], np.int32), np.array([1])) == ["�"]
