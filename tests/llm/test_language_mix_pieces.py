"""Language ID, source mixing and piece encoding."""

import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from harborline.llm import language_id, sentence_pieces, source_mix
from harborline.llm.queries import PIECE_MODEL
from harborline.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string"


def test_held_out_accuracy(spark, folder):
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op6_language_id"](spark, folder).join(truth, "doc_id").where("held_out and lang_pred <> 'und'")
    right, rows = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert rows > 30 and right > 0.97


def test_language_id_odd_rows(spark):
    rows = [(i, "der die das und nicht", "de", "s") for i in range(12)] + [(i, "the of and to in that", "en", "s") for i in range(20, 32)]
    rows += [(50, None, "de", "s"), (51, "", "en", "s"), (52, "123 --- 4", None, "s"), (None, "the cat and the dog", "zz", "s"), (53, "das", "en", None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)).withColumn("gram", F.lit(1))
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert len(got) == 29 + 0 and got[None].held_out and got[None].lang_pred == "en"
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and got[50].score == 0.0
    assert got[0].lang_pred == "de" and got[20].lang_pred == "en" and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify(unlabelled).collect()} == {"und"}


def test_grams_are_counted_alike_in_narrow_and_wide_codes():
    narrow = dict(zip(*(a.tolist() for a in language_id.gram_counts("Ab c1d ab"))))
    wide = dict(zip(*(a.tolist() for a in language_id.gram_counts("Ab c1d ab 中"))))
    assert all(wide[k] == v for k, v in narrow.items())
    a, b = ord("a"), ord("b")
    assert narrow[a] == 2 and narrow[(1 << 21) | a] == 2 and narrow[(1 << 42) | (a << 21) | b] == 2


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and free and left * weight[s] / free > most * sizes[s]}
        if not over:
            return {s: float(most * sizes[s]) if s in full else left * weight[s] / free for s in order}
        full |= over


def test_mix(spark):
    rng = random.Random(5)
    rows = []
    for source, n in (("b", 400), ("a", 30), ("c", 200), (None, 90), ("é", 5), ("empty", 2)):
        for _ in range(n):
            size = 0 if source == "empty" else rng.choice([0, 1, 2, 7, 7, 7, 50, rng.randrange(1, 400)])
            rows.append((len(rows), " ".join(["w"] * size), "en", source))
    rows += [(len(rows), None, "en", "a"), (9001, "w " * 30_000, "en", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("size", F.lit(3)).withColumn("part", F.lit(1))
    got = source_mix.mix_sources(df).collect()
    assert len(got) == len(rows)
    source = {r[0]: r[3] for r in rows}
    sizes, taken = {}, {}
    for r in got:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    targets = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(targets[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 8
    again = source_mix.mix_sources(df.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}
    assert source_mix.mix_sources(df.limit(0)).count() == 0
    repeated = source_mix.repeat_to_mix(df)
    assert repeated.columns == df.columns
    assert repeated.count() == sum(r.taken // r["size"] for r in got if r["size"])


def test_fit_budget_is_exact_where_it_can_be():
    rng = random.Random(2)
    for _ in range(60):
        sizes = sorted(rng.sample(range(1, 60), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 6) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts))
        budget = rng.randrange(0, total + 1)
        take = source_mix.fit_budget(sizes, counts, budget, total)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        fixed = [n * budget // total for n in counts]
        reach = {sum(s * t for s, t in zip(sizes, fixed))}
        for s, n, f in zip(sizes, counts, fixed):
            reach = {r + s * k for r in reach for k in range(n - f + 1)}
        assert sum(s * t for s, t in zip(sizes, take)) == max(r for r in reach if r <= budget)


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces(PIECE_MODEL)


def every_segmentation(pieces, chunk):
    def ways(i):
        if i == len(chunk):
            yield 0.0, ()
            return
        ends = [(j, *pieces.ids[chunk[i:j]]) for j in range(i + 1, len(chunk) + 1) if chunk[i:j] in pieces.ids]
        steps = [(j, (p,), s) for j, p, s in ends]
        if not any(j == i + 1 for j, _, _ in ends):
            steps.append((i + 1, tuple(pieces.bytes[b] for b in chunk[i].encode()), pieces.fallback))
        for j, ids, score in steps:
            for rest, tail in ways(j):
                yield score + rest, ids + tail

    return sorted(ways(0), key=lambda w: -w[0])


@pytest.mark.parametrize("text", ["Hello you", "ab éñ", "the\nand", "日本 語", "  two", "²."])
def test_n_best_against_all_segmentations(pieces, text):
    want = every_segmentation(pieces, f" {text}".replace(" ", sentence_pieces.SPACE))[:6]
    got = sentence_pieces.Encoder(pieces, 6).encode(text)
    assert [s for s, _ in got] == [s for s, _ in want[: len(got)]] and len(got) == len(want)
    assert len({tuple(ids) for _, ids in got}) == len(got)


def test_round_trip_of_odd_texts(spark):
    texts = [None, "", " ", "▁ x▁", "tab\tand\r\nline", "é 日本語 🙂", "a" * 5000, "  lead and trail  ", "﻿", "²..²"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "x"), (1, "x")], "doc_id bigint, text string").withColumn("ids", F.lit(0))
    rows = sentence_pieces.round_trip(df, PIECE_MODEL, n_best=3).collect()
    assert len(rows) == len(texts) + 2 and all(r.exact for r in rows)
    by_id = {r.doc_id: r for r in rows if r.doc_id != 1}
    assert by_id[0].ids is None and by_id[None].n_pieces == 1
    encoded = sentence_pieces.encode(df.where("doc_id is not null"), PIECE_MODEL).select("doc_id", sentence_pieces.best("ids").alias("ids"))
    back = sentence_pieces.decode(encoded, PIECE_MODEL, ["doc_id"]).where("doc_id <> 1").collect()
    assert {r.doc_id: r.text for r in back} == {i: t for i, t in enumerate(texts) if i != 1}
    assert sentence_pieces.encode(df.limit(0), PIECE_MODEL).count() == 0


def test_ids_decode_with_the_library(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    text = "The quick brown fox, naïve 日本."
    assert model.decode(sentence_pieces.Encoder(pieces, 1).encode(text)[0][1]) == text


def test_fit_budget_of_few_long_documents():
    """Budgets far above any one document: the program settles them whole."""
    take = source_mix.fit_budget((16748, 17650, 18198, 18419), (3, 2, 1, 2), 87_235, 140_580)
    assert sum(s * t for s, t in zip((16748, 17650, 18198, 18419), take)) == 87_215
    rng = random.Random(8)
    for _ in range(150):
        sizes = rng.sample(range(1, 30_000), rng.randrange(1, 6))
        counts = [rng.randrange(1, 4) for _ in sizes]
        total = sum(s * n for s, n in zip(sizes, counts))
        budget = rng.randrange(0, total + 1)
        fixed = [n * budget // total for n in counts]
        sums = {0}
        for s, n, f in zip(sizes, counts, fixed):
            sums = {x + s * k for x in sums for k in range(f, n + 1)}
        take = source_mix.fit_budget(sizes, counts, budget, total)
        assert all(f <= t <= n for f, t, n in zip(fixed, take, counts))
        assert sum(s * t for s, t in zip(sizes, take)) == max(x for x in sums if x <= budget)


def test_fit_budget_in_units(monkeypatch):
    """A budget beyond the cells of the program: near it, never above."""
    monkeypatch.setattr(source_mix, "PROGRAM_CELLS", 5_000)
    rng = random.Random(9)
    sizes = rng.sample(range(1, 20_000), 400)
    counts = [rng.randrange(1, 30) for _ in sizes]
    total = sum(s * n for s, n in zip(sizes, counts))
    for budget in (total // 3, total // 2 + 17):
        got = sum(s * t for s, t in zip(sizes, source_mix.fit_budget(sizes, counts, budget, total)))
        assert 0 <= budget - got <= 10


def test_repeat_to_mix_carries_columns_of_any_name(spark):
    rows = [(i, "a b c " * (1 + i % 3), "s", i, "mine", [1], "x") for i in range(20)] + [(None, "a", "s", 0, "mine", [1], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _copy int, _times string, row array<int>, size string")
    out = source_mix.repeat_to_mix(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and {repr(tuple(r)) for r in got} <= set(map(repr, rows)) and all(r["_copy"] == r["doc_id"] for r in got)
    assert source_mix.repeat_to_mix(df.limit(0)).count() == 0


def test_chunks_met_again_are_remembered(monkeypatch):
    from harborline.llm import sentence_pieces
    from harborline.llm.queries import PIECE_MODEL

    pieces = sentence_pieces.Pieces(PIECE_MODEL)
    texts = ["again " * 3 + " ".join(f"once{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}x" for i in range(60)), "again and again \U0001d4b3"]
    want = [sentence_pieces.Encoder(pieces, 4).encode(t) for t in texts]
    encoder, found, plain = sentence_pieces.Encoder(pieces, 4), [], pieces.viterbi
    monkeypatch.setattr(sentence_pieces, "REMEMBERED", 40)
    monkeypatch.setattr(pieces, "viterbi", lambda chunk: found.append(chunk) or plain(chunk))
    assert [encoder.encode(t) for t in texts] == want
    assert found.count("▁again") == 1 and len(encoder.names) < 40
