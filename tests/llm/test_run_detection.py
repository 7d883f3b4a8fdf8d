"""Periodic runs against a plain scan of every period."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from harborline.llm import queries, run_detection

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    found, n = {}, len(words)
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def random_words(rnd):
    letters = rnd.choice([1, 2, 3, 20, 400])
    words = [f"w{rnd.randrange(letters)}" for _ in range(rnd.choice([0, 1, 23, 24, 60, 300]))]
    for _ in range(rnd.choice([0, 1, 2, 4])):
        period = [f"w{rnd.randrange(letters)}" for _ in range(rnd.choice([1, 2, 5, 8, 9, 30]))]
        run = (period * rnd.randrange(2, 7))[: rnd.randrange(1, 200)] * rnd.choice([1, 1, 3])
        at = rnd.randrange(len(words) + 1)
        words[at:at] = run
    return words


def test_random_texts(spark):
    rnd = random.Random(5)
    texts = {i: random_words(rnd) for i in range(400)}
    rows = [(i, rnd.choice([" ", "\t\n", " \x0b "]).join(w), "x") for i, w in texts.items()]
    out = run_detection.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string, runs string").repartition(4)).collect()
    assert len(out) == len(texts)
    for r in out:
        runs = plain_runs(texts[r["doc_id"]])
        assert [tuple(x) for x in r["runs"]] == runs
        assert r["kept_text"] == " ".join(kept_words(texts[r["doc_id"]], runs))
        assert r["n_words"] == len(texts[r["doc_id"]])


def test_odd_rows(spark):
    long = ["a"] * 60_000 + [f"n{i}" for i in range(90_000)] + [f"p{i % 700}" for i in range(150_000)] + ["b", "c"] * 30_000
    rows = [(1, None), (2, ""), (3, " \n"), (None, "x " * 30), (4, "x " * 30), (4, "x " * 30), (5, "x y " * 24), (6, " ".join(long))]
    out = run_detection.periodic_runs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["kept_text"]))
    assert by[1] == by[2] == by[3] == [([], "")]
    assert by[None] == [([(0, 30, 1)], "x")]
    assert by[4] == by[None] * 2
    assert by[5] == [([(0, 24, 1)], "x y")]
    assert by[6][0][0] == [(0, 60_000, 1), (150_000, 150_000, 700), (300_000, 60_000, 2)]
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert run_detection.periodic_runs(empty).count() == 0


def test_one_line_very_often(spark):
    rnd = random.Random(2)
    line = [f"l{i}" for i in range(12)]
    words = []
    for i in range(1_500):
        words += line + [f"u{i}_{j}" for j in range(rnd.randrange(3))]
    out = run_detection.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string")).collect()
    assert [tuple(x) for x in out[0]["runs"]] == plain_runs(words)


def test_ties_of_the_highest_run(spark):
    rows = [(1, [(5, 24, 2), (40, 12, 1), (90, 24, 2)]), (2, []), (3, [(0, 24, 8), (0, 50, 16)]), (4, [(3, 27, 9), (3, 24, 8)])]
    df = spark.createDataFrame(rows, "k int, runs array<struct<start: bigint, length: bigint, period: bigint>>")
    best = {r["k"]: r["b"] and tuple(r["b"]) for r in df.select("k", run_detection.highest(F.col("runs")).alias("b")).collect()}
    assert best == {1: (5, 24, 2), 2: None, 3: (0, 50, 16), 4: (3, 27, 9)}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query(spark, sf):
    path = f"/root/testdata/{sf}"
    out = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, path).collect()}
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    assert len(out) == len(docs)
    looped = 0
    for d in docs:
        words = WORD.findall(d["text"] or "")
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            looped += 1
        runs = plain_runs(words)
        r = out[d["doc_id"]]
        best = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None,) * 3)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(kept_words(words, runs)).encode()).hexdigest()
    assert looped > 10
