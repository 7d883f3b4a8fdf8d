"""Exact, SimHash and substring dedup against plain versions."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from harborline.llm import exact_dedup, simhash_dedup, substring_dedup
from harborline.llm.common import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts, parts=3):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    texts = [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(60)]
    passage = words(rng, 70)
    for k in range(8):  # a passage that many documents hold
        own = words(rng, 40)
        texts.append(" ".join(own[:20] + passage + own[20:]))
    texts += [texts[3]] * 5 + [texts[10]] * 2  # copies
    for k in range(5):  # near copies
        near = texts[20].split()
        near[k % len(near)] = "changed"
        texts.append(" ".join(near))
    texts += [None, "", "", "one", "one two", "ONE Two", "a b c", "x " * 3000, "\n\t ", " ".join(passage * 3)]
    return list(enumerate(texts, start=100))


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, corpus, keep):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, corpus, 11), keep=keep).collect()}
    assert len(got) == len(corpus)
    groups = {}
    for i, t in corpus:
        groups.setdefault(t or "", []).append(i)
    for i, t in corpus:
        group = groups[t or ""]
        want = min(group) if keep == "smallest" else max(group)
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (want, len(group), want == i)
        assert r.text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_exact_dedup_odd_rows(spark):
    rows = [(None, "a"), (1, "a"), (1, "a"), (None, "b"), (None, "b"), (2, None), (3, "")]
    df = frame(spark, rows).withColumn("row", F.lit(1)).withColumn("digest", F.lit(2))
    got = exact_dedup.exact_dedup(df, keep="largest").collect()
    assert len(got) == 7 and sum(r.kept for r in got) == 3
    assert sum(r.kept for r in got if r.doc_id == 1) == 1
    assert [r.keep_id for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()] == [3, 3]
    stay = exact_dedup.drop_copies(df, keep="largest")
    assert stay.columns == df.columns and stay.count() == 3
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    assert exact_dedup.drop_copies(df.limit(0)).count() == 0


def test_two_texts_under_one_digest_stop_the_merge(spark):
    runs = spark.createDataFrame([(1, 1, "d", 3, 7), (2, 2, "d", 4, 7)], "row bigint, id bigint, digest string, bytes int, second bigint")
    with pytest.raises(Exception, match="differ in bytes"):
        exact_dedup.tree_merge(runs).collect()


def plain_print(text, shingle):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, distance):
    root = {i: i for i in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(prints)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if (prints[a] ^ prints[b]).bit_count() <= distance:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("distance", [0, 4, 16])
def test_simhash(spark, corpus, distance):
    blocks = 6 if distance < 6 else 20
    got = {r.doc_id: r for r in simhash_dedup.simhash_dedup(frame(spark, corpus), distance=distance, blocks=blocks if distance < 6 else 17).collect()}
    prints = {i: plain_print(t, 4) for i, t in corpus}
    want = plain_components(prints, distance)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_simhash_odd_rows(spark):
    rows = [(None, "q w e r t"), (4, "q w e r t"), (4, "q w e r t"), (None, "alone here"), (9, None)]
    df = frame(spark, rows).withColumn("print", F.lit("x")).withColumn("shard", F.lit(1))
    got = simhash_dedup.simhash_dedup(df).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("4", "4", True), ("4", "4", True), ("9", "9", True), ("None", "4", False), ("None", "None", False)
    ]
    assert simhash_dedup.simhash_dedup(df.limit(0)).count() == 0
    assert simhash_dedup.drop_near_copies(df).count() == 5


def test_equal_hash_as_sql(spark):
    shingle = "déjà vu encore une"
    assert spark.sql(f"select xxhash64('{shingle}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(shingle.encode(), 42)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200, 400)] + [(5, i) for i in range(1000, 1200)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    got = {r.id: r.root for r in components(df, "test", block=20).collect()}
    assert got == {i: 200 for i in range(201, 401)} | {i: 5 for i in range(1000, 1200)}
    assert components(df.limit(0), "test").count() == 0


def plain_removal(corpus, window):
    first, texts = {}, {i: (t or "").encode().split() for i, t in corpus}
    for i in sorted(texts):
        for k in range(len(texts[i]) - window + 1):
            first.setdefault(tuple(texts[i][k : k + window]), i)
    out = {}
    for i, w in texts.items():
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                keep[k : k + window] = [False] * window
        out[i] = (len(w), len(w) - sum(keep), b" ".join(x for x, y in zip(w, keep) if y).decode())
    return out


@pytest.mark.parametrize("window, anchor", [(50, 8), (10, 3), (9, 9)])
def test_substring_dedup(spark, corpus, window, anchor):
    got = substring_dedup.substring_dedup(frame(spark, corpus), window=window, anchor=anchor).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == plain_removal(corpus, window)


def test_substring_dedup_in_small_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(substring_dedup, "INDEX_WORDS", 50)
    got = substring_dedup.substring_dedup(frame(spark, corpus), window=20).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == plain_removal(corpus, 20)


def test_substring_dedup_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (7, text), (7, text), (7, text + " more"), (8, text), (9, None)]
    df = frame(spark, rows).withColumn("anchor", F.lit(1)).withColumn("mark", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert got == [("7", 60, 0), ("7", 60, 0), ("7", 61, 0), ("8", 60, 60), ("9", 0, 0), ("None", 60, 0)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0


def test_index_counts_like_a_scan():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 4, 300), 0)
    index = substring_dedup.FMIndex(text, np.arange(len(text)), 12)
    for _ in range(200):
        start, size = int(rng.integers(0, 280)), int(rng.integers(1, 13))
        pattern = text[start : start + size] if rng.random() < 0.7 else rng.integers(1, 4, size)
        low, high = np.array([0]), np.array([len(text)])
        for symbol in pattern[::-1]:
            low, high = index.step(np.array([symbol]), low, high)
        want = sum(np.array_equal(text[k : k + len(pattern)], pattern) for k in range(len(text) - len(pattern) + 1))
        assert max(0, int(high[0] - low[0])) == want
