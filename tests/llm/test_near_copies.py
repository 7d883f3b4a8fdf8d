"""The near-dedup stage of the pipeline against a brute-force version."""

import random

import corpus_pipeline
from harborline.llm import near_copies
from harborline.llm.common import Union

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(parts)


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def plain_stay(rows):
    """Ids that stay, and the Jaccard of every linked pair."""
    sets, union, linked = {i: plain_set(t) for i, t in rows}, Union(), []
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                linked.append(both / (len(sets[a]) + len(sets[b]) - both))
                union.join(a, b)
    return {i for i in sets if union.find(i) == i}, linked


def planted(rng):
    """Texts with copies at Jaccard 0.77 to 0.98, a dense group, and a passage that many texts hold."""

    def words(n):
        return [f"w{rng.randrange(5000)}" for _ in range(n)]

    def changed(own, times):
        own = list(own)
        for k in range(times):
            own[20 + k * 11] = f"new{rng.randrange(10**6)}"
        return own

    texts = []
    for k in range(60):
        own = words(400)
        texts += [own, changed(own, 1 + k % 10)]
    dense, passage = words(300), words(60)
    texts += [changed(dense, 1 + k % 4) for k in range(40)]
    texts += [words(30) + passage + words(30) for _ in range(30)]
    texts += [words(3), words(5), ["only"], ["ONLY"], []]
    rng.shuffle(texts)
    return list(enumerate((" ".join(t) for t in texts), start=10))


def test_near_dedup_stage_against_all_pairs(spark, folder):
    rows = planted(random.Random(3))
    want, linked = plain_stay(rows)
    assert sum(0.80 <= j <= 0.95 for j in linked) > 50 and sum(j < 0.85 for j in linked) > 10
    got = [r.doc_id for r in corpus_pipeline.one_of_near_copies(spark, frame(spark, rows), folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_dedup_without_rounds_is_the_same(spark, monkeypatch):
    rows = planted(random.Random(4))
    monkeypatch.setattr(near_copies, "STAR_ROUNDS", 0)
    assert {r.doc_id for r in near_copies.drop_near_copies(frame(spark, rows)).collect()} == plain_stay(rows)[0]


def test_near_dedup_odd_rows(spark):
    text = "one two three four five six seven eight"
    rows = [(None, text), (None, text), (4, text), (4, text), (4, "quite other words"), (7, text + " "), (8, None), (9, "\n")]
    got = near_copies.drop_near_copies(frame(spark, rows)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["4", "4", "4", "8", "None", "None"]
    assert near_copies.drop_near_copies(frame(spark, rows).limit(0)).count() == 0


def test_stages_carry_columns_of_any_name(spark):
    from harborline.llm import exact_dedup

    text = "one two three four five six seven eight"
    rows = [(i, t, "en", 1, "g", "n", "i", "d") for i, t in [(1, text), (2, text), (2, text), (3, text + " Nine"), (None, "x"), (None, "x"), (4, "x")]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string, _id int, gone string, node string, row string, digest string")
    exact = exact_dedup.drop_copies(df, keep="largest")
    assert exact.columns == df.columns
    assert sorted(r["doc_id"] for r in exact.collect()) == [2, 3, 4]
    near = near_copies.drop_near_copies(df)
    assert near.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in near.collect()) == ["1", "4", "None", "None"]  # 3 shares four of five shingles


def test_many_copies_of_one_row(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text)] * 400 + [(2, text + " more")] * 400 + [(3, "other " * 9)]
    assert {(r.doc_id) for r in near_copies.drop_near_copies(frame(spark, rows)).collect()} == {1, 3}


def test_trees_find_near_copies_and_their_links_are_checked(spark, monkeypatch):
    rows = planted(random.Random(5))
    sets = {i: plain_set(t) for i, t in rows}
    nodes = frame(spark, rows).selectExpr("doc_id as node", "text")
    pairs = {(r.a, r.b) for r in near_copies.tree_pairs(nodes, "text", 5).collect()}
    union = Union()
    for a, b in pairs:
        assert a < b
        union.join(a, b)
    near = [(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b])]
    assert sum(union.find(a) == union.find(b) for a, b in near) >= 0.7 * len(near) > 50
    # Links of trees that hold any two texts near are checked as well, and what trees miss is found by keys.
    for radius in (64, 0):
        monkeypatch.setattr(near_copies, "RADIUS", radius)
        assert {r.doc_id for r in near_copies.drop_near_copies(frame(spark, rows)).collect()} == plain_stay(rows)[0]


def test_variants_that_are_not_near_copies_make_few_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base, rows = [f"w{k}" for k in range(150)], []
    for i in range(240):
        own = list(base)
        for k in rng.sample(range(150), 1 + i % 9):
            own[k] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    met, enough = [], near_copies._enough
    monkeypatch.setattr(near_copies, "_enough", lambda pairs: met.append(pairs.count()) or enough(pairs))
    got = {r.doc_id for r in near_copies.drop_near_copies(frame(spark, rows)).collect()}
    want, linked = plain_stay(rows)
    assert got == want and len(want) > 80 and len(linked) > 1000
    assert sum(met) < 40 * len(rows)


def test_the_most_frequent_shingles_come_last(spark):
    both = {int(near_copies.shingle_hashes(t, 5)[0]): t for t in ("a b c d e", "f g h i j")}
    often, less = sorted(both)  # by the hash alone they would come the other way
    texts = [" ".join([both[often], *(f"x{i}_{k}" for k in range(5)), both[less] if i < 40 else ""]) for i in range(60)]
    nodes = frame(spark, enumerate(texts), 1).selectExpr("doc_id as node", "text")
    assert near_copies._frequent(nodes, "text", 5).tolist() == [less, often]
