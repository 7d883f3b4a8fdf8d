"""Surrogates, licences, archives, embeddings and the pipeline."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harborline.llm import embedding_dedup, license_scan, surrogates, warc_fixity
from harborline.llm.common import Union


def texts_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_surrogates_keep_type_format_and_coreference(spark):
    rows = [
        (1, "Mail bob.lee@mail5.example.com or BOB.LEE@MAIL5.EXAMPLE.COM. Call +1 (499) 555-6503 or +1 499-555-6503!"),
        (2, "ip 10.20.30.40 card 4111 1111 1111 1111 and 4111111111111112, ssn 123-45-6789 bob.lee@mail5.example.com"),
        (3, "Mr. Peter Schmidt met Anna Schmidt; Frau Schmidt left. Госпожа Иванова"),
        (4, None), (5, ""), (6, 'token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'), (None, "ann@mail5.example.com"), (8, "Nothing here, 12 apples."),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("finds", F.lit(1)).withColumn("attempts", F.lit(2))
    got = texts_of(surrogates.surrogates(df, "key"))
    assert len(got) == len(rows) and got[4].text is None and got[5].text == "" and got[8].text == rows[-1][1]
    assert [got[i].n_replaced for i in (1, 2, 3, 6)] == [4, 5, 4, 1]
    words = got[1].text.replace("!", "").split()
    assert words[3].rstrip(".") == words[1].upper() and words[1] in got[2].text  # one address, everywhere
    assert got[None].text.split("@")[1] == words[1].split("@")[1] and got[None].text != words[1]  # one domain
    phones = got[1].text.split("Call ")[1].rstrip("!").split(" or ")
    digits = ["".join(c for c in p if c.isdigit()) for p in phones]
    assert digits[0] == digits[1] != "14995556503" and phones[0].startswith("+1 (") and digits[0][0] == "1"

    def luhn(number):
        d = [int(c) for c in reversed(number)]
        return sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])

    after = got[2].text.split("card ")[1]
    assert luhn(after[:19].replace(" ", "")) % 10 == 0 and luhn(after[24:40]) % 10 != 0
    people = got[3].text.replace(";", "").replace(".", "").split()
    assert people[2] == people[5] == people[7] and people[2] != "Schmidt"
    assert people[1] in surrogates.GIVEN["latin", "m"] and people[4] in surrogates.GIVEN["latin", "f"]
    assert people[-1] != "Иванова" and all("а" <= c.lower() <= "я" for c in people[-1])
    for r in got.values():
        at = 0
        for s in r.spans:
            at += s.gap + s.length
        assert len(r.spans) == r.n_replaced and (r.text is None or at <= 200)
    again = texts_of(surrogates.surrogates(df.repartition(4), "key"))
    assert {i: r.text for i, r in again.items()} == {i: r.text for i, r in got.items()}
    assert texts_of(surrogates.surrogates(df, "other"))[6].text != got[6].text
    assert surrogates.surrogates(df.limit(0), "key").count() == 0
    plan = surrogates.surrogates(df, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_surrogates_stay_distinct_and_out_of_the_corpus(spark):
    # Numbers so short that first surrogates clash, with each other and with the corpus.
    df = spark.range(3000).select("id", F.format_string("1234567%06d", F.col("id")).alias("value")).select(F.lit("ssn").alias("kind"), F.substring("value", 10, 4).alias("value")).distinct()
    later = surrogates.attempts_needed(df, "key")
    final = (
        df.join(later, ["kind", "value"], "left")
        .withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        .withColumn("new", surrogates.surrogate_of(F.col("kind"), F.col("value"), F.col("attempt"), F.lit("key")))
    ).collect()
    assert later.count() > 0 and len({r.new for r in final}) == len(final) == 3000
    assert not {r.new for r in final} & {r.value for r in final}


def test_no_planted_entity_is_left(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = surrogates.surrogates(docs, "key").select("doc_id", F.col("text").alias("new"))
    old = docs.select("doc_id", F.explode(surrogates._finds(F.col("text"))).alias("entity"))
    assert old.count() > 3
    assert old.join(out, "doc_id").where(F.contains("new", "entity")).count() == 0


def plain_scan(files):
    """Best cosine per file over its sentences, lines and paragraphs."""
    import re
    from collections import Counter

    def terms(text):
        return re.findall(r"\w+", text.lower().replace("_", " "))

    models = {f"{n}/{k}": (n, Counter(terms(t))) for n, texts in license_scan.TEMPLATES.items() for k, t in enumerate(texts)}
    vocabulary = {t for _, c in models.values() for t in c}
    held = Counter(t for _, _, text in files for t in set(terms(text or "")) & vocabulary)
    idf = {t: math.log((len(files) + 1) / (held[t] + 1)) + 1 for t in vocabulary}
    out = {}
    for i, _, text in files:
        best, text = 0.0, text or ""
        for line in re.split(r"\r?\n", text):
            for passage in [line, *re.split(r"(?<=[.!?])[ \t]+", line), *re.split(r"\r?\n[ \t]*\r?\n", text)]:
                if re.search(license_scan.CUE, passage):
                    c = Counter(terms(passage))
                    norm = math.sqrt(sum((n * idf.get(t, 1.0)) ** 2 for t, n in c.items()))
                    for _, m in models.values():
                        size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in m.items()))
                        best = max(best, sum(n * idf[t] * c[t] * idf[t] for t, n in m.items()) / norm / size)
        out[i] = best
    return out


def test_licences_and_inheritance(spark):
    mit, apache = license_scan.TEMPLATES["MIT"][0], license_scan.TEMPLATES["Apache-2.0"][0]
    files = [
        (1, "a/LICENSE", mit + "\n" + "other words " * 30), (2, "a/x.c", "int main"), (3, "a/b/y.c", f"// {apache}\n" + "int main " * 20), (4, "a/b/z.c", "int main"),
        (5, "a/b/c/COPYING", apache), (6, "a/b/c/d/e.c", "word " * 50), (7, "q/r.c", "a licence is mentioned, not given, in this long sentence"), (8, None, "x"), (9, "top.c", None),
        (10, "q/only.txt", license_scan.TEMPLATES["CC-BY-NC-4.0"][0]), (11, "q/s.c", "b"), (None, "a/x.c", "again"),
    ]
    df = spark.createDataFrame(files, "doc_id bigint, path string, text string").withColumn("dir", F.lit(1)).withColumn("row", F.lit(1))
    got = texts_of(license_scan.license_scan(df))
    assert len(got) == len(files)
    want = {1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: ("MIT", "inherited", "a"), 5: ("Apache-2.0", "own", None),
            6: ("Apache-2.0", "inherited", "a/b/c"), 7: ("CC-BY-NC-4.0", "inherited", "q"), 8: (None, "none", None), 9: (None, "none", None),
            10: ("CC-BY-NC-4.0", "own", None), 11: ("CC-BY-NC-4.0", "inherited", "q"), None: ("MIT", "inherited", "a")}
    assert {i: (r.licence, r.origin, r.licensed_by) for i, r in got.items()} == want
    plain = plain_scan(files)
    assert all(abs(got[i].score - plain[i]) < 1e-6 for i, r in got.items() if r.origin == "own")
    assert license_scan.license_scan(df.limit(0)).count() == 0


def test_audit_finds_every_damage(spark):
    pages = spark.range(700).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), F.concat(F.lit("<p>"), "id").alias("html"))
    more = spark.createDataFrame([(None, None, None), (5, "again", "x"), (5, "again", "x"), (900_000, "é", "ü" * 1000)], "page_id bigint, url string, html string")
    pages = pages.union(more).withColumn("file", F.lit("x"))
    original = warc_fixity.inventory(pages)
    damaged = pages.withColumn("html", F.when(F.col("page_id") == 33, "other").otherwise(F.col("html"))).where("page_id is null or page_id <> 400")
    extra = spark.createDataFrame([(77, "new", "n")], "page_id bigint, url string, html string").withColumn("file", F.lit("x"))
    replica = warc_fixity.placed(warc_fixity.archive(damaged.union(extra)), original)
    rows = warc_fixity.audit(original, replica).collect()
    odd = {(r.key, r.status) for r in rows if r.status != "ok"}
    assert (33, "changed") in odd and (400, "missing") in odd and len(rows) == 705
    assert [s for k, s in odd if k not in (33, 400, 77)] == [] and ((77, "extra") in odd)
    assert {r.file for r in rows if r.root != r.replica_root} == {0}
    same = warc_fixity.audit(original, warc_fixity.placed(warc_fixity.archive(pages), original)).collect()
    assert {r.status for r in same} == {"ok"} and all(r.root == r.replica_root for r in same)
    empty = warc_fixity.inventory(pages.limit(0))
    assert warc_fixity.audit(empty, empty).count() == 0


def test_offsets_and_roots_by_hand(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "h" * i) for i in range(3)], "page_id bigint, url string, html string")
    records = warc_fixity.inventory(pages).orderBy("position").collect()
    assert [r.offset for r in records] == [0, records[0].bytes, records[0].bytes + records[1].bytes]
    text = pages.where("page_id = 2").select(warc_fixity.record_text(F.col("url"), F.col("page_id"), F.col("html"))).first()[0]
    assert records[2].digest == hashlib.sha256(text.encode()).hexdigest() and "Content-Length: 2\r\n\r\nhh\r\n\r\n" in text
    leaves = [hashlib.sha256(f"{r.offset}:{r.offset + r.bytes}:{r.digest}".encode()).hexdigest() for r in records]
    node = "".join(leaves)
    for _ in range(3):
        node = hashlib.sha256(node.encode()).hexdigest()
    assert warc_fixity.file_roots(warc_fixity.merkle_tree(warc_fixity.inventory(pages))).first().root == node


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    rows = []
    for i in range(900):
        v = centres[i % 40] + rng.normal(size=16) * (0.12 if i % 3 else 0.9)
        rows.append((i, [float(x) for x in v], i % 3))
    rows += [(2000 + k, rows[7][1], 1) for k in range(30)]
    odd = [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] * 16, 1), (3004, [float("inf")] + [1.0] * 15, 1),
           (3005, rows[0][1], None), (3006, [None] + [1.0] * 15, 1), (3007, [1.0, 2.0], 1), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, label int").withColumn("shard", F.lit(1)).withColumn("name", F.lit("n"))
    got = {r.vec_id: r for r in embedding_dedup.embedding_dedup(df, least=0.9).collect()}
    union, links = Union(), dict.fromkeys((r[0] for r in rows), 0)
    for label in range(3):
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for a, b in zip(*np.where(x @ x.T >= 0.9)):
            if a != b:
                links[own[a][0]] += 1
                union.join(own[a][0], own[b][0])
    assert len(got) == len(rows) + len(odd) and sum(links.values()) > 500
    assert {i: (got[i].n_links, got[i].component_id) for i in links} == {i: (n, union.find(i)) for i, n in links.items()}
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in odd[:-1])
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (None, None, False)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD_ROWS", 60)
    monkeypatch.setattr(embedding_dedup, "QUERY_ROWS", 90)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(100, 12))
    rows = [(i, [float(x) for x in base[i % 100] + rng.normal(size=12) * 0.02], 4) for i in range(300)]
    got = embedding_dedup.embedding_dedup(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert all(r.n_links == 2 and r.component_id == r.vec_id % 100 for r in got)


def test_pipeline_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(900_001, None, "en", "src0", 0), (900_002, "123 456", "en", "src0", 7), (900_003, "Only here. " * 30, None, None, 330)], docs.schema)
    now = docs.union(odd)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = corpus_pipeline.spool(stage(spark, now, folder), "stage")
        if k < 4:
            assert after.columns == docs.columns, name
        ids = [r.doc_id for r in after.select("doc_id").collect()]
        if k == 0:
            assert set(ids) == {r.doc_id for r in now.collect()} - {900_001, 900_002}
        if k == 1:
            assert after.select("text").distinct().count() == len(ids) == now.select("text").distinct().count()
        if k == 4:
            assert len(ids) == now.count() and after.where("not exact").count() == 0
        now = after
    assert now.count() > 100


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_stages_of_an_empty_table(spark, folder, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[stage][1](spark, docs, folder).count() == 0
