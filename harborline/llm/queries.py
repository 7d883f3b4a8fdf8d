"""Named queries of the corpus operators and, where SQL can state them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from harborline.llm import (
    block_labeller,
    embedding_dedup,
    exact_dedup,
    language_id,
    license_scan,
    run_detection,
    sentence_pieces,
    simhash_dedup,
    source_mix,
    substring_dedup,
    surrogates,
    warc_fixity,
    whitening,
)
from harborline.llm.common import table

#: The piece model of the encoding query.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: The key of the surrogate query; a user brings a secret one.
SURROGATE_KEY = "harborline"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_dedup(table(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, thousands, hundreds, id."""
    block = [F.floor(F.col("doc_id") / n).cast("string") for n in (1000, 100)]
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), *block, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return license_scan.license_scan(table(spark, sf_dir, "documents").withColumn("path", path))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.round_trip(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica that is made from the pages: some records have a changed byte, some are lost."""
    pages = table(spark, sf_dir, "pages")
    damaged = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("?"), F.substring("html", 2, 2**31 - 1))).otherwise(F.col("html"))
    replica = pages.where("page_id is null or page_id % 89 <> 7").withColumn("html", damaged)
    original = warc_fixity.inventory(pages)
    return warc_fixity.audit(original, warc_fixity.placed(warc_fixity.archive(replica), original))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def looped(docs: DataFrame) -> DataFrame:
    """The documents, a tenth of them (by crc32 of the id) with the words from some place on repeating a first period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    # Word lists are columns of their own, or each use would split the text again.
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, split).alias("words"))
    n = F.size("words")
    docs = docs.select("doc_id", "text", "words", n.alias("n"), "g", F.when(n > 0, F.col("g") % n).alias("a"))
    rest = F.col("n") - F.col("a")
    docs = docs.withColumn("p", (1 + F.floor(rest / (3 + F.col("g") % 8))).cast("int")).withColumn("a", F.col("a").cast("int"))
    cycle = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil(rest / F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(cycle, F.lit(1), rest.cast("int"))), " ")
    return docs.select("doc_id", F.when(F.col("a").isNotNull(), new).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_detection.periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = run_detection.highest(F.col("runs"))
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_simhash_dedup,
        op3_surrogates,
        op4_embedding_dedup,
        op5_source_mix,
        op6_language_id,
        op7_license_scan,
        op8_sentence_pieces,
        op9_substring_dedup,
        op10_warc_fixity,
        op11_embedding_whitening,
        op12_periodic_runs,
        op13_main_text,
    )
}

_RECORD = """
    'WARC/1.1' || c || 'WARC-Type: response' || c || 'WARC-Target-URI: ' || coalesce(url, '') || c
    || 'WARC-Record-ID: <urn:record:' || page_id || '>' || c || 'Content-Type: text/html; charset=utf-8' || c
    || 'Content-Length: ' || strlen(html) || c || c || html || c || c
"""


def _tree_sql(leaves: str) -> str:
    """Roots of files of up to 4,096 records: three levels of sixteen children."""
    sql = f"select file, position, sha256(\"offset\" || ':' || (\"offset\" + bytes) || ':' || digest) as hash from {leaves}"
    for _ in range(3):
        sql = f"select file, position // 16 as position, sha256(string_agg(hash, '' order by position)) as hash from ({sql}) group by 1, 2"
    return f"select file, hash as root from ({sql})"


_WARC_SQL = f"""
    with p as (select page_id, url, coalesce(html, '') as html, chr(13) || chr(10) as c from pages),
         d as (select page_id, url, case when page_id % 97 = 5 then '?' || substr(html, 2) else html end as html, c
               from p where page_id % 89 <> 7),
         o as (select page_id as key, page_id // 4096 as file, {_RECORD} as record from p),
         m as (select key, file, strlen(record) as bytes, sha256(record) as digest,
                      row_number() over (partition by file order by key) - 1 as position,
                      coalesce(sum(strlen(record)) over (partition by file order by key
                               rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from o),
         r as (select m.key, m.file, m.position, m."offset", strlen(record) as bytes, sha256(record) as digest
               from (select page_id as key, {_RECORD} as record from d) join m using (key)),
         a as ({_tree_sql("m")}), b as ({_tree_sql("r")})
    select m.file, m.position, m.key, m."offset", m.bytes, m.digest, r.digest as replica_digest, a.root, b.root as replica_root,
           case when r.key is null then 'missing' when r.digest <> m.digest then 'changed' else 'ok' end as status
    from m left join r using (key) join a on a.file = m.file join b on b.file = m.file
"""

ORACLE_SQL = {
    "op10_warc_fixity": _WARC_SQL,
    "op1_exact_dedup": """
        with t as (select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents),
             g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from t group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from t join g using (text_sha256)
    """,
}
