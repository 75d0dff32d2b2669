"""The registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25, embeddings, fim, language, licenses, mixing, packing, pii, secrets, simhash, urls, variants, warc
from .common import docs_table, stash


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(docs_table(spark, sf_dir))
    base, spans = F.col("__found.base"), F.col("__found.all")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(spans).alias("spans"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    model = language.train(docs, ~language.held_out())
    found = language.identify(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


#: A key for the registered query alone; users bring their own.
PII_KEY = b"plumbline-query-key"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs_table(spark, sf_dir), PII_KEY)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(docs_table(spark, sf_dir, "pages"))
    return warc.measured(warc.read(index))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(docs_table(spark, sf_dir))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize_pieces(docs_table(spark, sf_dir))
    digests = pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(stash(digests, "pieces"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(docs_table(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.quality_domains(docs_table(spark, sf_dir, "labels"))
    mixed = mixing.copies(mixing.mix(docs_table(spark, sf_dir), labelled), seed=mixing.SEED)
    likeliest = F.array_max(F.map_values("posterior")).alias("probability")
    return mixed.select("doc_id", "tokens", "domain", likeliest, "rate", "copies")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(docs_table(spark, sf_dir, "embeddings"))


def op9_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_table(spark, sf_dir)
    return bm25.search(bm25.build(docs), docs.filter(bm25.is_query()))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(docs_table(spark, sf_dir))
    output, form = F.col("fim.output"), F.col("fim.form")
    back = fim.restored(output, form)
    return made.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", F.sha2(output, 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(docs_table(spark, sf_dir), drop_of=199)


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = docs_table(spark, sf_dir, "pages")
    model = urls.mine(urls.labelled_pages(pages, docs_table(spark, sf_dir, "labels")))
    return urls.judge(pages, model).select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict", "judged.confidence")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_language_id": op2_language_id,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_warc_index": op4_warc_index,
    "op5_license_scan": op5_license_scan,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_mixing": op7_mixing,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_bm25_topk": op9_bm25_topk,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_url_filters": op13_url_filters,
}

ORACLE: dict[str, str] = {
    "op4_warc_index": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), q AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p
        )
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> least THEN least END AS refers_to
        FROM q
    """,
    "op5_license_scan": licenses.oracle_sql(),
    "op11_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
        ), h AS (
            SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d
        ), c AS (
            SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
        ), p AS (
            SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, z - a) AS middle, substr(t, z + 1) AS suffix FROM c
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(z - a AS BIGINT) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
            sha256(prefix || middle || suffix) AS restored_sha256 FROM p
    """,
}
