"""The corpus queries, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from public_tokenizers import path as tokenizer_file

from . import ann, best_fit, bpe, language_id, media, near_dups, packing, pii, resampling, suffix_dedup, toxicity, url_filter, whitening

#: The rules of the url query.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


#: Bytes of the shortest repeats that count for longest_run: somewhat less than passages of 50 words have.
REPORTED = 240


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit_language_model(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    found = language_id.identify_language(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), report=REPORTED)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "longest_run")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_media(table(spark, sf_dir, "documents"))
    found = media.describe_media(stored, keep=("n_bytes",))
    payload, size = F.col("payload"), F.length("payload")
    return found.select(
        "doc_id", "n_bytes", size.cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "media_type", "corrected", F.size("embedded").alias("n_embedded"),
    )


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_entities(table(spark, sf_dir, "documents"), key=PII_KEY)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_texts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chosen = toxicity.sample_labels(table(spark, sf_dir, "labels"))
    labelled = docs.join(F.broadcast(chosen), "doc_id")  # about 2,000 ids of each label
    return toxicity.score_severity(docs, toxicity.fit_severity(labelled))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = best_fit.pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: The surrogates' key; production sets its own.
PII_KEY = "corpus-surrogates"
QUERIES = {"op1_ann": op1_ann, "op2_language_id": op2_language_id, "op3_suffix_dedup": op3_suffix_dedup, "op4_packing": op4_packing, "op5_media": op5_media, "op6_near_dups": op6_near_dups, "op7_url_filter": op7_url_filter, "op8_pii": op8_pii, "op9_bpe": op9_bpe, "op10_toxicity": op10_toxicity, "op11_whitening": op11_whitening, "op12_resampling": op12_resampling, "op13_best_fit": op13_best_fit}
#: CRC-32 of a word is folded over its bytes with a table made from the polynomial.
_CRC = """(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(w)) // 2), lambda k: CAST('0x' || substr(hex(w), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])))"""
_RESAMPLED = rf"""WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, s: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(0, 256) r(i))),
    d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
    p AS (SELECT k, unnest(ws) AS w FROM d), q AS (SELECT unnest(ws) AS w FROM b),
    h AS (SELECT w, xor({_CRC}, 4294967295::BIGINT) % 10000 AS bucket FROM (SELECT w FROM p UNION SELECT w FROM q), crc),
    s AS (SELECT bucket, count(*) AS s FROM p JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM q JOIN h USING (w) GROUP BY 1),
    n AS (SELECT CAST((SELECT count(*) FROM p) AS DOUBLE) AS alls, CAST((SELECT count(*) FROM q) AS DOUBLE) AS allt),
    g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * (alls + 10000) / ((s + 1) * (allt + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), n),
    w AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM p JOIN h USING (w) JOIN g USING (bucket) GROUP BY 1),
    x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (k)),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM x WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM x LEFT JOIN r USING (doc_id)"""
ORACLE_SQL: dict[str, str] = {"op12_resampling": _RESAMPLED}
