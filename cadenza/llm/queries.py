"""One query for each corpus operator, over its whole table, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import chat, decontam, filter_audit, flac, html_text, lang_id, mixing, near_dups, pii, quality, token_counts, token_files, vector_codes
from cadenza.llm.common import read_table


def op1_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as an 8-bit FLAC stream, and what its stored bytes give when they are decoded."""
    tail = F.expr("substring(pcm, length(pcm) - 31, 32)")
    return flac.store_and_read(
        read_table(spark, sf_dir, "documents").select("doc_id", "text"),
        "doc_id",
        "n_bytes",
        F.length("pcm").cast("long").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that windows of benchmark items hit."""
    found = decontam.match_benchmark(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark"))
    found = found.withColumn("n_hit", decontam.hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ",").cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE_2 = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), m AS (
  SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n
), h AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model that does not learn from the held-out fold."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return lang_id.predict(docs, lang_id.fit(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, tail probabilities and the verdict on every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", F.round("expected_grade", 9).alias("expected_grade"), F.round("p_good", 9).alias("p_good"), F.round("p_clean", 9).alias("p_clean"), (F.col("p_clean") >= model.least).alias("kept"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of 150 % of the corpus takes from each document."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("source", "epochs")


ORACLE_5 = r"""
WITH base AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat_ws(':', 'mix', CAST(doc_id AS VARCHAR), text)) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, source_size * CAST(2 AS DOUBLE) AS cap,
         CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) AS pool FROM s
), l AS (
  SELECT *, (pool - (sum(cap) OVER o - cap)) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
), t AS (
  SELECT source, source_size, CAST(least(cap, weight * max(level) OVER ()) AS DOUBLE) AS target FROM l
), p AS (
  SELECT b.doc_id, b.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(sum(b.size) OVER (PARTITION BY b.source ORDER BY k, b.doc_id, b.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - b.size AS before
  FROM base b JOIN t ON b.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + least(greatest(budget - epochs * source_size - before, 0), size) AS BIGINT) AS taken FROM e
"""


def op6_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dialogue once for every participant."""
    return chat.rotate_perspectives(read_table(spark, sf_dir, "conversations"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base matches and all selected spans of personal data."""
    return pii.detect(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents in Arrow files, read back."""
    return token_files.read_token_files(token_files.write_token_files(read_table(spark, sf_dir, "documents")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose 3-word shingles agree by 85 % or more."""
    return near_dups.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, ratio=(85, 100))


ORACLE_10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), x AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), e AS (
  SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)
), e2 AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  SELECT a AS node, a AS reach FROM e2 UNION SELECT r.node, e2.b FROM r JOIN e2 ON r.reach = e2.a
), c AS (
  SELECT node, min(reach) AS component FROM r GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by codebooks that four rounds improve, and their errors."""
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each language in each order."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_media_flac, op2_decontaminate, op3_language, op4_quality, op5_mix_sources, op6_chat_rotation, op7_pii, op8_token_files, op9_html_text, op10_near_duplicates, op11_vector_codes, op12_filter_audit, op13_token_counts, pipeline)
}
ORACLES = {"op2_decontaminate": ORACLE_2, "op5_mix_sources": ORACLE_5, "op6_chat_rotation": chat.ORACLE, "op10_near_duplicates": ORACLE_10, "op11_vector_codes": vector_codes.oracle(), "op12_filter_audit": filter_audit.ORACLE}
