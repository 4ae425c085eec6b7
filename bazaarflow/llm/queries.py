"""Queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, labels
from .exact_dedup import exact_duplicates
from .fingerprints import edited_fingerprints
from .jaccard_join import near_duplicates
from .language_id import identify
from .packing import pack
from .quality import quality
from .secret_scan import find_secrets
from .sentencepieces import encode_decode
from .substring_dedup import remove_repeats
from .toxicity import toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), with_text=False)


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir), repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = f"""
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""

WORDS = r"[^\x20\x09-\x0D]+"

OP4_SQL = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS w FROM documents
), sh AS (
    SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
), steps AS (
    SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, s.y FROM reach r JOIN steps s ON r.other = s.x
)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

OP5_SQL = f"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents
), win AS (
    SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), hit AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM win) WHERE doc_id > least
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM hit
), each AS (
    SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS t FROM each ANTI JOIN covered USING (doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sum_of_squares_packing": op1_sum_of_squares_packing,
        "op2_language_id": op2_language_id,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_substring_dedup": op5_substring_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_toxicity": op8_toxicity,
        "op9_secret_scan": op9_secret_scan,
        "op10_quality": op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op4_ngram_jaccard_join": OP4_SQL, "op5_substring_dedup": OP5_SQL}
