"""The functions under SQL names: ``register(spark)``, then use them in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tidemark import vocab

STRIP = r"regexp_replace({}, '(?U)^\\s+|\\s+\\z', '')"

# name, signature, body; all of them are SQL, so they run inside the JVM
FUNCTIONS = (
    ("haversine_km", "lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE", "DOUBLE",
     "2 * 6371.0D * asin(sqrt(least(1.0D, pow(sin((radians(lat2) - radians(lat1)) / 2), 2)"
     " + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2))))"),
    ("predicate_of", "keywords STRING", "STRING", "trim(substring_index(coalesce(keywords, ''), ',', 1))"),
    ("land_use_code", "description STRING", "STRING",
     r"coalesce(nullif(regexp_extract(description, '(?U)用地:([A-Za-z]\\w*)', 1), ''), 'unknown')"),
    ("question_hash", "question STRING", "STRING", "substring(md5(question), 1, 12)"),
    ("normalize_question", "question STRING", "STRING", r"lower(regexp_replace(question, '(?U)\\s+', ''))"),
    ("chunk_id", "source STRING, page INT, chunk_index INT, content STRING", "STRING",
     "concat_ws('_', source, page, chunk_index, substring(md5(content), 1, 8))"),
    ("duration_years", "start_at TIMESTAMP, end_at TIMESTAMP", "DOUBLE", "datediff(end_at, start_at) / 365.25D"),
)



def _packed(pieces: str, glue: str) -> str:
    """Greedy packing of an array of strings, by the arguments ``size`` and ``overlap``."""
    full = "acc.now <> '' AND length(acc.now) + length(p) > size"
    return f"""aggregate({pieces}, named_struct('done', cast(array() AS ARRAY<STRING>), 'now', ''),
  (acc, p) -> named_struct(
    'done', CASE WHEN {full} THEN concat(acc.done, array(acc.now)) ELSE acc.done END,
    'now', CASE WHEN {full} THEN concat(CASE WHEN overlap > 0 THEN substring(acc.now, -overlap, overlap) ELSE '' END, p)
                WHEN acc.now = '' THEN p ELSE concat(acc.now, {glue}, p) END),
  acc -> CASE WHEN acc.now <> '' THEN concat(acc.done, array(acc.now)) ELSE acc.done END)"""


PARAGRAPHS = f"filter(transform(split(text, '\\n'), x -> {STRIP.format('x')}), x -> x <> '')"
SENTENCES = f"filter(split(text, '(?<=[{vocab.SENTENCE_MARKS}])'), x -> x <> '')"
TABLES = (
    ("chunk_text", _packed(PARAGRAPHS, "'\\n'")),
    ("pack_sentences", f"CASE WHEN length(text) <= size THEN array(text) ELSE "
                       f"filter(transform({_packed(SENTENCES, repr(''))}, x -> {STRIP.format('x')}), x -> x <> '') END"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the scalar functions and the table functions ``chunk_text`` and ``pack_sentences`` (text, size, overlap)."""
    for name, arguments, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    for name, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING, size INT, overlap INT) "
                  f"RETURNS TABLE(chunk_index INT, content STRING) RETURN SELECT posexplode({body}) AS (chunk_index, content)")
    return [name for name, *_ in (*FUNCTIONS, *TABLES)]
