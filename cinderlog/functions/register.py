"""The engine's scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from cinderlog.functions.levels import NUMBERS, WORDS

_WORDS = " ".join(f"WHEN upper(word) IN ({', '.join(repr(w) for w in words)}) THEN '{level}'" for level, words in WORDS.items())
_NUMBERS = " ".join(f"WHEN n IN ({', '.join(map(str, ns))}) THEN '{level}'" for level, ns in NUMBERS.items())
FUNCTIONS = {
    "level_of": f"(word STRING) RETURNS STRING RETURN CASE {_WORDS} END",
    "level_of_number": f"(n BIGINT) RETURNS STRING RETURN CASE {_NUMBERS} END",
    "level_text": "(word STRING) RETURNS STRING RETURN CASE WHEN word IS NULL OR trim(word) = '' THEN 'UNKNOWN' ELSE upper(trim(word)) END",
    "virtual_trace_id": "(grp STRING, rule STRING, key STRING) RETURNS STRING RETURN concat('vt-', substr(sha2(concat_ws(':', grp, rule, key), 256), 1, 12))",
    "time_bucket_us": "(width BIGINT, ts TIMESTAMP_NTZ, origin TIMESTAMP_NTZ) RETURNS TIMESTAMP_NTZ RETURN timestampadd(MICROSECOND, timestampdiff(MICROSECOND, origin, ts) div width * width, origin)",
    "no_id": "(id STRING) RETURNS STRING RETURN CASE WHEN id RLIKE '^(0{16}|0{32})$' THEN NULL ELSE id END",
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; the names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    return list(FUNCTIONS)
