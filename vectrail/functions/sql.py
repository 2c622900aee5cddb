"""The vector functions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bodies that Catalyst inlines where they are called.
FUNCTIONS = {
    "vec_dot(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x)",
    "vec_norm(a ARRAY<FLOAT>) RETURNS DOUBLE": "sqrt(aggregate(a, 0D, (s, x) -> s + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))",
    "vec_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": (
        "CASE WHEN vec_norm(a) = 0D OR vec_norm(b) = 0D THEN 0D ELSE vec_dot(a, b) / (vec_norm(a) * vec_norm(b)) END"
    ),
    "count_words(t STRING) RETURNS INT": "regexp_count(t, r'\\S+')",
}


def register(spark: SparkSession) -> None:
    """Makes vec_dot, vec_norm, vec_cosine and count_words known to ``spark.sql``."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
