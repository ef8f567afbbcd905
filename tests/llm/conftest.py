import pytest
from pyspark.sql import functions as F

LONG = "Lorem ipsum dolor sit amet, don't 12345 ünïcode  double\tspaces\n" * 3000
CLASHING = (
    "row_key lang_pred score size source_size target copies taken n_docs kept keep_id group_size text_sha256 print part "
    "n_shingles component_id label n_tokens ids_sha256 decoded_sha256 start n_replaced key held_out"
).split()

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a", 10),
    (2, "The quick  brown fox jumps over the lazy dog near the river bank today.", "en", None, 10),
    (3, None, "de", "b", None),
    (4, "", None, "b", 0),
    (5, " \t\n\x0b\x0c\r", "fr", "b", 6),
    (6, "12345 67890 !!! 999", "en", "c", 1),
    (None, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a", 5),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a", 5),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund.", "de", "a", 5),
    (8, LONG, "en", "a", 1),
    (9, LONG + "end", "en", "c", 1),
    (10, "x" * 150_000, "en", "c", 1),
    (11, "Ж日本語 emoji 😀 \x1c\x85  mixed", None, "ü", 1),
    (12, "�  nbsp", "", "", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls in every column, empty and very long texts, ties, repeated rows, clashing columns."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
