import pytest
from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly brew jugs of mead beside an old stone mill near the river bend"


def varied(k: int, n: int = 60) -> str:
    """n words that differ by k."""
    words = PROSE.split()
    return " ".join(f"{words[(i * 7 + k) % len(words)]}{(i * i * 31 + k * 17) % 97}" for i in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Hello world. " * 30, "en", "a", 390, "x", 1),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, "x", 2),
        (4, "Hello world. " * 30, "en", "a", 390, "x", 3),
        (4, "Hello world. " * 30, "en", "a", 390, "x", 3),
        (5, " \n\t ", "de", None, 4, "x", 4),
        (6, varied(1), "en", "b", 10, None, 5),
        (7, varied(1) + " tail", "en", "b", 10, None, 5),
        (8, "é世界 naïve café\x1c😀 ﬁ ٣ " * 9, "fr", "b", 10, None, 5),
        (9, "ab" * 30_000, "en", "c", 60_000, None, 6),
        (None, varied(2), "en", "b", 10, None, 7),
        (None, "short one", "en", "b", 9, None, 7),
        (10, varied(3, 5_000), "en", "c", 1, None, 8),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, __x int"
    return spark.createDataFrame(rows, schema).withColumnRenamed("__x", "kept").withColumn("n_words", F.lit("mine"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
