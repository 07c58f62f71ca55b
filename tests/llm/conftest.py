import pytest
from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs, with a column whose name clashes easily."""

    def make(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS).withColumn("key", F.lit("x")).withColumn("node", F.lit(1))

    return make


WORDS = [f"w{n}" for n in range(400)]


def prose(seed, count=120):
    """Invented words in a fixed random order."""
    import random

    draw = random.Random(seed)
    return [draw.choice(WORDS) + draw.choice("abcdefgh") for _ in range(count)]
