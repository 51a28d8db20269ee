import pytest
from pyspark.sql import types as T

WORDS = "the a of and to in is that for on with as by at from this river stone light paper".split()


@pytest.fixture
def documents(spark):
    """Build documents; ``rows`` are (doc_id, text) or (doc_id, text, source)."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("block", T.StringType()),
            T.StructField("size", T.StringType()),
        ]
    )

    def build(rows, clashing=False):
        full = [(*r, "s")[:3] + ("x", None) for r in rows]
        frame = spark.createDataFrame(full, schema)
        return frame if clashing else frame.select("doc_id", "text", "source")

    return build


@pytest.fixture
def prose():
    """Deterministic running text of a given number of words."""

    def make(seed, count):
        state, out = seed * 7919 + 1, []
        for _ in range(count):
            state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
            out.append(WORDS[(state >> 33) % len(WORDS)] + str((state >> 40) % 97))
        return " ".join(out)

    return make
