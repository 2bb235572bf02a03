import pytest
from pyspark.sql import functions as F

from clashing import CLASHING


@pytest.fixture
def make(spark):
    def documents(rows, clashing=True):
        """Documents from (doc_id, text) or (doc_id, text, lang, source), with columns of clashing names."""
        full = [(*r, None, None)[:4] for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
        df = df.withColumn("n_chars", F.length("text").cast("long"))
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING}) if clashing else df

    return documents


ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "The quick brown fox's tail — naïve café  x  \r\n\r\n  12345 99٣ don't 'S"),
    (6, "a" * 30_000),
    (7, "é" * 5_000 + " \x1c\x1d x"),
    (8, "<|endoftext|> hello <|endoftext|>"),
    (8, "<|endoftext|> hello <|endoftext|>"),
    (9, "word " * 4_000),
    (-3, "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 👩‍👩‍👧 \u0000 zero"),
    (2**40, "  lead and trail  "),
]


@pytest.fixture
def odd():
    return list(ODD)
