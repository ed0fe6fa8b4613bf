import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SMALL = "/root/testdata/sf0.001"
CLASH = ("id", "doc", "key", "starts", "node", "root", "score", "keep", "bucket", "chunk", "held", "n", "a", "b", "name", "start", "size", "hash", "slot", "shard", "tokens", "bytes", "unit", "grp", "piece_ids", "good", "item_id", "jaccard", "block", "ord")


def plain(rows):
    """Document rows from (id, text)."""
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def make(spark):
    def of(rows, extra=False):
        df = spark.createDataFrame(plain(rows), DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in CLASH})
        return df

    return of


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def hard_rows():
    """Null id, null, empty and blank texts, a very long one, repeated rows, one word, odd characters."""
    import random

    draw = random.Random(3)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 7))) for _ in range(4000)]
    long = " ".join(draw.choice(words) for _ in range(120_000))
    return [(None, "a b c d e f"), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same row here"), (5, "same row here"), (6, "word"), (7, "é ▁ 🎉 日本  x\r\ny  z"), (8, "go " * 500)]
