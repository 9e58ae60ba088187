import random

import pytest


@pytest.fixture(scope="session")
def words():
    """A seeded maker of texts of invented words."""
    def make(seed, n, pool=4000):
        rng = random.Random(seed)
        return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))
    return make


@pytest.fixture(scope="session")
def frame(spark):
    """A table of (doc_id, text) rows with further columns whose names the operators use themselves."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for name in ("row", "size", "key", "shard", "label", "node", "hits", "start", "slice", "sig", "part",
                     "copies", "turn", "text_key", "_text_key", "_turn", "_shard", "_toxicity", "m_id", "m_key", "source_size", "slot", "tie"):
            if name not in df.columns:
                df = df.selectExpr("*", f"'x' AS {name}")
        return df
    return make
