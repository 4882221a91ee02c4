import random
from pathlib import Path

import pytest

import __spark_entry__ as entry

VOCABULARY = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ne", "su") for b in ("r", "t", "nd", "s") for c in ("a", "en", "o")]


def prose(seed: int, n: int) -> str:
    """n words of made-up text, the same for the same seed."""
    pick = random.Random(seed)
    return " ".join(pick.choice(VOCABULARY) + pick.choice(["", "", "", "ly", "ed"]) for _ in range(n))


@pytest.fixture
def docs(spark):
    """A table of documents from texts, or from (doc_id, text) pairs; with columns whose names operators use inside."""

    def make(rows):
        pairs = [row if isinstance(row, tuple) else (i, row) for i, row in enumerate(rows)]
        schema = "doc_id long, text string, lang string, source string, n_chars long, id long, kept string, key string"
        table = [(i, text, "xx", "s", len(text or ""), 7, "x", "y") for i, text in pairs]
        return spark.createDataFrame(table, schema)

    return make


@pytest.fixture
def query(spark, tmp_path):
    """Runs a registered query over given tables and returns its rows."""

    def run(name, **tables):
        folder = tmp_path / str(len(list(Path(tmp_path).iterdir())))
        for table, df in tables.items():
            df.write.parquet(f"{folder}/{table}.parquet")
        return entry.queries()[name](spark, str(folder)).collect()

    return run
