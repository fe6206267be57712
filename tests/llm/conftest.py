from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import types as T

SYLLABLES = "ka lo mi ren tas vu el or in ter do sha pa ny".split()


@pytest.fixture(scope="session", autouse=True)
def shared(spark, tmp_path_factory):
    """Checkpoints need a folder; the cluster's setting wins where there is one."""
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    return spark


@pytest.fixture(scope="session")
def prose():
    """Invented package texts: prose(seed, words)."""

    def make(seed: int, words: int) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def package_files(spark):
    """A files table with columns whose names clash with results, from {path: content} or pairs."""
    clash = ["size", "ids", "spans", "score", "fingerprint", "component", "label", "copy", "n_words", "word", "key"]
    schema = T.StructType([T.StructField("skill_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("content", T.StringType()),
                           T.StructField("ext", T.StringType()), *(T.StructField(c, T.StringType()) for c in clash)])

    def make(rows):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        return spark.createDataFrame([((p or "none/x").split("/")[0], p, c, ".md", *["taken"] * len(clash)) for p, c in rows], schema)

    return make


@pytest.fixture(scope="session")
def hard_rows(prose):
    """Rows with null and empty texts, repeated rows, a null path and a very long text."""
    return [("p/a.md", prose(1, 60)), ("p/a.md", prose(1, 60)), ("p/empty.md", ""), ("p/null.md", None), (None, prose(2, 30)),
            ("p/blank.md", " \n\t "), ("q/long.md", prose(3, 20_000)), ("q/one.md", "word"), ("q/odd.md", "日本語 🎉 é\x00\x01 ▁▁ <s>   x")]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
