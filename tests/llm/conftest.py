import random

import pytest

SCHEMA = "doc_id long, text string, lang string, id long, n long, spans string"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with columns whose names the operators use themselves."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [(i, t, "en", 7, 8, "x") for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    """Seeded sentences of made-up words."""

    def make(words, seed):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("aeioulnrstdé") for _ in range(rng.randint(2, 7))) for _ in range(words))

    return make
