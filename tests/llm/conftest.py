import numpy as np
import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (id, text) or (id, text, source), with a column of an unlucky name."""

    def build(rows, clash=None):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        return df.selectExpr("*", f"'mine' AS {clash}") if clash else df

    return build


@pytest.fixture
def rng():
    return np.random.default_rng(7)


@pytest.fixture
def prose(rng):
    """Random sentences over a small vocabulary."""
    words = ["".join(rng.choice(list("abcdefg"), rng.integers(1, 6))) for _ in range(120)]

    def build(n):
        return " ".join(w + ("." if rng.random() < 0.1 else "") for w in rng.choice(words, n))

    return build
