import numpy as np
import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"

#: Words of invented prose; texts below are drawn from them.
WORDS = "river stone amber window garden copper silent morning harbor letter winter candle forest market bridge mirror thunder velvet meadow lantern orchard pebble saddle timber valley whistle anchor basket cellar dragon ember falcon".split()


def prose(rng: np.random.Generator, n: int) -> str:
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="session")
def rng():
    return np.random.default_rng(11)


@pytest.fixture(scope="session")
def documents(spark, rng):
    """Plain texts, exact and near copies, a benchmark passage, personal data, empty and null texts, a null id, repeated rows."""
    texts = [prose(rng, int(n)) for n in rng.integers(5, 120, 40)]
    texts += [texts[3], texts[3], texts[4] + " end", "", None, "   ", "one two three", "A B\tC", "ünï çødé " * 30, "x" * 70_000, prose(rng, 3000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, texts[0], None, None, None), rows[0]]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
