import random

import pytest

WORDS = ["".join(random.Random(k).choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3 + k % 7)) for k in range(400)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture
def docs_of(spark):
    """Rows with the columns of documents and others whose names meet those that operators give."""

    def make(texts, ids=None):
        rows = [(ids[k] if ids else k, t, "en", "s", len(t) if t is not None else None, "x", 1) for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, start int").repartition(3)

    return make


ODD = [None, "", " \n\t", "a", "a", "é", "x" * 30_000, "word " * 20_000, "line\nline\nline", "\n\n\n", "1.2.3.4", None]
