import random

import pytest

WORDS = "the of and to in a is that for it was as with be on not this are or from".split()


@pytest.fixture
def awkward(spark):
    """Documents with nulls, empty, blank and long texts, ties, repeated rows and columns named like results."""

    def build(*extra, long_words=20_000):
        rng = random.Random(5)
        base = " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(120))
        rows = [
            (1, base),
            (2, base),
            (2, base),
            (3, None),
            (4, ""),
            (5, " \n\t "),
            (6, base + " tail of another kind"),
            (7, "one"),
            (None, base),
            (None, None),
            (8, " ".join(rng.choice(WORDS) + str(rng.randrange(5000)) for _ in range(long_words))),
            (9, "Zürich Ünïcode ÄÖ 日本語 テスト 🎉 é  nbsp"),
            (10, "x" * 5000),
            *extra,
        ]
        schema = "doc_id long, text string, lang string, score double, fingerprint string, n_words string, ids string, start string, p_toxic string"
        return spark.createDataFrame([(i, t, "en", 1.0, "f", "w", "i", "s", "p") for i, t in rows], schema).repartition(3)

    return build
