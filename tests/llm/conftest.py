import random

import pytest

SYLLABLES = "ba ke li mo nu ra se ti vo zu an er ol".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture()
def docs(spark):
    """A frame of documents from (doc_id, text), with columns whose names repeat or clash."""

    def make(rows, **more):
        data = [(d, t, "en", f"src{i % 2}", -1, "x", 0.5) for i, (d, t) in enumerate(rows)]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int, kept string, score double")
        return df.repartition(3) if more.get("spread") else df

    return make


EDGES = [(None, "alone"), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, "Naïve 😀 text\nwith lines"), (6, "x" * 50_000), (7, "a b " * 20_000)]
