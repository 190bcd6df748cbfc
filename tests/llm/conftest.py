import random

import pytest


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with repeats, near copies, a hot passage, nulls, empty and very long texts, and other columns."""
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(400)] + ["The", "the", "of", "ÉTÉ"]
    hot = " ".join(rnd.choices(words, k=30))
    rows = []
    for i in range(60):
        text = " ".join(rnd.choices(words, k=rnd.choice([3, 10, 25, 60, 120])))
        rows.append(text if i % 3 else f"{text}\n{hot}\t{text[:40]}")
    base = " ".join(rnd.choices(words, k=80)).split(" ")
    for i in range(40):  # near copies, a few words changed
        copy = list(base)
        for _ in range(i % 9):
            copy[rnd.randrange(80)] = rnd.choice(words)
        rows.append(" ".join(copy))
    rows += [rows[5]] * 20 + ["", "   \n", None, "one", "one", "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", " ".join(rnd.choices(words, k=5000)), "é\x85x y\x0bz"]
    data = [(i, t, "en" if i % 2 else "fr", ("hot", None, "x", "y")[0 if i % 3 == 0 else i % 4], 7, "extra") for i, t in enumerate(rows)]
    data += [data[7], (None, rows[8], None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, COPIES int, `Shard` string").repartition(5)


@pytest.fixture(scope="session")
def empty(spark, corpus):
    return spark.createDataFrame([], corpus.schema)
