import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice(["an", "the", "re", "ing", "ou", "st", "è", "tion"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]


@pytest.fixture(scope="session")
def corpus(words):
    """Documents with copies, near copies, nulls, empty texts, repeated rows, a hot source and a very long text."""
    rng = random.Random(5)
    rows = []
    for k in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 200)))
        rows.append((k, text, "en", "hot" if k % 3 == 0 else f"s{k % 7}", len(text)))
    for k in range(240, 280):
        rows.append((k, rows[k % 5][1], "en", "hot", None))
    for k in range(280, 320):
        rows.append((k, rows[7][1] + " extra" + " word" * (k % 3), "fr", None, None))
    rows += [(320, None, None, None, None), (321, "", "en", "s1", 0), (322, " \t\n", "en", "s1", 3), (None, "no id here at all", "en", "s2", None), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[250]]
    rows.append((323, " ".join(rng.choice(words) for _ in range(40_000)), "en", "s3", None))
    rows.append((324, "x" * 5000, "de", "s4", None))
    return rows


@pytest.fixture
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOC_SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
